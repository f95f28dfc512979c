from __future__ import annotations

from talkmill.llm import quotations as q

SCHEMA = "conv_id long, turn long, text string, hash long, scope string, at string, position int"


def table_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", "a", 2) for r in rows], SCHEMA)


def test_parse_nested_levels():
    own, quoted, written, n, deepest = q.parse("On Monday Ann wrote:\n> > old words\n> newer words\n> here\n\nmy answer\n >tight")
    assert own == "my answer" and (n, deepest) == (3, 2)
    assert sorted({u["level"] for u in quoted}) == [1, 2] and [u["words"] for u in written] == [2, 2]
    assert q.parse(None) == ("", [], [], 0, 0) and q.parse("a > b")[0] == "a > b"


def test_threads(spark):
    rows = [
        (1, 0, "first question of the thread\nwith a second line"), (1, 1, "> First  question of the thread\n> with a second line\nan answer"),
        (1, 2, "> with a second line\nonly that line"), (1, 3, "> > first question of the thread\n> an answer\nthanks"), (1, 4, "new topic"),
        (1, 5, "> new topic\n> never written\nhm"), (2, 0, "> an answer\nquotes another conversation"), (1, 6, "> later words\nno parent"), (1, 7, "later words"),
        (None, 0, "a null scope"), (None, 1, "> a null scope\nanswered"), (3, None, "no order"), (3, 1, "> no order\nx"), (4, 0, None), (4, 1, ""),
    ]
    got = {(r.scope, r.at): r for r in q.linked_conversations(table_of(spark, rows)).collect()}
    assert len(got) == len(rows)
    parents = {k: r.parent for k, r in got.items() if r.parent is not None}
    assert parents == {(1, 1): 0, (1, 2): 0, (1, 3): 1, (1, 5): 4, (None, 1): 0}
    assert [(got[1, t].root, got[1, t].depth, got[1, t].position) for t in range(8)] == [
        (0, 0, 0), (0, 1, 1), (0, 1, 2), (0, 2, 3), (4, 0, 0), (4, 1, 1), (6, 0, 0), (7, 0, 0)]
    assert got[1, 3].text == "thanks" and got[1, 3].n_linked == 2 and got[4, 0].text == ""


def test_repeats_ties_and_empty(spark):
    rows = [(1, 0, "same words")] * 2 + [(1, 1, "same words"), (1, 2, "> same words\nreply"), (1, 2, "> same words\nreply")]
    got = q.linked_conversations(table_of(spark, rows)).collect()
    assert len(got) == 5 and {r.parent for r in got if r.at == 2} == {0}
    assert sorted(r.position for r in got if r.root == 0) == [0, 1, 2, 3]
    assert q.linked_conversations(table_of(spark, [])).collect() == []


def test_long_chain_and_derived_quotes(spark):
    plain = table_of(spark, [(1, t, f"words of turn number{t} here\nand its other line{t}") for t in range(40)])
    got = {r.at: r for r in q.linked_conversations(q.quoting_messages(plain)).collect()}
    assert {t: r.parent for t, r in got.items() if t} == {t: t - 2 if t % 3 == 2 else t - 1 for t in range(1, 40)}
    assert all(r.root == 0 for r in got.values()) and got[5].text == "words of turn number5 here\nand its other line5"
    depth = {0: 0}
    for t in range(1, 40):
        depth[t] = depth[got[t].parent] + 1
    assert {t: r.depth for t, r in got.items()} == depth


def by_hand(rows):
    """Messages of plain rows, one for one."""
    first = {}
    for c, t, x in rows:
        if t is not None and ((c, t) not in first or (x is not None and (first[c, t] is None or x < first[c, t]))):
            first[c, t] = x
    before = lambda t: t - 2 if t % 3 == 2 else t - 1
    out = []
    for c, t, x in rows:
        own = x or ""
        if t is not None and (c, before(t)) in first:
            near, far = before(t), before(before(t))
            quote = lambda text, mark: mark + (text or "").replace("\n", f"\n{mark}") + "\n"
            own = "On some day someone wrote:\n" + (quote(first[c, far], "> > ") if (c, far) in first else "") + quote(first[c, near], "> ") + own
        out.append((c, t, own))
    return sorted(out, key=str)


def test_messages_of_repeated_and_null_turns(spark):
    rows = [(1, t % 5, f"turn {t % 5} copy {t}\nsecond line") for t in range(50)] + [(2, None, f"null {i}") for i in range(30)]
    rows += [(None, t, f"no conversation {t}") for t in range(4)] + [(3, 0, None), (3, 1, "answers nothing written"), (3, 1, "answers nothing written")]
    got = q.quoting_messages(table_of(spark, rows)).collect()
    assert sorted(((r.conv_id, r.turn, r.text) for r in got), key=str) == by_hand(rows)
    assert len(q.linked_conversations(q.quoting_messages(table_of(spark, rows))).collect()) == len(rows)
    assert q.quoting_messages(table_of(spark, [])).collect() == []
