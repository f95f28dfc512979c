from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from zlib import crc32

import pytest

from talkmill.llm.conversation_tries import as_written, prefix_trie, sharing_starts, turn_rows

SCHEMA = "conv_id long, turn long, role string, text string, path string, words int, depth int, k string, n long, state string"
WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 2, "k", 3, "s") for r in rows], SCHEMA).repartition(4)


def sequences(rows, rebuild):
    """Rows with equal turn numbers carry equal turns in these tests, so their order does not matter."""
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    if not rebuild:
        return own
    out = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]  # as SQL has it for negative ids
    return out


def by_hand(seqs):
    """All nodes from all prefixes, in plain Python."""
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, m in members.items():
        own = (len(m) - 1) * (len(WORD.findall(node[-1][1])) if node else 0)
        for d in range(len(node) + 1):
            saved[node[:d]] += own
            leaves[node[:d]] += not kids[node]
    out = []
    for node, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(node))))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), kids[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(spark, rows, rebuild, container):
    turns = turn_rows(table(spark, rows))
    got = prefix_trie((sharing_starts if rebuild else as_written)(turns), container).drop("turn_id").collect()
    return sorted(map(tuple, got), key=str)


def talk(rng, convs, depth=7, kinds=3):
    return [(c, t, rng.choice(["user", "bot", None]), rng.choice(["hello there", "a b c", "", None, "yes\tno "][:kinds + 1])) for c in range(convs) for t in range(rng.randint(1, depth))]


@pytest.mark.parametrize(("rebuild", "container"), [(True, 1), (False, 5), (True, 40), (False, 4096)])
def test_against_all_prefixes(spark, rebuild, container):
    rng = random.Random(container)
    rows = talk(rng, 130)
    rows += [(c, t, "user", f"same long talk {t}") for c in range(200, 260) for t in range(9)]  # a large group of copies
    rows += [(c, t, "user", f"comb {t}") for c in range(300, 309) for t in range(c - 299)]  # each a start of the next
    rows += [(400, t, "bot", f"turn {t} of a very long one") for t in range(900)]
    rows += [(500, None, "user", "no turn"), (500, 0, None, None), (501, 3, "x", "y"), (501, 3, "x", "y"), (None, 0, "user", "no conversation"), (-7, 0, "u", "negative"), (-7, 1, "u", "b"), (-20, 0, "u", "base")]
    assert made(spark, rows, rebuild, container) == by_hand(sequences(rows, rebuild))


def test_roles_and_texts_do_not_run_together(spark):
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, "1:a", "x"), (4, 0, "", "3:1:ax")]
    assert len(made(spark, rows, False, 4096)) == 5


def test_conversations_without_turns_and_none_at_all(spark):
    # Conversation 3 takes turns from conversation 0, which is absent, in place of its only ones.
    lone = [c for c in range(1, 20) if crc32(str(c).encode()) % 4 >= 1][:2]
    rows = [(c, 0, "u", "only turn") for c in lone]
    want = [(lone[0], 0, None, 2, 0, 1, 0, hashlib.sha256(",".join(map(str, lone)).encode()).hexdigest())]
    assert made(spark, rows, True, 4096) == want == by_hand(sequences(rows, True))
    assert made(spark, [], True, 4096) == []


def test_ids_in_several_pieces(spark, monkeypatch):
    from talkmill.llm import conversation_tries

    monkeypatch.setattr(conversation_tries, "CHUNK", 64)
    rows = [(c, 0, "u", "hot") for c in range(3000)]
    assert made(spark, rows, False, 4096) == by_hand(sequences(rows, False))


def test_turn_id_names_the_last_turn(spark):
    turns = turn_rows(table(spark, [(1, 0, "u", "a"), (1, 1, "b", "c"), (2, 0, "u", "a")]))
    ids = {(r.conv_id, r.turn): r.id for r in turns.collect()}
    for container in (1, 100):
        got = {r.depth: r.turn_id for r in prefix_trie(as_written(turns), container).collect()}
        assert got == {0: None, 1: ids[1, 0], 2: ids[1, 1]}
