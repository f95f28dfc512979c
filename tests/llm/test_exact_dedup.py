from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import duckdb
from hypothesis import given, strategies as st

from llm_tables import table_of
from talkmill.llm import exact_dedup
from talkmill.llm.exact_dedup import RadixTrie, Survivor, exact_duplicates
from talkmill.llm.queries import EXACT_DEDUP_SQL


def brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    out = []
    for text, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1], m[2] or 0))
        for n, (_, _, i) in enumerate(members):
            out.append((i, members[0][2], len(members), n == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_rows(odd, odd_rows):
    assert sorted(map(tuple, exact_duplicates(odd).collect()), key=str) == brute(odd_rows)


def test_small_trie_budget(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "TRIE_BYTES", 600)
    assert sorted(map(tuple, exact_duplicates(odd).collect()), key=str) == brute(odd_rows)


def test_sql_agrees(spark, odd, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None]
    documents = table_of(spark, rows).select("doc_id", "text").toPandas()  # noqa: F841 - read by duckdb
    want = duckdb.sql(EXACT_DEDUP_SQL).fetchall()
    assert sorted(map(tuple, exact_duplicates(table_of(spark, rows)).collect()), key=str) == sorted(want, key=str)


def test_empty(none_at_all):
    assert exact_duplicates(none_at_all).collect() == []


@given(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=60))
def test_trie_counts_keys(keys):
    trie = RadixTrie()
    for i, key in enumerate(keys):
        trie.insert(key, Survivor(1, i, 1))
    assert {k: (s.id, s.n) for k, s in trie.terminals()} == {k: (keys.index(k), keys.count(k)) for k in keys}
