from __future__ import annotations

from collections import Counter, defaultdict
from zlib import crc32

from llm_tables import table_of
from talkmill.llm.sharding import shard_by_bytes


def check(got, rows, shards, tolerance):
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, size(t), crc32((t or "").encode())) for i, t, *_ in rows)
    slots, load = defaultdict(list), [0] * shards
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share, widest = sum(load) / shards, max(size(t) for _, t, *_ in rows)
    assert max(abs(x - share) for x in load) <= 2 * (tolerance * share + widest)


def test_odd_rows(odd, odd_rows):
    check(shard_by_bytes(odd, 4).collect(), odd_rows, 4, 0.002)


def test_one_text_holds_most_rows(spark):
    rows = [(i, "hot text of some length" if i % 3 else f"text {i}") for i in range(900)]
    got = shard_by_bytes(table_of(spark, rows), 8, 0.01).collect()
    check(got, rows, 8, 0.01)
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32].add(r.shard)
    cold = [s for c, s in where.items() if c != crc32(b"hot text of some length")]
    assert all(len(s) == 1 for s in cold)


def test_equal_rows_and_empty(spark, none_at_all):
    rows = [(7, "same")] * 50
    assert sorted(r.slot for r in shard_by_bytes(table_of(spark, rows), 2).collect() if r.shard == 0) == list(range(sum(1 for r in shard_by_bytes(table_of(spark, rows), 2).collect() if r.shard == 0)))
    assert shard_by_bytes(none_at_all).collect() == []
