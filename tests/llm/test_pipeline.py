"""Every stage on a small corpus against brute force, and the whole run."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline as cp
from llm_tables import sentence
from talkmill.llm import fertility
from talkmill.llm.common import table
from test_fertility import plain_base
from test_line_dedup import plain
from test_simhash import plain_fingerprint, plain_groups

BAD = "grim vile rotten foul nasty".split()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(9)
    texts = {i: "\n".join(sentence(rng, rng.randint(15, 30)) for _ in range(5)) for i in range(150)}
    for i in range(0, 150, 5):
        texts[i] += " " + " ".join(rng.choice(BAD) for _ in range(8))
    texts |= {200 + i: texts[i] for i in range(1, 5)}  # exact copies
    shared = sentence(rng, 60)
    texts |= {300 + i: shared + "\n" + sentence(rng, 70) for i in range(5)}  # one long passage in five documents
    texts |= {400: "too short", 401: "", 402: "same words " * 80}
    docs = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(None, None, None, None, None)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i % 5 == 0)) for i in range(0, 150) if i % 7]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_one_by_one(spark, corpus):
    docs = table(spark, corpus, "documents")
    kept = cp.quality_rules(spark, docs, corpus).cache()
    assert kept.columns == docs.columns
    verdict = {r.doc_id for r in fertility.judged(docs, cp.PIECES, cp.RANKS).collect() if r.kept}
    passing = {i for i, t in rows(docs).items() if not plain_base(t)[-1]}
    assert set(rows(kept)) == verdict <= passing and {i for i in passing if i is not None} - verdict == set()

    lines = cp.line_repeats(spark, kept, corpus).cache()
    assert lines.columns == docs.columns
    before, gone = rows(kept), plain(list(rows(kept).items()))
    want = {}
    for i, t in before.items():
        left = "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)
        if left.strip():
            want[i] = left
    assert rows(lines) == want and all(r.n_chars == len(r.text) for r in lines.collect())
    assert sum("\n" not in want[300 + i] for i in range(5)) == 4  # the passage stays once

    # The stage as a whole on texts with copies, which line dedup would have taken before.
    near = cp.near_duplicates(spark, kept, corpus)
    ids = sorted(before)
    groups = plain_groups([plain_fingerprint(before[i]) for i in ids])
    assert set(rows(near)) == {ids[g] for g in groups} and near.columns == docs.columns

    mixed = cp.mixture(spark, lines, corpus)
    left, clean = set(rows(mixed)), {i for i in want if i >= 150 or i % 5}
    assert mixed.columns == docs.columns and len(clean & left) >= 0.97 * len(clean) and len(left - clean) <= 3

    packed = cp.packing(spark, lines, corpus).collect()
    tokens = {}
    for r in packed:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
    assert tokens == {i: len(t.split()) + 1 for i, t in want.items()}


def test_whole_run(spark, corpus):
    out = cp.run(spark, corpus)
    ids = {r.doc_id for r in out.collect()}
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "mixing", "packing"]
    assert not ids & {400, 401, 402, None, 201, 202, 203, 204} and len({i for i in range(150) if i % 5} - ids) <= 4
