from __future__ import annotations

import random

from pyspark.sql import functions as F

from llm_tables import sentence, table_of
from talkmill.llm import mixing

LABELS = "doc_id long, quality int, toxic int"


def labelled(spark, n=400):
    rng = random.Random(4)
    bad = "grim vile rotten foul".split()
    rows, labels = [], []
    for i in range(n):
        text = sentence(rng, 60)
        toxic = i % 5 == 0
        if toxic:
            text += " " + " ".join(rng.choice(bad) for _ in range(6))
        rows.append((i, text))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    return rows, spark.createDataFrame(labels, LABELS)


def reached(rates, names):
    mass = {k: sum(r.rate * r.n_tokens * r.n_copies * r[f"p_{k}"] for r in rates) for k in names}
    return {k: v / sum(mass.values()) for k, v in mass.items()}


def test_targets_are_met_and_unlabelled_documents_classified(spark):
    rows, labels = labelled(spark)
    rates, fit = mixing.soft_mixture(table_of(spark, rows), labels, {"good": 0.5, "toxic": 0.5})
    rates = rates.collect()
    got = reached(rates, ["good", "toxic"])
    assert abs(got["good"] - 0.5) < 0.01 and all(r.rate >= 0 for r in rates)
    unseen = [r for r in rates if r.id % 2]
    right = sum((r.p_toxic > 0.5) == (r.id % 5 == 0) for r in unseen)
    assert right >= 0.95 * len(unseen)
    assert sum(fit["target"]) > 0


def test_upper_bound_and_draw(spark):
    rows, labels = labelled(spark)
    docs = table_of(spark, rows)
    domains = {"toxic": F.col("toxic") == 1, "clean": F.col("toxic") == 0}
    rates, _ = mixing.soft_mixture(docs, labels, {"clean": 1.0, "toxic": 0.0}, top=1.0, domains=domains)
    assert all(0 <= r.rate <= 1 and r.n_drawn in (0, 1) for r in rates.collect())
    kept = mixing.drawn(docs, rates)
    ids = {r.doc_id for r in kept.collect()}
    clean = {i for i, _ in rows if i % 5}
    assert kept.columns == docs.columns and len(clean & ids) >= 0.97 * len(clean) and len(ids - clean) <= 0.1 * len(rows) / 5


def test_projected_gradient_against_plain_steps(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        p = rng.random()
        rows.append((i, 1, rng.randint(1, 50), round(p, 9), round(1 - p, 9)))
    df = spark.createDataFrame(rows, "id long, n_copies long, n_tokens long, p0 double, p1 double")
    got, fit = mixing.fit_rates(df, [0.8, 0.2], steps=25, tolerance=0.0)
    rate = [1.0] * 60
    total = lambda k: sum(r[2] * x * r[3 + k] for r, x in zip(rows, rate))
    start = [total(0), total(1)]
    target = [0.8 * sum(start), 0.2 * sum(start)]
    for _ in range(25):
        off = [(total(k) - target[k]) / start[k] for k in (0, 1)]
        rate = [max(0.0, x - r[3] * off[0] - r[4] * off[1]) for r, x in zip(rows, rate)]
    have = {r.id: r.rate for r in got.collect()}
    assert all(abs(have[i] - rate[i]) < 1e-3 for i in range(60))
    assert abs(fit["reached"][0] - total(0)) < 0.05


def test_odd_rows_no_labels_and_empty(spark, odd, odd_rows, none_at_all):
    no_labels = spark.createDataFrame([], LABELS)
    rates, _ = mixing.soft_mixture(odd, no_labels, {"good": 0.9, "toxic": 0.1})
    rows = rates.collect()
    assert sum(r.n_copies for r in rows) == len(odd_rows)
    assert len({(r.p_good, r.p_toxic) for r in rows}) == 1
    tokens = {(r.id, r.n_tokens) for r in rows}
    assert {(i, len((t or "").encode().split()) + 1) for i, t, *_ in odd_rows} == tokens
    assert mixing.soft_mixture(none_at_all, no_labels, {"good": 1.0})[0].collect() == []
    repeated = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, None), (None, 1, 1), (999, 1, 1)], LABELS)
    assert mixing.soft_mixture(odd, repeated, {"good": 0.9, "toxic": 0.1})[0].count() == len(rows)
