"""The epoch that validates best is kept; the split has three parts."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from talkmill.operators.epochs import EpochClassifier, three_way_split


def rows_of(rng, n=400):
    words = {"red": "rouge rot rojo".split(), "blue": "bleu blau azul".split(), "green": "vert verde groen".split()}
    out = []
    for i in range(n):
        label = rng.choice(["red", "red", "blue", "green"])
        out.append((i, " ".join([rng.choice(words[label]), *[f"w{rng.randint(0, 30)}" for _ in range(8)]]), label))
    return out


@pytest.fixture(scope="module")
def parts(spark):
    df = spark.createDataFrame([*rows_of(random.Random(4)), (1000, None, "red"), (1001, "no label", None)], "id long, t string, label string")
    return three_way_split(df, "label", "id").cache()


def test_three_parts(parts):
    rows = parts.collect()
    assert len(rows) == 402 and len({r.id for r in rows}) == 402
    n = Counter(r.part for r in rows)
    assert n["test"] == -(-402 * 15 // 100) and n["validation"] == -(-(402 - n["test"]) * 15 // 100)
    for part in ("validation", "test"):
        share = Counter(r.label for r in rows if r.part == part)
        assert all(abs(share[c] - n[part] * sum(r.label == c for r in rows) / 402) <= 1 for c in ("red", "blue", "green"))


def test_best_epoch_is_the_argmax_of_the_log(parts):
    clf = EpochClassifier("t", "label", features=1 << 10, epochs=12, patience=4)
    model = clf.train(parts)
    accuracy = [e["validation_accuracy"] for e in model.log]
    assert [e["epoch"] for e in model.log] == list(range(1, len(model.log) + 1))
    assert model.best_epoch == 1 + int(np.argmax(accuracy)) and max(accuracy) > 0.9
    assert len(model.log) == 12 or len(model.log) - model.best_epoch == 4
    assert model.log[-1]["train_loss"] < model.log[0]["train_loss"]
    # The kept weights give the logged accuracy again, and hold on rows never seen.
    for part, least in (("validation", max(accuracy)), ("test", 0.85)):
        scored = model.predict(parts.where(f"part = '{part}' AND label IS NOT NULL")).collect()
        hits = sum(r.predicted == r.label for r in scored) / len(scored)
        assert hits == pytest.approx(least) if part == "validation" else hits > least
    assert all(0 < r.confidence <= 1 for r in scored)


def test_gradient_is_that_of_the_loss(spark):
    clf = EpochClassifier("t", "label", features=8, epochs=1)
    rng = random.Random(1)
    data = [(True, rng.randint(0, 2), rng.random() + 0.5, [0, rng.randint(1, 7), 8], [0.5, rng.random(), 1.0]) for _ in range(30)]
    stored = spark.createDataFrame(data, "train boolean, y int, w double, index array<int>, value array<float>").repartition(3)
    w = np.random.default_rng(2).normal(size=(9, 3))
    gradient, _, loss = clf._pass(stored, w, 3)
    for f, c in ((0, 0), (8, 1), (3, 2)):
        moved = w.copy()
        moved[f, c] += 1e-5
        assert (clf._pass(stored, moved, 3)[2] - loss) / 1e-5 == pytest.approx(gradient[f, c], abs=1e-4)


def test_one_label_no_validation_and_nothing(spark):
    one = spark.createDataFrame([(i, "a b", "x", "train") for i in range(5)], "id long, t string, label string, part string")
    model = EpochClassifier("t", "label", features=16, epochs=2).train(one)
    assert model.best_epoch == 2 and {r.predicted for r in model.predict(one).collect()} == {"x"}
    assert model.predict(one.limit(0)).collect() == []
    with pytest.raises(ValueError, match="no labelled"):
        EpochClassifier("t", "label").train(one.limit(0))
