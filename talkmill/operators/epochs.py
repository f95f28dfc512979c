"""Text classification trained epoch by epoch, keeping the epoch that validates best.

One pass over the stored features gives the gradient on the training rows and the confusion
matrix on the validation rows for the weights of that epoch. The next epoch goes on from these
weights. What leaves a task is bounded by features times labels, whatever the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from talkmill import schemas as S
from talkmill.operators.sampling import class_weights, stratified_split
from talkmill.session import checkpointing, run_dir

TRAIN, VALIDATION, TEST = "train", "validation", "test"


def three_way_split(df: DataFrame, label: str, key: str, test_share: float = 0.15, validation_share: float = 0.15, seed: int = 42) -> DataFrame:
    """Adds ``part``: a stratified test part, then a stratified validation part of what is left."""
    checkpointing(df.sparkSession)
    first = stratified_split(df, label, key, test_share, seed).checkpoint()
    rest = stratified_split(first.where("NOT is_test").drop("is_test"), label, key, validation_share, seed)
    held = first.where("is_test").drop("is_test").withColumn("part", F.lit(TEST))
    return held.unionByName(rest.withColumn("part", F.when(F.col("is_test"), VALIDATION).otherwise(TRAIN)).drop("is_test"))


def hashed_tokens(text: Column, features: int) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)
    return F.transform(found, lambda t: F.pmod(F.xxhash64(t), F.lit(features)).cast("int"))


def weighted_terms(tokens: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and tf-idf values of one text, scaled to length one, with a constant at the end."""
    index, count = np.unique(tokens, return_counts=True)
    value = count * idf[index]
    norm = np.sqrt((value * value).sum())
    return np.append(index, len(idf)).astype(np.int32), np.append(value / norm if norm else value, 1.0).astype(np.float32)


def _flat(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.zeros(len(arrays), np.int64)
    np.cumsum([len(a) for a in arrays[:-1]], out=starts[1:])
    return np.concatenate(arrays), starts


def probabilities(index: list[np.ndarray], value: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    flat, starts = _flat(index)
    scores = np.add.reduceat(weights[flat] * np.concatenate(value)[:, None], starts, axis=0)
    scores = np.exp(scores - scores.max(1, keepdims=True))
    return scores / scores.sum(1, keepdims=True)


@dataclass
class EpochModel:
    """Weights of the best epoch and the log of all epochs."""

    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    text: str
    best_epoch: int = 0
    log: list[dict] = field(default_factory=list)

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``predicted`` and ``confidence``."""
        shared = df.sparkSession.sparkContext.broadcast((self.labels, self.idf, self.weights))

        @F.pandas_udf("predicted string, confidence double")
        def score(tokens: pd.Series) -> pd.DataFrame:
            labels, idf, weights = shared.value
            terms = [weighted_terms(np.asarray(t, np.int64), idf) for t in tokens]
            p = probabilities([i for i, _ in terms], [v for _, v in terms], weights) if len(terms) else np.zeros((0, len(labels)))
            return pd.DataFrame({"predicted": [labels[k] for k in p.argmax(1)] if len(p) else [], "confidence": p.max(1) if len(p) else []})

        scored = df.withColumn("_scored", score(hashed_tokens(F.col(f"`{self.text}`"), len(self.idf))))
        return scored.select(*df.columns, "_scored.predicted", "_scored.confidence")


@dataclass
class EpochClassifier:
    """Multinomial logistic regression on hashed tf-idf; classes are weighted by inverse frequency."""

    text: str = S.CLEANED
    label: str = "aspect_label"
    features: int = 1 << 16
    epochs: int = 10
    patience: int = 3
    rate: float = 0.2
    decay: float = 1e-4

    def _stored(self, df: DataFrame, purpose: str) -> DataFrame:
        at = run_dir(df.sparkSession, purpose)
        df.write.parquet(at)
        return df.sparkSession.read.schema(df.schema).parquet(at)

    def train(self, parts: DataFrame) -> EpochModel:
        """Train on the ``part`` train, choose the epoch with the highest accuracy on validation (the first of equals).

        Stops when ``patience`` epochs in a row were no better. Without validation rows the last
        epoch is kept. Rows without a label are left out.
        """
        spark = parts.sparkSession
        known = parts.where(F.col(self.label).isNotNull() & F.col("part").isin(TRAIN, VALIDATION))
        weights = class_weights(known.where(F.col("part") == TRAIN), self.label)
        labels = sorted(r[0] for r in weights.select(self.label).collect())  # one row a class
        if not labels:
            raise ValueError("no labelled training rows")
        per_class = weights.select(F.col(self.label).alias("_label"), F.col("weight").alias("_weight"))
        number = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(self.label)).cast("int") - 1
        tokens = self._stored(known.join(per_class, F.col(self.label) == F.col("_label")).select(
            (F.col("part") == TRAIN).alias("train"), number.alias("y"), F.col("_weight").alias("w"), hashed_tokens(F.col(f"`{self.text}`"), self.features).alias("tokens")), "tokens")
        rows = tokens.where("train").count()
        counts = tokens.where("train").select(F.explode(F.array_distinct("tokens")).alias("f")).groupBy("f").agg(F.count("*").alias("n")).collect()  # one row a feature
        frequency = np.zeros(self.features)
        frequency[[r["f"] for r in counts]] = [r["n"] for r in counts]
        idf = np.log((rows + 1) / (frequency + 1))

        def with_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                terms = [weighted_terms(np.asarray(t, np.int64), idf) for t in batch.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([i for i, _ in terms], pa.list_(pa.int32())), pa.array([v for _, v in terms], pa.list_(pa.float32()))],
                                                 names=["train", "y", "w", "index", "value"])

        stored = self._stored(tokens.mapInArrow(with_values, "train boolean, y int, w double, index array<int>, value array<float>"), "features")
        model = EpochModel(labels, idf, np.zeros((self.features + 1, len(labels))), self.text)
        return self._epochs(model, stored)

    def _epochs(self, model: EpochModel, stored: DataFrame) -> EpochModel:
        weights = model.weights.copy()
        first, second = np.zeros_like(weights), np.zeros_like(weights)
        best, waited = -1.0, 0
        for epoch in range(self.epochs + 1):
            gradient, confusion, loss = self._pass(stored, weights, len(model.labels))
            total = confusion.sum()
            if epoch:  # the weights before the first step say nothing
                accuracy = float(np.trace(confusion) / total) if total else 0.0
                model.log.append({"epoch": epoch, "validation_accuracy": accuracy, "validation_rows": int(total), "train_loss": loss})
                if accuracy > best or not total:
                    best, waited = accuracy, 0
                    model.best_epoch, model.weights = epoch, weights.copy()
                else:
                    waited += 1
                if waited >= self.patience or epoch == self.epochs:
                    break
            step = epoch + 1
            gradient += self.decay * weights
            first = 0.9 * first + 0.1 * gradient
            second = 0.999 * second + 0.001 * gradient * gradient
            weights -= self.rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
        return model

    @staticmethod
    def _pass(stored: DataFrame, weights: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Gradient and loss on the training rows, confusion matrix on the others, for these weights."""
        shared = stored.sparkSession.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = shared.value
            gradient, confusion, loss = np.zeros_like(w), np.zeros((classes, classes)), np.zeros(classes)
            for batch in batches:
                if not batch.num_rows:
                    continue
                train, y, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                index, value = ([np.asarray(a) for a in batch.column(i).to_pylist()] for i in (3, 4))
                p = probabilities(index, value, w)
                np.add.at(confusion, (y[~train], p[~train].argmax(1)), 1)
                if train.any():
                    error = p.copy()
                    error[np.arange(len(y)), y] -= 1
                    error *= (weight * train)[:, None]
                    flat, _ = _flat(index)
                    np.add.at(gradient, flat, np.concatenate(value)[:, None] * np.repeat(error, [len(i) for i in index], axis=0))
                    loss[0] -= (weight * train * np.log(p[np.arange(len(y)), y] + 1e-12)).sum()
                    if classes > 1:
                        loss[1] += (weight * train).sum()
            hit = np.flatnonzero(gradient.any(1))
            keys = np.concatenate([hit, -1 - np.arange(classes), [-1 - classes]])
            sums = np.concatenate([gradient[hit], confusion, loss[None]])
            for s in range(0, len(keys), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(keys[s:s + 8192], pa.int32()), pa.array(list(sums[s:s + 8192]), pa.list_(pa.float64()))], names=["f", "g"])

        summed = stored.mapInArrow(run, "f int, g array<double>").groupBy("f").agg(F.array(*[F.sum(F.col("g")[i]) for i in range(classes)]).alias("g")).collect()
        shared.unpersist()
        gradient, confusion, loss, weight = np.zeros_like(weights), np.zeros((classes, classes)), 0.0, 0.0
        for r in summed:  # at most a row per feature and label
            if r["f"] >= 0:
                gradient[r["f"]] = r["g"]
            elif r["f"] >= -classes:
                confusion[-1 - r["f"]] = r["g"]
            else:
                loss, weight = r["g"][0], r["g"][1] if classes > 1 else 0.0
        if weight:
            gradient, loss = gradient / weight, loss / weight
        return gradient, confusion, float(loss)
