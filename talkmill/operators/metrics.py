"""Evaluation of predicted labels. ``by`` groups results, for example per scorer."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F


def _pairs(df: DataFrame, truth: str, pred: str, by: list[str]) -> DataFrame:
    # All later steps see at most one row per (group, truth, prediction).
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def _literal_rows(spark, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def confusion_matrix(df: DataFrame, truth: str, pred: str, labels: list[str]) -> DataFrame:
    """(truth, pred, n) for every pair of listed labels; pairs outside the list are dropped."""
    cells = [(t, p, 0) for t in labels for p in labels]
    grid = _literal_rows(df.sparkSession, cells, "truth string, pred string, n bigint")
    counted = _pairs(df, truth, pred, []).filter(F.col("truth").isin(labels) & F.col("pred").isin(labels))
    return counted.unionByName(grid).groupBy("truth", "pred").agg(F.sum("n").alias("n"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))


def per_label_metrics(df: DataFrame, truth: str, pred: str, labels: list[str], by: list[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per label; empty denominators give 0."""
    by = list(by)
    pairs = _pairs(df, truth, pred, by)
    same = (F.col("truth") == F.col("pred")).cast("bigint") * F.col("n")

    def part(label: Column, tp: Column, predicted: Column, support: Column) -> Column:
        return F.struct(label.alias("label"), tp.alias("tp"), predicted.alias("predicted"), support.alias("support"))

    zero = F.lit(0).cast("bigint")
    empty = [part(F.lit(name), zero, zero, zero) for name in labels]
    parts = F.array(
        part(F.col("truth"), F.coalesce(same, zero), zero, F.col("n")),
        part(F.col("pred"), zero, F.col("n"), zero), *empty,
    )
    sums = (
        pairs.select(*by, F.explode(parts).alias("p")).select(*by, "p.*").filter(F.col("label").isin(labels))
        .groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "predicted", "support")])
    )
    scored = sums.withColumns({
        "precision": _ratio(F.col("tp"), F.col("predicted")), "recall": _ratio(F.col("tp"), F.col("support")),
    })
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)))


def overall_metrics(df: DataFrame, truth: str, pred: str, labels: list[str], by: list[str] = ()) -> DataFrame:
    """Accuracy over all rows and macro means over all listed labels (zero support included)."""
    by = list(by)
    per_label = per_label_metrics(df, truth, pred, labels, by)

    def macro(measure: str) -> Column:
        # Fixed label order keeps the floating-point sum reproducible.
        values = [F.max(F.when(F.col("label") == name, F.col(measure))) for name in labels]
        return reduce(add, values) / len(labels)

    macros = per_label.groupBy(*by).agg(*[macro(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")])
    hit = F.coalesce(F.col("truth") == F.col("pred"), F.lit(False))
    accuracy = _pairs(df, truth, pred, by).groupBy(*by).agg(
        F.try_divide(F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).cast("double"), F.sum("n").cast("double"))
        .alias("accuracy")
    )
    if by:
        return accuracy.join(macros, by)
    return accuracy.select("accuracy", *[macros.select(c).scalar().alias(c) for c in macros.columns])


def per_class_accuracy(confusion: DataFrame) -> DataFrame:
    """(TP + TN) / total per label, from a full confusion grid."""
    parts = F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p"),
                 F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p"),
                 F.lit(0).cast("bigint").alias("tp")),
    )
    sums = confusion.select(F.explode(parts).alias("s")).select("s.*").groupBy("label").agg(
        F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("tp").alias("tp")
    )
    total = F.sum("t").over(Window.partitionBy())  # one row per label
    return sums.select("label", _ratio(total - F.col("t") - F.col("p") + 2 * F.col("tp"), total).alias("accuracy"))


def top_confusions(confusion: DataFrame, n: int = 5) -> DataFrame:
    """Most frequent wrong (truth, pred) pairs."""
    return confusion.filter("truth <> pred AND n > 0").orderBy(F.desc("n"), "truth", "pred").limit(n)


def low_recall(per_label: DataFrame, threshold: float = 0.5) -> DataFrame:
    return per_label.filter(F.col("recall") < threshold)


def best_scorer(overall: DataFrame, name: str = "scorer") -> DataFrame:
    """Scorer with the highest accuracy; ties by name."""
    return overall.select(name, "accuracy").orderBy(F.desc("accuracy"), name).limit(1)


def score_comparison(df: DataFrame, scorers: dict, truth: str, labels: list[str]) -> DataFrame:
    """Metrics of several scorers side by side; a scorer adds a column ``predicted``.

    The rows are read once: all scorers add their column, then one explode.
    """
    names = list(scorers)
    scored = df
    for i, name in enumerate(names):
        scored = scorers[name](scored).withColumnRenamed("predicted", f"_p{i}")
    long = F.array(*[F.struct(F.lit(n).alias("scorer"), F.col(f"_p{i}").alias("predicted")) for i, n in enumerate(names)])
    rows = scored.select(F.col(truth).alias("truth"), F.explode(long).alias("s")).select("truth", "s.*")
    return overall_metrics(rows, "truth", "predicted", labels, ["scorer"])


def compare_metrics(baseline: DataFrame, candidate: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Baseline and candidate metrics joined by key with the difference."""
    b = baseline.select(*keys, F.col(value).alias("baseline"))
    c = candidate.select(*keys, F.col(value).alias("candidate"))
    return b.join(c, keys, "full").withColumn("delta", F.col("candidate") - F.col("baseline"))


def label_share(df: DataFrame, column: str, label: str = "Other") -> DataFrame:
    """Share of rows with one label, in percent."""
    hit = F.count_if(F.col(column) == label)
    return df.agg((F.try_divide(hit.cast("double"), F.count("*").cast("double")) * 100).alias("pct"))


def cv_summary(folds: DataFrame, accuracy: str = "accuracy") -> DataFrame:
    """Mean and population standard deviation over folds."""
    return folds.agg(F.avg(accuracy).alias("mean_accuracy"), F.stddev_pop(accuracy).alias("std_accuracy"))


def fold_accuracy(df: DataFrame, fold: str, truth: str, pred: str) -> DataFrame:
    hit = F.count_if(F.col(truth) == F.col(pred))
    return df.groupBy(fold).agg((hit.cast("double") / F.count("*").cast("double")).alias("accuracy"))
