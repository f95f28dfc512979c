"""Reproducible samples, splits and resampling; every random choice is an md5 of seed and id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from talkmill import schemas as S
from talkmill.functions.text import preview
from talkmill.operators.cleaning import browse
from talkmill.operators.ranking import first_rows, hash_key, rank_by_hash
from talkmill.operators.ranks import value_at, value_counts_of, with_running_totals

_PLACE = "_place"


def random_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (fewer when the table is smaller)."""
    return df.withColumn(_PLACE, hash_key(F.col(key), seed)).orderBy(_PLACE, key).limit(n).drop(_PLACE)


def shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """The whole table in random order (a range-partitioned sort)."""
    return df.withColumn(_PLACE, hash_key(F.col(key), seed)).orderBy(_PLACE, key).drop(_PLACE)


def quota_choice(df: DataFrame, key: str, sample_size: int, seed: int = 42, product: str = "product_query") -> DataFrame:
    """(key, sample_order) of a product-balanced sample; ``key`` must be unique.

    Every product gets target // products rows, the first products alphabetically one more,
    limited by what they have; the shortfall is filled from the rows left over.
    """
    if sample_size < 1:
        raise ValueError("a sample needs a positive size")
    slim = df.select(F.col(key).alias("k"), F.col(product).cast("string").alias("p"), hash_key(F.col(key), seed).alias("h"))
    sizes = slim.groupBy("p").agg(F.count("*").alias("size"))
    named = Window.partitionBy(F.isnull("p"))  # one row per product
    target = F.least(F.lit(sample_size).cast("bigint"), F.sum("size").over(Window.partitionBy()))
    count, place = F.count("*").over(named), F.row_number().over(named.orderBy("p"))
    base = F.floor(target / count)
    quotas = sizes.withColumn(
        "quota",
        F.when(F.isnull("p"), F.lit(0)).otherwise(
            F.least(base + (place <= target - base * count).cast("bigint"), F.col("size"))
        ),
    )
    # No row beyond rank sample_size of its product can be chosen, by quota or as filler.
    candidates = first_rows(slim, ["p"], [F.col("h"), F.col("k")], sample_size, rank="r")
    q = quotas.select(F.col("p").alias("qp"), "quota")
    placed = candidates.join(q, F.col("p").eqNullSafe(F.col("qp")))
    # Chosen rows first, then the fillers in hash order: the first target rows are the sample.
    spare = (F.col("r") > F.col("quota")).cast("int")
    picked = placed.select("k", "h", spare.alias("spare")).orderBy("spare", "h", "k").limit(sample_size)
    order = Window.partitionBy().orderBy(hash_key(F.col("k"), f"{seed}:shuffle"), "k")  # <= sample_size rows
    return picked.select(F.col("k").alias(key), F.row_number().over(order).alias("sample_order"))


def balanced_sample(df: DataFrame, key: str, sample_size: int = 300, seed: int = 42, product: str = "product_query") -> DataFrame:
    """Product-balanced sample of whole rows in shuffled order."""
    if sample_size < 1:
        raise ValueError("a sample needs a positive size")
    if product not in df.columns:
        return random_sample(df, key, sample_size, seed)
    choice = quota_choice(df, key, sample_size, seed, product)
    return df.join(choice, key).orderBy("sample_order").drop("sample_order")


def per_class_cap(df: DataFrame, label: str, key: str, n: int = 150) -> DataFrame:
    """At most ``n`` rows per class, by id."""
    return first_rows(df, [label], [F.col(key)], n)


def accept_confident(df: DataFrame, label: str = "pseudo_aspect", confidence: str = "confidence",
                     other: float = 0.95, rest: float = 0.85) -> DataFrame:
    """Rows above a threshold that is stricter for Other."""
    threshold = F.when(F.col(label) == "Other", other).otherwise(rest)
    return df.filter(F.col(confidence) >= threshold)


def browse_sample(df: DataFrame, key: str, likes: int, pool: int = 15, n: int = 10, seed: int = 42, text: str = S.CLEANED) -> DataFrame:
    """A pool of well-liked comments drawn first, then the ones shown, drawn from the pool."""
    drawn = random_sample(browse(df, likes), key, pool, seed)
    return random_sample(drawn, key, n, seed).withColumn("shown", preview(F.col(text), 200))


def remainder_except(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not chosen."""
    return df.join(chosen.select(key), key, "left_anti")


def stratified_split(df: DataFrame, label: str, key: str, test_share: float = 0.15, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: ceil(share * rows) test rows, spread over labels by largest remainder."""
    sizes = df.groupBy(label).agg(F.count("*").alias("size"))
    everything = Window.partitionBy()  # one row per label
    total = F.sum("size").over(everything)
    wanted = F.ceil(total * F.lit(test_share))
    share = F.col("size") * wanted / total
    floors = sizes.withColumns({"wanted": wanted, "whole": F.floor(share), "part": share - F.floor(share)})
    left = F.col("wanted") - F.sum("whole").over(everything)
    order = F.row_number().over(Window.partitionBy().orderBy(F.desc("part"), label))
    allotted = floors.select(
        F.col(label).alias("_l"), (F.col("whole") + (order <= left).cast("bigint")).alias("_take")
    )
    ranked = rank_by_hash(df, [label], key, seed)
    joined = ranked.join(allotted, F.col(label).eqNullSafe(F.col("_l")))
    return joined.select(*df.columns, (F.col("hash_rank") <= F.col("_take")).alias("is_test"))


def stratified_kfold(df: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold``: rows of every label dealt round robin in hash order."""
    ranked = rank_by_hash(df, [label], key, seed)
    return ranked.select(*df.columns, F.pmod(F.col("hash_rank") - 1, F.lit(folds)).cast("int").alias("fold"))


def random_oversample(df: DataFrame, label: str, key: str, exclude: list[str] = (), seed: int = 42,
                      target: int | None = None, chunk: int = 1000) -> DataFrame:
    """Every class up to the largest one by repeating rows, flagged ``is_oversampled``.

    Copies are dealt evenly in hash order. A rare row may need millions of copies, so it is
    first split into chunks that are spread over the cluster and only then multiplied.
    """
    ranked = rank_by_hash(df, [label], key, seed)
    goal = F.lit(target).cast("bigint") if target else (
        df.groupBy(label).agg(F.count("*").alias("n")).agg(F.max("n")).scalar()
    )
    missing = F.greatest(goal - F.col("group_total"), F.lit(0))
    if exclude:
        missing = F.when(F.col(label).isin(list(exclude)), F.lit(0)).otherwise(missing)
    copies = F.floor(missing / F.col("group_total")) + (
        F.col("hash_rank") <= F.pmod(missing, F.col("group_total"))
    ).cast("bigint")
    counted = ranked.withColumn("_copies", copies)
    extra = counted.filter("_copies > 0").withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_copies") - 1) / chunk)))
    )
    spread = extra.repartition(key, "_chunk").withColumn(
        "_copy", F.explode(F.sequence(
            F.col("_chunk") * chunk, F.least(F.col("_copies"), (F.col("_chunk") + 1) * chunk) - 1
        ))
    )
    originals = df.withColumn("is_oversampled", F.lit(False))
    return originals.unionByName(spread.select(*df.columns, F.lit(True).alias("is_oversampled")))


def distribution_change(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """Class sizes before and after resampling and their ratio."""
    b = before.groupBy(label).agg(F.count("*").alias("n_before"))
    a = after.groupBy(label).agg(F.count("*").alias("n_after"))
    return b.join(a, label, "full").withColumn("ratio", F.col("n_after") / F.col("n_before"))


def class_weights(df: DataFrame, label: str, labels: list[str] | None = None) -> DataFrame:
    """Inverse-frequency weights scaled to sum to the number of classes.

    With a list of ``labels`` all of them and no others get a weight; one without rows counts as one row.
    """
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    if labels is not None:
        every = df.sparkSession.createDataFrame([(x,) for x in labels], f"`{label}` string")
        counts = every.join(counts, label, "left").select(label, F.coalesce("n", F.lit(1)).alias("n"))
    everything = Window.partitionBy()  # one row per label
    # Exact: weight = (1/n) / sum(1/n) * classes.
    ordered = Window.partitionBy().orderBy(label).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inverse = F.lit(1.0) / F.col("n")
    return counts.select(
        label, "n", (inverse / F.sum(inverse).over(ordered) * F.count("*").over(everything)).alias("weight")
    )


def weight_stats(df: DataFrame, weight: str) -> DataFrame:
    """Minimum, maximum and upper median (element n // 2 of the sorted weights), whatever their number."""
    totals = with_running_totals(value_counts_of(df, F.col(weight)))
    return totals.agg(F.min("value").alias("min_weight"), F.max("value").alias("max_weight"), value_at(F.floor(F.col("total") / 2)).alias("upper_median"))
