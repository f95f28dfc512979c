"""Products written so that half a product is never taken for a whole one.

Every run writes its products into a folder of its own; a manifest row per product, written as one
file when all data is there, is what makes them visible. A run that dies leaves data without a
row: readers do not see it and the products are done again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from talkmill.sources.files import nothing_there, skip_processed

SLUG = "product_slug"
_MANIFEST = "product_slug string, run string, rows bigint, committed_at timestamp"


@contextmanager
def _names_as_text(spark: SparkSession) -> Iterator[None]:
    """Folder names are read as text: a product may be called 007."""
    name = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_products(df: DataFrame, path: str, slug: str = SLUG) -> str:
    """Write the rows of some products and commit them; returns the name of the run.

    A product written before is replaced as a whole.
    """
    spark, run = df.sparkSession, uuid.uuid4().hex
    data = f"{path}/data/run={run}"
    # Rows of a product come together before the write, or every task would write a file per product; hot products are split by size.
    df.hint("rebalance", slug).write.partitionBy(slug).parquet(data)
    with _names_as_text(spark):
        try:
            written = spark.read.parquet(data)
        except AnalysisException as error:
            if not nothing_there(error):
                raise
            return run
    rows = written.groupBy(F.col(slug).alias("product_slug")).agg(F.count("*").alias("rows"))
    manifest = rows.select("product_slug", F.lit(run).alias("run"), "rows", F.current_timestamp().alias("committed_at"))
    # One file: it is there or it is not.
    manifest.repartition(1).write.mode("append").parquet(f"{path}/manifest")
    return run


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The latest commit of every product."""
    try:
        rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as error:
        if not nothing_there(error):
            raise
        return spark.createDataFrame([], _MANIFEST)
    last = F.max_by(F.struct("run", "rows", "committed_at"), F.struct("committed_at", "run"))
    return rows.groupBy("product_slug").agg(last.alias("c")).select("product_slug", "c.*")


def read_products(spark: SparkSession, path: str, slug: str = SLUG) -> DataFrame:
    """Rows of all committed products, each from its latest run."""
    now = committed(spark, path).select(F.col("product_slug").alias("_slug"), F.col("run").alias("_run"))
    runs = [r[0] for r in now.select("_run").distinct().collect()]  # one row a run
    if not runs:
        raise FileNotFoundError(f"no committed products in {path}")
    # Only folders of committed runs are read; their schemas may have grown.
    with _names_as_text(spark):
        data = spark.read.option("basePath", f"{path}/data").option("mergeSchema", "true").parquet(*[f"{path}/data/run={r}" for r in runs])
    mine = (F.col(slug) == F.col("_slug")) & (F.col("run") == F.col("_run"))
    return data.join(now, mine, "left_semi").drop("run")


def still_to_do(incoming: DataFrame, path: str, slug: str = SLUG) -> DataFrame:
    """Incoming rows of products without a commit."""
    return skip_processed(incoming, committed(incoming.sparkSession, path).withColumnRenamed("product_slug", slug), slug)
