"""A translation memory: every different text is translated once per language code.

The memory is a table of (digest, code, translation) below a shared folder. A run asks it for
the different texts at hand, translates what it lacks, adds what succeeded, and joins the results
back to the rows. Copies, and texts of earlier runs, cost no call.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from talkmill import schemas as S
from talkmill.operators.translation import CODE, FAILED, TRANSLATION, translate_with
from talkmill.session import run_dir
from talkmill.sources.files import nothing_there

_SCHEMA = "_digest binary, _code string, _translation string"


def remembered(spark: SparkSession, memory: str) -> DataFrame:
    """The translations a memory holds, one row per digest and code."""
    try:
        rows = spark.read.schema(_SCHEMA).parquet(f"{memory}/run=*")
    except AnalysisException as error:
        if not nothing_there(error):
            raise
        return spark.createDataFrame([], _SCHEMA)
    # Two runs at a time may add the same text; the smaller translation stands, whoever reads.
    return rows.groupBy("_digest", "_code").agg(F.min("_translation").alias("_translation"))


def translate_once(df: DataFrame, translate: Callable[[list[str], str], list[str]], memory: str, text: str = S.TEXT, batch_size: int = 16) -> DataFrame:
    """Adds ``translation`` and ``translation_failed`` as :func:`translate_with` does, with one call per text and code.

    A failing batch keeps its original texts, is marked, and is not remembered: the next run tries
    again. Rows without a code get neither a call nor a result. Null texts count as empty. A
    text that is in most rows travels once; the join with the results is split by Spark where it is hot.
    """
    spark = df.sparkSession
    keyed = df.withColumns({"_digest": F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)), "_code": F.col(CODE)})
    wanted = keyed.where("_code IS NOT NULL").groupBy("_digest", "_code").agg(F.first(F.coalesce(F.col(text), F.lit(""))).alias(text))
    known = remembered(spark, memory)
    missing = wanted.join(known, ["_digest", "_code"], "left_anti").withColumn(CODE, F.col("_code"))
    at = run_dir(spark, "translated")
    translate_with(missing, translate, text, batch_size).select("_digest", "_code", F.col(TRANSLATION).alias("_translation"), F.col(FAILED).alias("_failed")).write.parquet(at)
    new = spark.read.parquet(at)
    good = new.where("NOT _failed").drop("_failed")
    if not good.isEmpty():
        good.write.parquet(f"{memory}/run={uuid.uuid4().hex}")
    # Old translations and new ones do not overlap: what was known was not asked for again.
    old = known.join(wanted.select("_digest", "_code"), ["_digest", "_code"], "left_semi").join(new.select("_digest", "_code"), ["_digest", "_code"], "left_anti")
    results = old.withColumn("_failed", F.lit(False)).unionByName(new)
    joined = keyed.join(results, ["_digest", "_code"], "left")
    return joined.select(*df.columns, F.col("_translation").alias(TRANSLATION), F.coalesce("_failed", F.lit(False)).alias(FAILED))
