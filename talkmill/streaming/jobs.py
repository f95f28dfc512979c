"""Incremental ingestion of landed files and streaming duplicate removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from talkmill import schemas as S
from talkmill.operators.cleaning import preprocess_comments
from talkmill.operators.dedup import keep_first
from talkmill.operators.language_audit import add_detected_language


def read_landed(spark: SparkSession, directory: str, schema: T.StructType, pattern: str = "*.parquet",
                files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch).parquet(directory)
    )


def detect_clean_filter(comments: DataFrame, text: str = S.TEXT) -> DataFrame:
    """The stateless steps of the batch job; works on streams and tables alike."""
    return preprocess_comments(add_detected_language(comments, text), text)


def run_available(stream: DataFrame, out: str, checkpoint: str, partition_by: list[str] = ()) -> None:
    """Append everything available to a Parquet table exactly once, then stop.

    The checkpoint remembers processed files, so a rerun takes only new ones.
    """
    writer = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True)
    )
    (writer.partitionBy(*partition_by) if partition_by else writer).start().awaitTermination()


def incremental_ingest(comments: DataFrame, out: str, checkpoint: str, text: str = S.TEXT,
                       partitions: int | None = None) -> None:
    """Batches of few large files can be spread over ``partitions`` tasks before the text work."""
    spread = comments if partitions is None else comments.repartition(partitions)
    run_available(detect_clean_filter(spread, text), out, checkpoint)


def _key_state(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB: on disk, read by key, not held in memory."""
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_dedup(stream: DataFrame, key: str, out: str, checkpoint: str, order: list[str] = (), state_partitions: int | None = None) -> None:
    """Append the first copy of every key to a table exactly once, however late it comes.

    Two steps per batch. First the batch keeps its first row per key (by ``order``) and lands it in
    a folder of its own, which a repeated batch overwrites. Then a second query takes what has
    landed and drops keys it has seen before: its state holds the keys alone, in RocksDB, so a
    batch costs the same however much has been written, and there is no watermark to fall behind.
    A batch that is run again after a failure lands rows whose keys are in the state already.
    ``state_partitions`` is fixed by the first run of a checkpoint; a null key is a key.
    """
    spark, schema = stream.sparkSession, stream.schema
    _key_state(spark)
    landed = f"{checkpoint}/firsts"

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        keep_first(batch, key, [F.col(c) for c in order or [c for c in batch.columns if c != key]]).write.mode("overwrite").parquet(f"{landed}/{number:012d}")
        fresh = session.readStream.schema(schema).option("recursiveFileLookup", "true").option("cleanSource", "delete").parquet(landed).dropDuplicates([key])
        fresh.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{checkpoint}/keys").option("path", out).trigger(
            availableNow=True).start().awaitTermination()

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        if state_partitions is not None:
            spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/batches").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
