"""Keep-first over a stream: many batches, late copies, restarts."""

from __future__ import annotations

import os
import random

from pyspark.sql.streaming import StreamingQueryListener

from talkmill.streaming import jobs as stream

SCHEMA = "id string, at long, n long, batch int"


class Reads(StreamingQueryListener):
    def __init__(self):
        self.rows = []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.rows.append(event.progress.numInputRows)

    def onQueryTerminated(self, event):
        pass


def land(spark, folder, batches, rng, start=0):
    """One file a batch; ids return in later batches, sometimes with an earlier time."""
    made = []
    for b in range(start, start + batches):
        rows = [(None if rng.random() < 0.05 else f"k{rng.randint(0, 40 + b)}", rng.randint(0, 999), b * 100 + i, b) for i in range(30)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        made += rows
        os.sync()
    return made


def first_copies(rows):
    """Per id: of the batch that brings it first, the row with the smallest time."""
    best = {}
    for id_, at, n, b in rows:
        if id_ not in best or (b, at, n) < best[id_]:
            best[id_] = (b, at, n)
    return {id_: n for id_, (_, _, n) in best.items()}


def table(spark, out):
    rows = spark.read.parquet(out).collect()
    assert spark.read.parquet(out).columns == ["id", "at", "n", "batch"]
    assert len({r.id for r in rows}) == len(rows)
    return {r.id: r.n for r in rows}


def test_many_batches_restart_and_constant_reads(spark, tmp_path):
    rng = random.Random(2)
    folder, out, check = (str(tmp_path / x) for x in ("land", "out", "check"))

    def run():
        landed = stream.read_landed(spark, folder, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
        stream.stream_dedup(landed, "id", out, check, ["at", "n"], state_partitions=2)

    rows = land(spark, folder, 25, rng)
    reads = Reads()
    spark.streams.addListener(reads)
    run()
    assert table(spark, out) == first_copies(rows)
    # A batch whose commit was lost is run again and changes nothing.
    commits = os.path.join(check, "batches", "commits")
    last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
    os.remove(os.path.join(commits, last))
    if os.path.exists(os.path.join(commits, f".{last}.crc")):
        os.remove(os.path.join(commits, f".{last}.crc"))
    run()
    assert table(spark, out) == first_copies(rows)
    rows += land(spark, folder, 25, rng, 25)
    run()
    spark.streams.removeListener(reads)
    assert table(spark, out) == first_copies(rows)
    assert reads.rows and max(reads.rows) <= 30
