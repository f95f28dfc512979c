"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from talkmill.llm.common import staged


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge to another; the root is the smallest node.

    Every round each node points to its smallest neighbour, if smaller; pointers are followed twice and
    edges are renamed to what their ends point to, without loops and repeats. The number of nodes
    with edges at least halves. Each round's tables are written to the shared folder.
    """
    spark = edges.sparkSession
    left = staged(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct(), "edges")
    roots: DataFrame | None = None
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        to = staged(
            both.groupBy("node").agg(F.min("other").alias("to")).select("node", F.least("node", "to").alias("to")), "pointers",
        )
        for _ in range(2):
            onward = to.select(F.col("node").alias("to"), F.col("to").alias("_further"))
            to = to.join(onward, "to").select("node", F.col("_further").alias("to"))
        to = staged(to, "pointers")
        if roots is None:
            roots = to.select("node", F.col("to").alias("root"))
        else:
            # Nodes that were merged earlier follow their root; roots without edges stay.
            onward = to.select(F.col("node").alias("root"), "to")
            roots = staged(roots.join(onward, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        new_a = to.select(F.col("node").alias("a"), F.col("to").alias("_a"))
        new_b = to.select(F.col("node").alias("b"), F.col("to").alias("_b"))
        renamed = left.join(new_a, "a").select("_a", "b").join(new_b, "b").select("_a", "_b")
        left = staged(
            renamed.filter("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "edges",
        )
    if roots is None:
        kind = left.schema["a"].dataType.simpleString()
        return spark.createDataFrame([], f"node {kind}, root {kind}")
    return roots
