"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import drop_path, written


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """edges (a, b) -> node, root: the smallest node that node reaches; nodes without an edge don't appear.

    Large star: a node's larger neighbours go to its smallest one; small star: so do the
    smaller ones. Neither collects a neighbourhood: minima are aggregated and joined back. Rounds
    grow with the logarithm of the nodes; each is written to the shared folder.
    """
    now, path = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.greatest("b", "m").alias("x"), F.least("b", "m").alias("y"), "a", "m")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("x").alias("a"), F.col("y").alias("b"))).where("a != b").distinct()
        after, new = written(small, "edges")
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_path(edges.sparkSession, path)
        now, path = after, new
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
    raise RuntimeError(f"no end after {most} rounds")
