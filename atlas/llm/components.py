"""Connected components of an edge table, all within Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work


def components(edges: DataFrame, work: Work, name: str = "components") -> DataFrame:
    """node and root (the smallest node of its component) for each node of an edge; edges: columns a, b of one type.

    Large-star and small-star steps in turn (Kiveris and others, 2014) until nothing changes: each is a minimum by node with
    partial aggregation and one join. Every round is a written table. Self-edges and repeated edges do no harm.
    """
    now = work.table(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        large = work.table(large, name)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(low, "a")
        small = pairs.select("a", F.col("m").alias("b")).unionByName(pairs.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        then = work.table(small, name)
        work.drop(now, large)
        before, state, now = state, _state(then), then
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]
