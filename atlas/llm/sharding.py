"""Sharding by longest-processing-time scheduling: groups of equal texts stay together."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Work

#: Pieces into which ranks within a size and slots within a shard are numbered side by side.
PIECES = 256


def schedule(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Longest first, each group to the least-loaded shard, ties to the smaller number, as a heap gives them.

    histogram: (size, how many groups have it). Returns (size, first rank, last rank + 1, shard).
    The heap deals m groups of size s to the m smallest of all load + j * s. A long run of equal sizes is
    therefore dealt below the highest level that m groups can fill, and only the rest is popped one by one.
    """
    heap = [(0, k) for k in range(shards)]
    out = []
    for size, m in sorted(histogram, reverse=True):
        given = [0] * shards
        if m > 4 * shards:
            low, high = heap[0][0], heap[0][0] + size * m + 1
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if sum(max(0, -((at - mid) // size)) for at, _ in heap) <= m else (low, mid)
            for at, k in heap:
                given[k] = max(0, -((at - low) // size))
            heap = [(at + given[k] * size, k) for at, k in heap]
            heapq.heapify(heap)
        for _ in range(m - sum(given)):
            at, k = heap[0]
            heapq.heapreplace(heap, (at + size, k))
            given[k] += 1
        rank = 0
        for k in range(shards):
            if given[k]:
                out.append((size, rank, rank + given[k], k))
                rank += given[k]
    return out


def shard(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Columns key, size, text_crc32, law, shard, slot, grown_shard; one row per row of docs.

    Sizes are UTF-8 bytes plus one. Groups of equal texts never part; null and empty texts are one group.
    Largest groups go first to the least-loaded shard. Only the histogram of group sizes reaches the driver:
    n different sizes need at least n * n / 2 bytes of text, so 100 TB have under 15 million, and far fewer in practice.
    Equal sizes are ordered by the text's digest; slots are numbered within each shard from 0 without gaps.
    Repeated rows each get a slot. Null keys are kept. An empty table gives no rows. Texts of any length are read whole; columns other than key and text are
    never read, whatever their names.
    """
    spark = docs.sparkSession
    work = Work(spark)
    body = F.coalesce(docs[text], F.lit(""))
    base = work.table(
        docs.select(docs[key].alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("h")),
        "digests",
    )
    groups = work.table(base.groupBy("h").agg(F.sum("size").alias("total")).withColumn("piece", F.pmod(F.xxhash64("h"), F.lit(PIECES))), "groups")
    histogram = [(int(r[0]), int(r[1])) for r in groups.groupBy("total").count().collect()]
    plan = spark.createDataFrame(schedule(histogram, shards), "total long, lo long, hi long, shard int")
    # rank of a group among those of its size: rank in its piece, after all smaller pieces
    by_size = Window.partitionBy("total").orderBy("piece")
    before = groups.groupBy("total", "piece").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(by_size) - F.col("n")).drop("n")
    ranked = groups.withColumn("r", F.row_number().over(Window.partitionBy("total", "piece").orderBy("h")))
    ranked = ranked.join(before, ["total", "piece"]).withColumn("rank", F.col("before") + F.col("r") - 1)
    placed = work.table(ranked.join(plan, (ranked["total"] == plan["total"]) & (ranked["rank"] >= plan["lo"]) & (ranked["rank"] < plan["hi"])).select("h", "shard"), "placed")
    rows = work.table(base.join(placed, "h").withColumn("piece", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(PIECES))).drop("h"), "rows")
    offsets = rows.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    offsets = offsets.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("piece")) - F.col("n")).drop("n")  # at most shards * PIECES rows
    numbered = rows.withColumn("r", F.row_number().over(Window.partitionBy("shard", "piece").orderBy("doc_id", "text_crc32", "size")))
    return numbered.join(F.broadcast(offsets), ["shard", "piece"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("r") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
