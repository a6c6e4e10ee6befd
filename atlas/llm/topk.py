"""Exact top-k inner products by columnar branch-and-bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Work

#: Components that are added up before candidates are bounded and compacted again.
BLOCK = 16
#: Vectors of one vertical block, and bytes of queries that are compared with the candidates in one pass.
ROWS, QUERY_BYTES = 8192, 32 << 20
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def usable(vector) -> F.Column:
    """Vectors that are there and hold only finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def quantised(vectors: DataFrame, vector: str, key: str) -> DataFrame:
    v = F.col("v")
    return vectors.select(vectors[key].cast("long").alias("vec_id"), vectors[vector].cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(v)).select("vec_id", F.transform(v, lambda x: F.floor(64 * x).cast("double")).alias("v"))


class Vertical:
    """A block of candidates, one array per component, with the norm of what each block of components leaves."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.columns = ids, np.ascontiguousarray(rows.T)
        self.cuts = list(range(0, rows.shape[1], BLOCK)) + [rows.shape[1]]
        self.mass = [np.sqrt((rows[:, c:] ** 2).sum(axis=1)) for c in self.cuts]


def search(block: Vertical, query_id: int, query: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of all candidates that can be among the k best, if only scores of at least floor count.

    After each block of components a candidate's score lies within its partial sum plus or minus
    |rest of the query| * |rest of the candidate| (Cauchy-Schwarz). Whoever can't reach the k-th best lower bound goes.
    """
    alive = np.flatnonzero(block.ids != query_id)
    total = np.zeros(len(alive))
    for a, b, n in zip(block.cuts, block.cuts[1:], range(1, len(block.cuts))):
        columns = block.columns[a:b]
        total = total + query[a:b] @ (columns if len(alive) == len(block.ids) else columns[:, alive])
        rest = float(np.sqrt((query[b:] ** 2).sum())) * block.mass[n][alive] * (1 + 1e-9)
        low = floor
        if len(alive) > k:
            lower = total - rest
            low = max(low, np.partition(lower, len(lower) - k)[len(lower) - k])
        keep = total + rest >= low - 1e-6
        alive, total = alive[keep], total[keep]
    return block.ids[alive], total


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to smaller ids."""
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _scan(queries, k: int, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = queries.value
        held = [(np.zeros(0, np.int64), np.zeros(0)) for _ in ids]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                v = part.column("v")
                block = Vertical(part.column("vec_id").to_numpy(), v.flatten().to_numpy().reshape(len(v), dims))
                for i, (query_id, query) in enumerate(zip(ids, rows)):
                    mine, scores = held[i]
                    floor = scores[-1] if len(scores) == k else -np.inf
                    more, its = search(block, query_id, query, k, floor)
                    if len(more):
                        held[i] = best(np.concatenate([mine, more]), np.concatenate([scores, its]), k)
        for i in range(0, len(ids), 1024):
            some = held[i : i + 1024]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids[i : i + 1024], [len(x) for x, _ in some])), pa.array(np.concatenate([x for x, _ in some])), pa.array(np.concatenate([s for _, s in some]).astype(np.int64))], schema=FOUND
            )

    return run


def topk(vectors: DataFrame, k: int = 20, every: int = 20, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by every, its k highest integer inner products.

    Components become floor(64 * x). Candidates are all rows with another id. Ties go to the smaller vec_id; repeated rows count
    each. Scores are exact up to 2^53; larger ones are rounded as doubles are. Columns other than key and vector are never read. Rows with a null id or vector, or a null or non-finite component, take no part; vectors of different lengths meet only
    their own length. Empty tables give no rows. Queries go to the candidates in passes of QUERY_BYTES at most, so what
    is broadcast stays bounded however many there are; each task keeps k rows a query, and a window merges the tasks' rows.
    """
    spark = vectors.sparkSession
    work = Work(spark)
    rows = quantised(vectors, vector, key)
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    found = None
    # the shape of the query set is counted first: how many passes each length needs
    for dims, n in sorted((r[0], r[1]) for r in asked.groupBy(F.size("v")).count().collect()):
        passes = max(1, -(-n * (dims + 1) * 8 // QUERY_BYTES))
        for p in range(passes):
            mine = asked.where((F.size("v") == dims) & (F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p)).toPandas()
            mine = mine.drop_duplicates("vec_id") if mine["vec_id"].is_unique else _apart(mine)
            queries = spark.sparkContext.broadcast((mine["vec_id"].to_numpy(np.int64), np.array(list(mine["v"]), float).reshape(len(mine), dims)))
            part = rows.where(F.size("v") == dims).mapInArrow(_scan(queries, k, dims), "query_id long, vec_id long, score long")
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return work.table(found, "found").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _apart(queries: pd.DataFrame) -> pd.DataFrame:
    """Rows that repeat an id ask once if their vectors agree; otherwise the smallest vector asks."""
    return queries.assign(t=[tuple(v) for v in queries["v"]]).sort_values(["vec_id", "t"]).drop_duplicates("vec_id").drop(columns="t")


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT score FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM p)
SELECT query_id, rank::INT rank, vec_id, score FROM r WHERE rank <= 20
"""
