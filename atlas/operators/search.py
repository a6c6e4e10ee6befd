"""Exact cosine top-k over chunk embeddings."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import Rounds


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine in double precision; null where either vector is null or has norm zero."""
    return F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def norm(v: Column) -> Column:
    """A vector's length, to be kept beside it where it is asked often."""
    return F.sqrt(_dot(v, v))


def search(chunks: DataFrame, query: list[float], k: int = 10, scope: list | None = None, scope_col: str = "repo_id", vector: str = "embedding", key: str = "id") -> DataFrame:
    """The k rows most similar to query, with a similarity column; nulls last, ties to the smaller key.

    scope None searches every row, an empty scope none. One pass: each task keeps k rows (TakeOrderedAndProject).
    """
    if scope is not None:
        chunks = chunks.where(F.col(scope_col).isin(scope) if scope else F.lit(False))
    q = F.array(*[F.lit(float(x)) for x in query])
    length = sum(float(x) * float(x) for x in query) ** 0.5  # the query's norm is known; a row's is taken once
    similarity = F.try_divide(_dot(F.col(vector), q), norm(F.col(vector)) * F.lit(length))
    return chunks.withColumn("similarity", similarity).orderBy(F.desc_nulls_last("similarity"), key).limit(k)


#: Bytes of queries that go to the rows in one pass, rows of one matrix product, and digits to which equal similarities are told apart.
QUERY_BYTES, ROWS, DIGITS = 32 << 20, 2048, 12


class _Best:
    """The k best (similarity, key) of one query: nulls last, ties to the smaller key."""

    def __init__(self, k: int):
        self.k, self.held = k, []

    def floor(self) -> float:
        return self.held[-1][0] if len(self.held) == self.k else -math.inf

    def add(self, scores: np.ndarray, keys: list) -> None:
        floor = self.floor()
        some = np.flatnonzero(scores >= floor)
        if len(some) > 4 * self.k:  # only these can be among the k best; ties with the last of them stay
            some = some[scores[some] >= np.partition(scores[some], len(some) - self.k)[len(some) - self.k]]
        rows = [(float(scores[i]), keys[i]) for i in some]
        self.held = sorted([*self.held, *rows], key=lambda r: (-r[0], r[1]))[: self.k]


def unit(vectors: list, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of norm 1 as rows, and which of them have a direction: the others are null, of another length, of norm zero or not finite."""
    out, there = np.zeros((len(vectors), dims)), np.zeros(len(vectors), bool)
    for i, v in enumerate(vectors):
        if v is not None and len(v) == dims and None not in v:
            out[i], there[i] = v, True
    with np.errstate(over="ignore", invalid="ignore"):
        length = np.sqrt((out * out).sum(axis=1))
    there &= (length > 0) & np.isfinite(length)
    out[there] /= length[there, None]
    out[~there] = 0
    return out, there


def _scan(asked, k: int, dims: int, vector: str, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, sound = asked.value
        best = [_Best(k) for _ in range(len(ids))]
        schema = None
        for batch in batches:
            schema = schema or pa.schema([("q", pa.int32()), ("key", batch.schema.field(key).type), ("similarity", pa.float64())])
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                keys = part.column(key).to_pylist()
                rows, there = unit(part.column(vector).to_pylist(), dims)
                scores = np.round(matrix @ rows.T, DIGITS)  # equal vectors score the same wherever they stand in a product
                scores[:, ~there] = -2.0  # no similarity: behind all others
                scores[~sound] = -2.0
                for b, mine in zip(best, scores):
                    b.add(mine, keys)
        if schema is not None:
            found = [(i, x, None if s == -2.0 else s) for i, b in enumerate(best) for s, x in b.held]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*found), schema)] if found else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def search_batch(chunks: DataFrame, queries: DataFrame, k: int = 10, vector: str = "embedding", key: str = "id", max_queries: int | None = None) -> DataFrame:
    """query_id, rank, key and similarity of each query's k most similar rows; nulls last, ties to the smaller key.

    queries: query_id (different in each row), query. They go to the rows in passes of QUERY_BYTES (or max_queries), each a written table: a task multiplies a block of rows,
    whose norms are taken once, with all queries of a pass and keeps k rows a query. Similarities that agree to DIGITS digits are equal. A
    vector that is null, of norm zero, not finite or of another length than the query's has a null similarity. Keys must not be null.
    """
    spark = chunks.sparkSession
    rounds = Rounds(spark)
    kind, id_kind = dict(chunks.dtypes)[key], dict(queries.dtypes)["query_id"]
    empty = spark.createDataFrame([], f"query_id {id_kind}, `{key}` {kind}, similarity double")
    done = empty
    length = F.greatest(F.coalesce(F.size("query"), F.lit(0)), F.lit(0))
    for dims, n in sorted((r[0], r[1]) for r in queries.groupBy(length.alias("d")).count().collect()):  # one row for each length of a query
        most = max(1, min(max_queries or n, QUERY_BYTES // (8 * (dims + 1))))
        passes = -(-n // most)
        for p in range(passes):
            mine = queries.where((length == dims) & (F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p)).select("query_id", "query").toPandas()
            ids = mine["query_id"].tolist()
            matrix, sound = unit([None if v is None else list(v) for v in mine["query"]], dims)
            sent = spark.sparkContext.broadcast((list(range(len(ids))), matrix, sound))
            found = rounds.table(chunks.select(key, F.col(vector).cast("array<double>").alias(vector)).mapInArrow(_scan(sent, k, dims, vector, key), f"q int, key {kind}, similarity double"))
            names = spark.createDataFrame(list(enumerate(ids)), f"q int, query_id {id_kind}") if ids else spark.createDataFrame([], f"q int, query_id {id_kind}")
            done = done.unionByName(rounds.table(found.join(names, "q").select("query_id", F.col("key").alias(key), "similarity")))
            sent.destroy()
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), key)
    return done.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", key, "similarity", "rank")
