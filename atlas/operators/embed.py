"""Embedding chunks in Arrow batches, with a limit on requests, retries and a check of the dimension."""

from __future__ import annotations

import hashlib
import math
import time
from collections import deque
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Texts of a request, requests of a minute, tries and first pause, dimension.
BATCH, REQUESTS, PERIOD, TRIES, PAUSE, DIMENSION = 100, 90, 60.0, 5, 10.0, 768


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashedTokens:
    """A local, deterministic stand-in: hashed counts of words, of norm 1. It says nothing about a real model's quality."""

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimension
            for word in (text or "").lower().split():
                v[int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "little") % self.dimension] += 1.0
            norm = math.sqrt(sum(x * x for x in v))
            out.append([x / norm for x in v] if norm else v)
        return out


class Throttle:
    """At most so many calls in any period; a worker that shares a budget with n others gets a part of it."""

    def __init__(self, requests: int = REQUESTS, period: float = PERIOD, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.requests, self.period, self.clock, self.sleep, self.at = max(1, requests), period, clock, sleep, deque()

    def wait(self) -> None:
        while self.at and self.clock() - self.at[0] >= self.period:
            self.at.popleft()
        if len(self.at) >= self.requests:
            self.sleep(max(0.0, self.period - (self.clock() - self.at[0])))
            return self.wait()
        self.at.append(self.clock())


def with_retries(call: Callable[[], list], tries: int = TRIES, pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep) -> list:
    """Tries up to so many times, after pause, twice that and so on, only where the error speaks of a rate limit."""
    for attempt in range(tries):
        try:
            return call()
        except Exception as e:
            if attempt == tries - 1 or not any(x in str(e) for x in ("RESOURCE_EXHAUSTED", "429")):
                raise
            sleep(pause * 2**attempt)
    return []


def share(requests: int, tasks: int, task: int) -> int:
    """The part of a budget that a task of so many gets: whole requests, which add up to the budget."""
    return requests // tasks + (task < requests % tasks)


def embed(chunks: DataFrame, embedder: Embedder, content: str = "content", dimension: int = DIMENSION, requests: int | None = None, workers: int = 1, period: float = PERIOD) -> DataFrame:
    """chunks with an embedding of their content. requests: of all workers in a period (None: no limit); workers: how many share them.

    With a limit the texts are dealt to `workers` barrier tasks, at most one a request of the budget: they run at the same time or not at all, each learns how many there are and takes its
    share, so the sum never passes the budget; a stage that fails begins anew as a whole. Without one each task asks as fast as it can. A vector
    of another dimension raises. Batches of BATCH texts are one request each.
    """
    names = [c for c in chunks.columns if c != "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        throttle = None
        if requests:
            barrier = BarrierTaskContext.get()
            barrier.barrier()
            throttle = Throttle(share(requests, len(barrier.getTaskInfos()), barrier.partitionId()), period)
        for batch in batches:
            vectors = []
            texts = batch.column(content).to_pylist()
            for at in range(0, len(texts), BATCH):

                def call(some=texts[at : at + BATCH]):
                    if throttle:
                        throttle.wait()  # repeated requests count, too
                    return embedder.embed([t or "" for t in some])

                vectors += with_retries(call)
            for v in vectors:
                if len(v) != dimension:
                    raise ValueError(f"a vector has {len(v)} dimensions, not {dimension}")
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(vectors, pa.list_(pa.float32()))], names=[*names, "embedding"])

    mine = chunks.repartition(max(1, min(workers, requests))) if requests else chunks
    return mine.select(*names).mapInArrow(run, T.StructType([*[chunks.schema[n] for n in names], T.StructField("embedding", T.ArrayType(T.FloatType()))]), barrier=bool(requests))
