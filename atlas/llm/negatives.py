"""Hard negatives by bit-sliced integer products: the bit-planes of the components, most significant first, tighten each score's interval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Work
from .topk import usable

#: Vectors of one block, and bytes of anchors that are compared with all rows in one pass.
ROWS, ANCHOR_BYTES = 8192, 32 << 20
#: Scores are cut off at these ends of a long.
LEAST, MOST = -(1 << 63), (1 << 63) - 1
FOUND = "anchor_id long, band int, positive_id long, positive_score long, vec_id long, score long"
_ARROW = pa.schema([("anchor_id", pa.int64()), ("band", pa.int32()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Sliced:
    """A block of vectors as bit-planes, one matrix (component, vector) of 0 and 1 for each bit of the two's complement.

    A component is the sum of weight * bit, where the highest bit weighs -2^(bits - 1) and every other one 2^b.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.ids, self.labels = ids, labels
        columns = np.ascontiguousarray(rows.T)
        most = max(int(columns.max()), -1 - int(columns.min()), 0) if columns.size else 0
        self.bits = most.bit_length() + 1
        self.planes = [((columns >> np.int64(b)) & 1).astype(np.float32) for b in range(self.bits)]


class Anchor:
    """A query vector with what its remaining planes can still add, and the bands of scores that are asked of it.

    Each band is (lowest score, highest score) with the number, id and score of its positive; the k best rows within it are kept.
    """

    def __init__(self, vec_id: int, label: int, vector: np.ndarray, bands: list[tuple], k: int):
        self.vec_id, self.label, self.bands, self.k = vec_id, label, bands, k
        whole = [int(x) for x in vector]
        self.up, self.down = sum(x for x in whole if x > 0), sum(x for x in whole if x < 0)
        reach = self.up - self.down
        # each plane's product is exact in the narrowest type that holds the sum of all components
        self.vector = np.array(whole, np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else object)
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in bands]

    def floor(self, band: int) -> int:
        """The lowest score that still counts: the band's end, or the k-th best score so far."""
        scores = self.best[band][1]
        return max(self.bands[band][0], int(scores[-1])) if len(scores) == self.k else self.bands[band][0]

    def sift(self, block: Sliced, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the block's vectors that can be among the k best of any band.

        After the planes down to bit b a score lies between its sum so far plus (2^b - 1) times the negative components and the same
        plus (2^b - 1) times the positive ones. A vector goes once its interval lies beyond all bands, or below the k-th
        highest lower end of those whose intervals lie within a band.
        """
        wide = (self.up - self.down) << block.bits >= 1 << 62
        total = np.zeros(len(alive), object if wide else np.int64)
        for b in range(block.bits - 1, -1, -1):
            plane = block.planes[b] if len(alive) == len(block.ids) else block.planes[b][:, alive]
            product = self.vector @ plane
            product = product.astype(np.int64).astype(object) if wide and product.dtype != object else product.astype(total.dtype)
            total = total + product * (-(1 << b) if b == block.bits - 1 else 1 << b)
            rest = (1 << b) - 1
            low, high = total + self.down * rest, total + self.up * rest
            if wide:
                low, high = np.clip(low, LEAST, MOST), np.clip(high, LEAST, MOST)
            keep = np.zeros(len(alive), bool)
            for i, (least, most, *_) in enumerate(self.bands):
                least = self.floor(i)
                within = low[(low >= least) & (high <= most)]
                if len(within) >= self.k:
                    least = max(least, int(np.sort(within)[-self.k] if wide else np.partition(within, len(within) - self.k)[len(within) - self.k]))
                keep |= ((high >= least) & (low <= most)).astype(bool)
            if not keep.all():
                alive, total = alive[keep], total[keep]
            if not len(alive):
                break
        if wide:
            total = np.clip(total, LEAST, MOST).astype(np.int64)
        return alive, total

    def meet(self, block: Sliced, same: bool) -> None:
        """Takes the block's vectors of the same label (but the anchor's own id), or of other labels, into its bands."""
        alive = np.flatnonzero(((block.labels == self.label) == same) & (block.ids != self.vec_id))
        if not len(alive):
            return
        alive, scores = self.sift(block, alive)
        ids = block.ids[alive]
        for i, (least, most, *_) in enumerate(self.bands):
            inside = (scores >= least) & (scores <= most)
            mine, its = np.concatenate([self.best[i][0], ids[inside]]), np.concatenate([self.best[i][1], scores[inside]])
            order = np.lexsort((mine, -its if LEAST not in its else [-int(x) for x in its]))[: self.k]
            self.best[i] = mine[order], its[order]

    def found(self) -> Iterator[tuple]:
        for i, (_, _, positive, score) in enumerate(self.bands):
            for vec_id, its in zip(*self.best[i]):
                yield self.vec_id, i, positive, score, int(vec_id), int(its)


def bands(scores: list[tuple[int, int]], low: int, high: int) -> list[tuple[int, int, int, int]]:
    """For each (positive_id, positive_score) the scores s with low * positive_score <= 100 * s <= high * positive_score, as whole numbers."""
    return [(max(-(-low * s // 100), LEAST), min(high * s // 100, MOST), i, s) for i, s in scores]


def _scan(asked, dims: int, k: int, same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = [Anchor(*a, k) for a in asked.value]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = part.column("v").flatten().to_numpy().reshape(part.num_rows, dims)
                block = Sliced(part.column("vec_id").to_numpy(), part.column("label").to_numpy(), rows)
                for anchor in anchors:
                    anchor.meet(block, same)
        held = [row for a in anchors for row in a.found()]
        for at in range(0, len(held), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held[at : at + (1 << 16)]), _ARROW)], schema=_ARROW)

    return run


def mine(vectors: DataFrame, label: Column, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank: the hardest negatives of each anchor and positive.

    Components become floor(256 * x), cut off at the ends of a long; a score is the integer inner product, exact, cut off in the same way. Anchors are the rows
    whose key is divisible by every. An anchor's positives are its first rows with its label and another key, by score, ties to the
    smaller key. Of the rows with another label and low * positive_score <= 100 * score <= high * positive_score the first ones are returned.

    Rows with a null key, label or vector, or a null or non-finite component, take no part; vectors meet only those of their own
    length. Repeated rows count each, as positives and negatives; a key that several rows have asks once, with the smallest label
    and vector. An empty vector has the score 0 with every other. Other columns are never read. An empty table, and anchors without
    a positive, give no rows.

    All rows are scanned twice for each pass of ANCHOR_BYTES of anchors: for the positives, and for the negatives within the bands that these
    set. A task holds at most `negatives` rows for each band; windows merge the tasks' rows. Each pass ends as a written table.
    """
    spark = vectors.sparkSession
    work = Work(spark)
    v = F.col("v")
    rows = vectors.select(vectors[key].cast("long").alias("vec_id"), label.cast("long").alias("label"), vectors[vector].cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(v)).withColumn("v", F.transform(v, lambda x: F.floor(256 * x)))
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    done = []
    for dims, n in sorted((r[0], r[1]) for r in asked.groupBy(F.size("v")).count().collect()):  # one row for each length of a vector
        passes = max(1, -(-n * (dims + 1) * 8 // ANCHOR_BYTES))
        mates = rows.where(F.size("v") == dims)
        for p in range(passes):
            of = asked.where((F.size("v") == dims) & (F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p))
            anchors = sorted(_apart(of.toPandas()))
            sent = spark.sparkContext.broadcast([(i, y, x, [(LEAST, MOST, 0, 0)]) for i, y, x in anchors])
            best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
            found = work.table(mates.mapInArrow(_scan(sent, dims, positives, True), FOUND), "positives").withColumn("r", F.row_number().over(best)).where(F.col("r") <= positives)
            ranked: dict[int, list[tuple[int, int]]] = {}
            for r in found.select("anchor_id", "r", "vec_id", "score").orderBy("anchor_id", "r").toPandas().itertuples(index=False):
                ranked.setdefault(int(r.anchor_id), []).append((int(r.vec_id), int(r.score)))
            sent.destroy()
            sent = spark.sparkContext.broadcast([(i, y, x, bands(ranked[i], low, high)) for i, y, x in anchors if i in ranked])
            done.append(work.table(mates.mapInArrow(_scan(sent, dims, negatives, False), FOUND), "negatives"))
            sent.destroy()
    found = spark.createDataFrame([], FOUND)
    for part in done:
        found = found.unionByName(part)
    order = Window.partitionBy("anchor_id", "band").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), (F.col("band") + 1).alias("positive_rank"))


def _apart(anchors: pd.DataFrame) -> list[tuple]:
    """vec_id, label, vector; of rows with one vec_id the smallest label and vector."""
    best: dict[int, tuple] = {}
    for vec_id, label, vector in zip(anchors["vec_id"], anchors["label"], anchors["v"]):
        mine = (int(label), tuple(int(x) for x in vector))
        best[int(vec_id)] = min(best.get(int(vec_id), mine), mine)
    return [(i, *x) for i, x in best.items()]


ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END y, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id anchor_id, c.vec_id, a.y = c.y same, list_inner_product(a.v, c.v)::BIGINT score FROM e a JOIN e c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id positive_id, score positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) positive_rank FROM s WHERE same),
n AS (SELECT p.*, s.vec_id negative_id, s.score negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_rank ORDER BY s.score DESC, s.vec_id) rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score WHERE positive_rank <= 5)
SELECT anchor_id, positive_id, rank::INT rank, negative_id, positive_score, negative_score, positive_rank::INT positive_rank FROM n WHERE rank <= 5
"""
