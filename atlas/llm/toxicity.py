"""Toxicity by non-negative positive-unlabelled learning (Kiryo and others, 2017) with numpy classifiers on hashed words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, Work, by_hash, mix64, text_slices

#: Hashed features, and how many of them a classifier weighs. Features are words, and their beginnings of so many bytes
#: where so many different words of the text share them, since words of one stem differ in their endings.
BITS, WEIGHED, BEGINNINGS, SHARED = 22, 4096, range(3, 10), (1, 2, 3)
#: Rows that the classifiers are fitted on at most: confirmed toxic ones and unlabelled text, by the order of a hash of doc_id.
POSITIVE, UNLABELLED = 20_000, 40_000
#: Classifiers whose mean is the score, and training steps of each.
MEMBERS, STEPS = 5, 300
#: Half the factor of the squared weights in the risk.
PENALTY = 1e-3
#: Bytes of text whose features are found at once: hashes, pairs and their sorted copies take some fifty times as many.
TEXT_BYTES = 1 << 20


@dataclass
class Model:
    """Weights of the chosen features for each member, and their biases."""

    features: np.ndarray  # sorted feature numbers
    weights: np.ndarray  # members, features
    bias: np.ndarray

    def scores(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        """Mean probability of each row; (row, feature) pairs are different."""
        if not len(self.features):
            return np.full(rows, float(_sigmoid(self.bias).mean()))
        at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
        there = self.features[at] == feature
        row, at = row[there], at[there]
        return np.mean([_sigmoid(b + np.bincount(row, w[at], rows)) for w, b in zip(self.weights, self.bias)], axis=0)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the different hashed words of each row, and of the beginnings that its words share."""
    words = Words(text)
    row = words.row_of_word().astype(np.int64)
    order = np.lexsort((words.hash, row))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (row[order][1:] != row[order][:-1]) | (words.hash[order][1:] != words.hash[order][:-1])
    once = np.zeros(len(order), bool)
    once[order[fresh]] = True
    found = [row[once] << BITS | (words.hash[once] >> np.uint64(64 - BITS)).astype(np.int64)]
    for n in BEGINNINGS:
        at, value = words.prefix(n)
        at, value = at[once[at]], value[once[at]]
        pairs, first, count = np.unique(row[at] << 40 | (value >> np.uint64(24)).astype(np.int64), return_index=True, return_counts=True)
        for least in SHARED:
            enough = first[count >= least]
            found.append(row[at[enough]] << BITS | (mix64(value[enough] + np.uint64(least)) >> np.uint64(64 - BITS)).astype(np.int64))
    pairs = np.sort(np.concatenate(found))
    pairs = pairs[np.diff(pairs, prepend=-1) != 0]
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of a task hold each feature: confirmed ones, others."""
    seen = np.zeros((2, 1 << BITS), np.int32)  # counted in place: a table for each batch would be as large again, twice
    for batch in batches:
        lists = batch.column("features")
        side = np.repeat(batch.column("toxic").to_numpy() <= 0, np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten().to_numpy()
        for k in (0, 1):
            np.add.at(seen[k], flat[side == k], np.int32(1))
    there = np.flatnonzero(seen.any(axis=0))
    for at in range(0, len(there), 1 << 16):
        some = there[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(seen[0][some].astype(np.int64)), pa.array(seen[1][some].astype(np.int64))], names=["feature", "pos", "un"])


def stands_out(rows: DataFrame, n_pos: int, n_un: int) -> np.ndarray:
    """Numbers of the features whose share among the positives differs from that among the others by more than chance makes
    among so many features: a likelihood ratio test at 1 / (100 * features), the WEIGHED highest of them at most."""
    if not n_pos or not n_un:
        return np.zeros(0, np.int64)
    share = n_pos / (n_pos + n_un)
    seen = rows.mapInArrow(_counts, "feature int, pos long, un long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("un").alias("un")).where("pos + un > 2")

    def part(x: str, rate: float) -> F.Column:
        return F.when(F.col(x) > 0, F.col(x) * F.ln(F.col(x) / (F.expr("pos + un") * rate))).otherwise(0.0)

    ratio = 2 * (part("pos", share) + part("un", 1 - share))
    ranked = seen.select("feature", ratio.alias("ratio"))
    best = ranked.where(F.col("ratio") > 2 * np.log(100)).orderBy(F.desc("ratio"), "feature").limit(WEIGHED).collect()
    least = 2 * np.log(100 * max(1, seen.count()))
    return np.sort(np.array([r[0] for r in best if r[1] > least], np.int64))


def fit(rows: list[np.ndarray], positive: np.ndarray, prior: float, chosen: np.ndarray, seed: int = 7) -> Model:
    """Classifiers for g(x) that minimise prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]).

    rows: numbers of each text's chosen features; positive: which texts are confirmed; the others are unlabelled. l is the sigmoid loss's smooth
    cousin log(1 + exp(-z)). Where the bracket is negative, its gradient is followed backwards, so that no member fits unlabelled
    positives as negatives.
    """
    n_pos, n_un = int(positive.sum()), int((~positive).sum())
    if not len(chosen):
        p = min(max(prior, 1e-4), 0.4999)
        return Model(np.zeros(0, np.int64), np.zeros((MEMBERS, 0)), np.full(MEMBERS, np.log(p / (1 - p))))
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate(rows)
    at = np.searchsorted(chosen, flat)
    random = np.random.default_rng(seed)
    weights, biases = [], []
    for _ in range(MEMBERS):
        # a member sees a bootstrap of the texts, as weights
        mass = random.poisson(1.0, len(rows)).astype(float)
        mass[positive] /= max(1.0, mass[positive].sum())
        mass[~positive] /= max(1.0, mass[~positive].sum())
        w, bias = np.zeros(len(chosen)), np.log(prior / (1 - prior))
        m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
        for step in range(1, STEPS + 1):
            g = bias + np.bincount(row, w[at], len(rows))
            p = _sigmoid(g)
            unlabelled, as_negative = float(mass[~positive] @ np.logaddexp(0, g[~positive])), float(mass[positive] @ np.logaddexp(0, g[positive]))
            negative = unlabelled - prior * as_negative
            d = np.empty(len(rows))  # the risk's derivative by g
            if negative >= 0:
                d[positive] = mass[positive] * prior * ((p[positive] - 1) - p[positive])
                d[~positive] = mass[~positive] * p[~positive]
            else:
                d[positive] = mass[positive] * prior * p[positive]
                d[~positive] = -mass[~positive] * p[~positive]
            slope = np.append(np.bincount(at, d[row], len(chosen)) + PENALTY * w, d.sum())
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
            w, bias = w - move[:-1], bias - move[-1]
        weights.append(w)
        biases.append(bias)
    return Model(chosen, np.array(weights), np.array(biases))


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text", TEXT_BYTES):
        row, feature = features(batch.column("text"))
        ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feature, pa.int32()))], names=["doc_id", "toxic", "features"])


def held_out(key) -> F.Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 5, is 0. Rows without an id are held out too."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(5)) == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """Fits the classifiers. Confirmed toxic rows are the positives; unlabelled text is drawn from all rows that aren't held out, whatever
    their label, so that it holds toxic rows as often as the corpus does. The class prior is the share of toxic ones among the labels
    that may be learned from. At most POSITIVE and UNLABELLED ids are read, chosen by a hash, and all rows of these; WEIGHED features at most are weighed. Several
    labels of an id count as toxic if one is; null labels and ids are left out. Without labels, or without toxic ones, no feature stands out: the model
    gives each text the prior, which lies between 0.0001 and a half, so none is called toxic.
    """
    said = labels.where(labels[key].isNotNull() & labels[label].isNotNull() & ~held_out(labels[key])).groupBy(labels[key].cast("long").alias("doc_id")).agg(F.max(labels[label]).cast("int").alias("toxic"))
    counts = said.agg(F.count("*"), F.sum("toxic")).first()
    prior = min(max((counts[1] or 0) / max(1, counts[0]), 1e-4), 0.5)
    texts = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    confirmed = by_hash(said.where("toxic > 0").select("doc_id"), "doc_id", POSITIVE).select("doc_id", F.lit(1).alias("toxic"))
    others = by_hash(texts.where(~held_out(F.col("doc_id"))).select("doc_id"), "doc_id", UNLABELLED).select("doc_id", F.lit(0).alias("toxic"))
    rows = texts.join(F.broadcast(confirmed.unionByName(others)), "doc_id")
    work = Work(docs.sparkSession)
    seen = work.table(rows.mapInArrow(_training, "doc_id long, toxic int, features array<int>"), "training")
    sizes = dict(seen.groupBy("toxic").count().collect())
    chosen = stands_out(seen, sizes.get(1, 0), sizes.get(0, 0))
    found = seen.mapInArrow(_only(chosen), seen.schema).toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")]).combine_chunks()
    work.drop(seen)
    return fit([f.values.to_numpy().astype(np.int64) for f in found.column("features")], found.column("toxic").to_numpy() > 0, prior, chosen)


def _only(chosen: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = np.zeros(1 << BITS, bool)
        among[chosen] = True
        for batch in batches:
            lists = batch.column("features")
            flat = lists.flatten().to_numpy()
            keep = among[flat]
            ends = np.concatenate([[0], np.cumsum(keep)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[keep], pa.int32()))], names=["doc_id", "toxic", "features"])

    return run


def _scored(model, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text, TEXT_BYTES, within="doc"):
            score = model.value.scores(*features(batch.column(text)), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(score)], names=["doc", "score"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc (all columns of docs) and score, the probability of toxicity from the text alone. Null and empty texts get the score of no words. Texts are
    read whole; repeated rows repeat their score; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WEIGHED features at most
    rows = docs.select(F.struct(*docs.columns).alias("doc"))
    return rows.mapInArrow(_scored(shared, text), T.StructType([rows.schema["doc"], T.StructField("score", T.DoubleType())]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per row of docs: null texts are empty, null ids are held out, repeated rows repeat, texts are read whole,
    columns other than doc_id and text are left out, and an empty table gives no rows."""
    found = score(docs.select("doc_id", "text"), train(docs, labels))
    return found.select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with the columns of docs, whatever their names; what report() says of odd rows holds here too."""
    return score(docs, train(docs, labels)).where("score < 0.5").select("doc.*")
