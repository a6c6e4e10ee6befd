"""N-gram Jaccard join by chosen paths: sets are split again and again on sampled shared tokens until buckets are small.

A document's set holds its shingles of five words. Equal sets become one class. A class is embedded as SKETCH minhash values;
(coordinate, value) pairs are its tokens, and two sets share a token with probability equal to their similarity (Christiani,
Pagh, Sivertsen: Scalable and robust set similarity join). In each run a set goes down every path whose next token a hash of
the path samples; buckets of over LEAF sets are split on another sampled token, others are compared by brute force on their
sketches. Runs are repeated until the target recall at the threshold. What looks similar is joined to candidate components, and
all pairs of a component are then measured exactly on their whole sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, Work, mix64, text_slices
from .components import components

THRESHOLD, SHINGLE, RECALL = 0.8, 5, 0.999
SKETCH = 128
#: A token is sampled with probability 1 / (AIM * SKETCH); below the threshold, so that paths of similar sets don't die out.
AIM = 0.7
#: Sets of one bucket at most; after LEVELS splits larger buckets are compared block by block.
LEAF, LEVELS = 1000, 4
#: Sets of one block of a candidate component.
BLOCK = 256
#: Groups into which documents are thrown before the exact join on their digest.
SLOTS = 1 << 20

_ODD = mix64(np.arange(1, SKETCH + 1, dtype=np.uint64)) | np.uint64(1)


def survival(threshold: float, levels: int) -> float:
    """Least probability that a pair of that similarity meets in a bucket of each level in one run."""
    shared, p = threshold * SKETCH, 1.0
    for _ in range(levels):
        p = 1 - (1 - p / (AIM * SKETCH)) ** shared
    return p


def runs(threshold: float, recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, LEVELS)))


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles of each row, sorted, and where each row begins. Rows of fewer words, but not none, have one: all their words."""
    count = np.diff(words.first)
    row = words.row_of_word()
    h = words.hash
    whole = np.zeros(len(h), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            part = np.zeros(len(h), np.uint64)
            if len(h) > k:
                part[: len(h) - k] = h[k:]
            inside = np.arange(len(h)) + k < words.first[1:][row]
            whole = whole * np.uint64(0xD6E8FEB86659FD93) + np.where(inside, part, np.uint64(k + 1))
    starts = (np.arange(len(h)) + n <= words.first[1:][row]) | ((count[row] < n) & (np.arange(len(h)) == words.first[:-1][row]))
    values, at = mix64(whole[starts]), row[starts]
    order = np.lexsort((values, at))
    values, at = values[order], at[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (at[1:] != at[:-1])
    values, at = values[fresh], at[fresh]
    return values, np.searchsorted(at, np.arange(len(count) + 1))


def minhash(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """SKETCH 64-bit minhash values of each row; rows without shingles have zeros."""
    full = np.flatnonzero(np.diff(begin))
    out = np.zeros((len(begin) - 1, SKETCH), np.uint64)
    if len(full):
        for i, odd in enumerate(_ODD):
            out[full, i] = np.minimum.reduceat(values * odd, begin[full])
    return out


def set_names(values: np.ndarray, begin: np.ndarray, texts: pa.Array) -> list[str]:
    """A 128-bit name of each set; texts without words are sets of their own, named by the text."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix64(values * np.uint64(k)))]) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
    first, second = (s[begin[1:]] - s[begin[:-1]] for s in sums)
    return [f"{a:016x}{b:016x}" if n else hashlib.md5(t.as_py().encode()).hexdigest() for a, b, n, t in zip(first.tolist(), second.tolist(), np.diff(begin).tolist(), texts)]


def sampled(values: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and longer paths of the tokens that each row's path samples. values: the row's value at each coordinate."""
    salt = mix64(path)
    tokens = mix64(mix64(values + (np.arange(SKETCH, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))[None, :]) ^ salt[:, None])
    row, token = np.nonzero(tokens < np.uint64(int(2**64 / (AIM * SKETCH))))
    return row, mix64(tokens[row, token] ^ mix64(salt + np.uint64(7))[row])


def _signatures(n: int, repeats: int):
    """Name, size, sketch and the first step of every run's paths of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            values, begin = shingles(Words(batch.column("text")), n)
            least, size = minhash(values, begin), np.diff(begin)
            found = [sampled(least, np.full(len(least), r + 1, np.uint64)) for r in range(repeats)]
            row, path = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
            row, path = row[size[row] > 0], path[size[row] > 0]
            order = np.argsort(row, kind="stable")
            paths = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(len(size) + 1)), pa.int32()), pa.array(path[order].view(np.int64)))
            sketch = pa.array([s.tobytes() for s in (least >> np.uint64(8)).astype(np.uint16)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("md"), pa.array(set_names(values, begin, batch.column("text")), pa.string()), pa.array(size, pa.int64()), sketch, paths], names=["doc_id", "md", "h", "size", "sketch", "paths"])

    return run


def _longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of rows in large buckets, one step further."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint16).reshape(-1, SKETCH)
            row, path = sampled(sketch.astype(np.uint64), part.column("key").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), part.column("h").take(pa.array(row))], names=["key", "h"])


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 4096) -> Iterator[pa.Table]:
    """Rows sorted by key, in tables that end where a key ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            last = table.column(key)[-1]
            cut = pc.index(table.column(key), last).as_py()
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _bounds(table: pa.Table, key: str) -> np.ndarray:
    codes = table.column(key).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return np.append(np.flatnonzero(np.diff(codes, prepend=-1)), len(codes))


def _local_roots(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix with a true diagonal the first row of its component."""
    label = np.arange(len(near))
    while True:
        then = np.where(near, label[None, :], len(near)).min(axis=1)
        then = then[then]
        if (then == label).all():
            return label
        label = then


def _similar(table: pa.Table, key: str, least: int) -> Iterator[tuple[int, int]]:
    """Forest edges between rows of one bucket whose sketches agree in at least that many coordinates."""
    ends = _bounds(table, key)
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, SKETCH)
    side = table.column("side").to_numpy()
    size = np.diff(ends)
    two = ends[:-1][size == 2]
    for a in two[(sketch[two] == sketch[two + 1]).sum(axis=1) >= least]:
        yield int(a), int(a) + 1
    for a, b in zip(ends[:-1][size > 2], ends[1:][size > 2]):
        mine = sketch[a:b]
        near = np.empty((b - a, b - a), bool)
        for at in range(0, b - a, 32):
            near[at : at + 32] = (mine[at : at + 32, None, :] == mine[None, :, :]).sum(axis=2) >= least
        if side[a:b].any():  # two blocks: only what lies between them
            near &= side[a:b, None] != side[None, a:b]
            np.fill_diagonal(near, True)
        for i, root in enumerate(_local_roots(near)):
            if i != root:
                yield int(a) + i, int(a + root)


def _buckets(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key"):
            pairs = list(_similar(table, "key", least))
            names = table.column("h")
            a, b = (pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([names.take(a).combine_chunks(), names.take(b).combine_chunks()], names=["a", "b"])

    return run


def deal(groups: DataFrame, key: str, limit: int) -> DataFrame:
    """Rows with key, h and n (how many have the key): groups of over limit rows are laid out as pairs of blocks, so that each
    pair of rows meets in one group of about 2 * limit rows at most. side tells a pair's two blocks apart, and is 0 elsewhere.
    """
    blocks = F.ceil(F.col("n") / F.lit(limit)).cast("int")
    mine = F.pmod(F.xxhash64("h"), F.col("_g")).cast("int")
    dealt = groups.withColumn("_g", blocks).withColumn("_b", mine).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    name = F.concat_ws(":", F.col(key).cast("string"), F.least("_b", "_o").cast("string"), F.greatest("_b", "_o").cast("string"))
    return dealt.withColumn(key, name).withColumn("side", F.when(F.col("_b") == F.col("_o"), 0).when(F.col("_b") < F.col("_o"), 1).otherwise(2)).drop("_g", "_b", "_o", "n")


def _counted(rows: DataFrame) -> DataFrame:
    """rows with n: how many have the key, where that is more than one."""
    return rows.join(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")


def candidates(sets: DataFrame, work: Work, threshold: float) -> DataFrame:
    """Edges a, b between sets that met in a bucket and look similar by their sketches."""
    spread = math.sqrt(threshold * (1 - threshold) / SKETCH)
    least = math.floor(SKETCH * (threshold - 4 * spread))
    known = sets.select("h", "sketch")
    at = sets.select(F.explode("paths").alias("key"), "h")
    edges = None
    for level in range(1, LEVELS + 1):
        rows = work.table(_counted(at), "buckets")
        leaf = rows.where(F.col("n") <= LEAF) if level < LEVELS else rows
        some = deal(leaf.withColumn("key", F.col("key").cast("string")), "key", LEAF).join(known, "h")
        some = some.repartition("key").sortWithinPartitions("key", "h").mapInArrow(_buckets(least), "a string, b string")
        edges = some if edges is None else edges.unionByName(some)
        large = rows.where(F.col("n") > LEAF).select("key", "h")
        if level == LEVELS or large.isEmpty():
            break
        at = work.table(large.join(known, "h").mapInArrow(_longer, "key long, h string"), "paths")
    return edges


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            values, begin = shingles(Words(batch.column("text")), n)
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array([values[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:])], pa.binary())], names=["h", "shingles"])

    return run


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets share."""
    n = len(sets)
    which = np.repeat(np.arange(n), [len(s) for s in sets])
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = df[token] > 1
    number = np.cumsum(df > 1) - 1
    token, which = number[token[often]], which[often]
    counts = np.zeros((n, n), np.float64)
    order = np.argsort(token, kind="stable")
    token, which = token[order], which[order]
    for first in range(0, int((df > 1).sum()), 8192):
        a, b = np.searchsorted(token, [first, first + 8192])
        m = np.zeros((min(8192, int(token[b - 1]) - first + 1) if b > a else 0, n), np.float32)
        m[token[a:b] - first, which[a:b]] = 1
        counts += m.T @ m  # below 2^24 a chunk, so exact
    return counts


def _measure(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key", 512):
            ends = _bounds(table, "key")
            names, side, texts = table.column("h").to_pylist(), table.column("side").to_numpy(), table.column("n_texts").to_numpy()
            shingles = table.column("shingles")
            rows: list[tuple[str, int, str]] = []
            for a, b in zip(ends, ends[1:]):
                sets = [np.frombuffer(shingles[i].as_py(), np.uint64) for i in range(a, b)]
                size = np.array([len(s) for s in sets])
                both = common_counts(sets)
                near = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
                if side[a:b].any():
                    near &= side[a:b, None] != side[None, a:b]
                np.fill_diagonal(near, False)
                links = near @ texts[a:b]
                np.fill_diagonal(near, True)
                root = _local_roots(near)
                rows += [(names[a + i], int(links[i]), names[a + root[i]]) for i in np.flatnonzero(links)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["h", "links", "root"])

    return run


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, n: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, n_copies; one row per row of docs.

    Two texts are linked if their sets of word shingles have a Jaccard similarity of at least the threshold. class_id: the smallest doc_id
    among all documents that links and copies connect. n_links: how many other texts are linked with this one, texts with the
    same set among them. n_copies: how many other rows have an equal set of shingles. Texts of fewer words than a shingle
    have one shingle of all their words. Null and empty texts are equal texts; texts without any word are linked with
    equal texts only. Null ids stay; a class whose ids are all null has a null class_id. Empty tables give no rows. Texts of any length count
    with all their shingles; columns other than key and text are never read, whatever their names.
    """
    return _join(docs, text, key, threshold, n, recall).select("doc_id", "class_id", "n_links", "n_copies")


def _join(docs: DataFrame, text: str, key: str, threshold: float, n: int, recall: float) -> DataFrame:
    work = Work(docs.sparkSession)
    body = F.coalesce(docs[text], F.lit(""))
    texts = docs.select(docs[key].cast("long").alias("doc_id"), body.alias("text"), F.md5(body).alias("md"))
    signed = work.table(texts.mapInArrow(_signatures(n, runs(threshold, recall)), "doc_id long, md string, h string, size long, sketch binary, paths array<long>"), "signatures")
    by_text = signed.groupBy("h", "md").agg(F.min("doc_id").alias("doc"), F.count("*").alias("rows"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths"))
    sets = work.table(by_text.groupBy("h").agg(F.min("doc").alias("doc"), F.sum("rows").alias("rows"), F.count("*").alias("n_texts"), F.min("md").alias("md"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths")), "sets")

    maybe = components(candidates(sets, work, threshold), work, "candidates")
    maybe = work.table(maybe, "candidate-roots")
    grouped = maybe.join(maybe.groupBy("root").agg(F.count("*").alias("n")), "root").select(F.col("node").alias("h"), F.col("root").alias("key"), "n")
    wanted = work.table(sets.select("h", "md", "n_texts").join(grouped, "h"), "wanted")
    # documents are thinned out by a filter of at most SLOTS numbers before the exact join on the digest
    slot = F.pmod(F.xxhash64("md"), F.lit(SLOTS)).cast("int")
    thin = texts.select("text", "md").withColumn("slot", slot).join(F.broadcast(wanted.select(slot.alias("slot")).distinct()), "slot", "left_semi")
    found = thin.join(wanted.select("md", "h"), "md").groupBy("h").agg(F.first("text").alias("text"))
    whole = work.table(found.mapInArrow(_sets(n), "h string, shingles binary"), "whole-sets")
    rows = deal(wanted.select("key", "h", "n_texts", "n"), "key", BLOCK).join(whole, "h").select("key", "h", "side", "n_texts", "shingles")
    measured = work.table(rows.repartition("key").sortWithinPartitions("key", "h").mapInArrow(_measure(threshold), "h string, links long, root string"), "measured")

    links = measured.groupBy("h").agg(F.sum("links").alias("links"))
    roots = work.table(components(measured.select(F.col("h").alias("a"), F.col("root").alias("b")), work, "links"), "roots")
    first = roots.join(sets.select(F.col("h").alias("node"), "doc"), "node").groupBy("root").agg(F.min("doc").alias("class_id"))
    classes = roots.join(first, "root").select(F.col("node").alias("h"), "root", "class_id")
    about = sets.join(links, "h", "left").join(classes, "h", "left").select(
        "h", F.coalesce("root", "h").alias("root"), F.when(F.col("root").isNull(), F.col("doc")).otherwise(F.col("class_id")).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n_texts") - 1).alias("n_links"), (F.col("rows") - 1).alias("n_copies")
    )
    return signed.select("doc_id", "md", "h").join(work.table(about, "classes"), "h")


def representatives(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD, n: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """One row of docs for each class: one with the class's smallest doc_id. Columns of docs."""
    work = Work(docs.sparkSession)
    found = _join(docs, text, key, threshold, n, recall)
    # of rows with the class's id, the smallest text stays; rows that repeat it are folded to one at the end
    kept = work.table(found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.first("class_id").alias("id"), F.min("md").alias("digest"), F.count("*").alias("n")), "kept")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.md5(F.coalesce(docs[text], F.lit(""))).alias("digest"), docs[key].cast("long").alias("doc"))
    out = rows.join(kept, "digest").where(F.col("doc").eqNullSafe(F.col("id")))
    once = out.where("n = 1")
    if not kept.where("n > 1").isEmpty():
        once = once.unionByName(out.where("n > 1").dropDuplicates(["root"]))
    return once.select("row.*")
