"""Training-order materialisation: a keyed permutation gives every sequence a global slot; shards of fixed stride hold them in that order."""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import Work, by_hash, environment_path, give_back, text_slices

#: Token ids of a sequence, and sequences of a shard.
LENGTH, PER_SHARD = 512, 8192
#: The id after each document: the first one that the rank file leaves free.
END_ID = 50256
#: Sequences travel compressed with a shared dictionary of so many bytes, made from at most so many sampled rows; it changes no result.
DICTIONARY, SAMPLE, LEVEL = 112_640, 2000, 6
ROUNDS = 4


def _keys(key: int) -> list[np.uint64]:
    return [np.frombuffer(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], np.uint64)[0] for r in range(ROUNDS)]


def _round(half: np.ndarray, key: np.uint64) -> np.ndarray:
    x = (half + key) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _feistel(x: np.ndarray, bits: int, keys: list[np.uint64]) -> np.ndarray:
    """A permutation of the numbers of 2 * bits bits."""
    mask = np.uint64((1 << bits) - 1)
    left, right = x >> np.uint64(bits), x & mask
    for k in keys:
        left, right = right, left ^ (_round(right, k) & mask)
    return left << np.uint64(bits) | right


def _unfeistel(x: np.ndarray, bits: int, keys: list[np.uint64]) -> np.ndarray:
    mask = np.uint64((1 << bits) - 1)
    left, right = x >> np.uint64(bits), x & mask
    for k in reversed(keys):
        left, right = right ^ (_round(left, k) & mask), left
    return left << np.uint64(bits) | right


def _walk(x: np.ndarray, n: int, key: int, step) -> np.ndarray:
    """Steps until each number is below n. The domain is under 4 * n, so a few steps do on average, and the cycle always comes back."""
    bits = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    keys = _keys(key)
    x = step(x.astype(np.uint64), bits, keys)
    while (out := x >= n).any():
        x[out] = step(x[out], bits, keys)
    return x.astype(np.int64)


def slots(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slot of each index from 0 to n - 1: a permutation that the key chooses."""
    return _walk(np.asarray(index), n, key, _feistel)


def indexes(slot: np.ndarray, n: int, key: int) -> np.ndarray:
    """The index that got the slot."""
    return _walk(np.asarray(slot), n, key, _unfeistel)


#: What a sequence holds of its documents: token ids of a document from begin on, at a place in the sequence; the end mark counts.
PARTS = pa.list_(pa.struct([("doc_id", pa.int64()), ("begin", pa.int64()), ("n", pa.int64()), ("at", pa.int64())]))
SEQUENCE = "parts array<struct<doc_id bigint, begin bigint, n bigint, at bigint>>, n_tokens bigint, body binary"


class Packer:
    """Lays documents one after another, an end mark after each, and cuts them into sequences of length ids. What is left of one slice begins
    the next one's first sequence, so only the last sequence of a task may be shorter. Documents without ids are left out."""

    def __init__(self, length: int, end_id: int):
        self.length, self.end_id = length, end_id
        self.ids, self.parts = np.zeros(0, "<u2"), pa.array([], PARTS.value_type)

    def add(self, keys: pa.Array, ends: np.ndarray, flat: np.ndarray) -> tuple[list[bytes], pa.Array]:
        """Whole sequences and the parts of each, once the documents with ids flat[ends[i]:ends[i + 1]] have come."""
        size = np.diff(ends)
        full = np.flatnonzero(size > 0)
        if not len(full):
            return self._cut(self.ids, self.parts, np.zeros(len(self.parts), np.int64), 0)
        held = len(self.ids)
        start = np.cumsum(size[full] + 1) - (size[full] + 1) + held
        total = int(start[-1] + size[full][-1] + 1)
        stream = np.full(total, self.end_id, "<u2")
        stream[:held] = self.ids
        stream[np.arange(ends[-1]) + np.repeat(np.arange(len(full)), size[full]) + held] = flat[: ends[-1]]
        cuts = np.unique(np.concatenate([start, np.arange(0, total, self.length)]))
        cuts = cuts[cuts >= held]
        until = np.append(cuts[1:], total)
        which, sequence = np.searchsorted(start, cuts, "right") - 1, cuts // self.length
        mine = pa.StructArray.from_arrays([keys.take(pa.array(full[which])).cast(pa.int64()), pa.array(cuts - start[which]), pa.array(until - cuts), pa.array(cuts - sequence * self.length)], fields=list(PARTS.value_type))
        return self._cut(stream, pa.concat_arrays([self.parts, mine]), np.concatenate([np.zeros(len(self.parts), np.int64), sequence]), total // self.length)

    def _cut(self, stream: np.ndarray, parts: pa.Array, sequence: np.ndarray, n: int) -> tuple[list[bytes], pa.Array]:
        offsets = np.searchsorted(sequence, np.arange(n + 1))
        self.ids, self.parts = stream[n * self.length :].copy(), pa.concat_arrays([parts.slice(offsets[-1])])
        return [stream[k * self.length : (k + 1) * self.length].tobytes() for k in range(n)], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts)

    def rest(self) -> tuple[list[bytes], pa.Array]:
        """The last, shorter sequence, if there is one."""
        n = int(len(self.ids) > 0)
        return [self.ids.tobytes()] * n, pa.ListArray.from_arrays(pa.array([0, len(self.parts)][: n + 1], pa.int32()), self.parts)


def dictionary(found: list[np.ndarray], length: int) -> bytes:
    """A zstd dictionary for sequences like those of the ids found; empty if there are too few of them."""
    parts = [x[k : k + length].tobytes() for x in found for k in range(0, len(x), length)]
    if len(parts) < 200:
        return b""
    return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()


def _zstd(held: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(held)} if held else {}


def _sequences(found, length: int, end_id: int, shared) -> Iterator[pa.RecordBatch]:
    """Compressed sequences of (keys, ends, flat ids)."""
    squeeze = zstandard.ZstdCompressor(level=LEVEL, write_dict_id=False, **_zstd(shared.value)).compress  # there is one dictionary, so frames needn't name it
    packer = Packer(length, end_id)

    def rows(bodies: list[bytes], parts: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([parts, pa.array([len(b) // 2 for b in bodies], pa.int64()), pa.array([squeeze(b) for b in bodies], pa.binary())], names=["parts", "n_tokens", "body"])

    for some in found:
        yield rows(*packer.add(*some))
    yield rows(*packer.rest())


def _cut(length: int, end_id: int, shared):
    def lists(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = pc.fill_null(part.column("ids"), pa.scalar([], part.column("ids").type))
                ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).astype(np.int64)
                yield part.column("doc_id"), ends, ids.flatten().to_numpy(zero_copy_only=False)
            give_back()

    return lambda batches: _sequences(lists(batches), length, end_id, shared)


def _cut_texts(path: str, pattern: str, length: int, end_id: int, shared):
    """_cut() of texts, tokenised on the way: one Python worker a task instead of two."""

    def lists(batches: Iterator[pa.RecordBatch]):
        encode = _encoding(path, pattern).encode_ordinary
        for batch in text_slices(batches, "text"):
            yield batch.column("doc_id"), *_flat(encode, batch.column("text"))

    return lambda batches: _sequences(lists(batches), length, end_id, shared)


def _slotted(first, n: int, key: int):
    """Adds the global slot: first index of the row's piece plus its place there, permuted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = np.array([first.value[p] for p in batch.column("piece").to_pylist()], np.int64)
            slot = slots(start + batch.column("place").to_numpy() - 1, n, key) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("parts", "n_tokens", "body")], pa.array(slot)], names=["parts", "n_tokens", "body", "slot"])

    return run


def record(tokens: bytes, length: int) -> bytes:
    """A record of fixed stride: how many ids count, then the ids, 16-bit little-endian, filled up with zeros."""
    return (len(tokens) // 2).to_bytes(2, "little") + tokens + bytes(2 * length - len(tokens))


def commit(fs: pyarrow.fs.FileSystem, made: str, name: str) -> None:
    """Gives a whole shard its name. A repeated task has made the same bytes, so a shard that is there already stays, and file systems that
    refuse to move onto a file (HDFS) are no harm."""
    there = lambda: fs.get_file_info(name).type == pyarrow.fs.FileType.File
    if not there():
        try:
            fs.move(made, name)
            return
        except OSError:
            if not there():
                raise
    fs.delete_file(made)


def _writer(folder: str, length: int, per_shard: int, shared):
    stride = 2 * length + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        name, out, at = None, None, 0
        token = hashlib.sha256(os.urandom(16)).hexdigest()[:12]
        restore = zstandard.ZstdDecompressor(**_zstd(shared.value)).decompress

        def close():
            out.close()
            commit(fs, f"{base}/{name}.{token}", f"{base}/{name}")

        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                shards, offsets, digests = [], [], []
                for slot, body in zip(batch.column("slot").to_pylist(), batch.column("body")):
                    mine = f"shard-{slot // per_shard:08d}.bin"
                    if mine != name:
                        if out:
                            close()
                        name, at = mine, 0
                        out = fs.open_output_stream(f"{base}/{name}.{token}")
                    tokens = restore(body.as_buffer())
                    out.write(record(tokens, length))
                    shards.append(slot // per_shard)
                    offsets.append(at)
                    digests.append(hashlib.md5(tokens).hexdigest())
                    at += stride
                yield pa.RecordBatch.from_arrays([batch.column("slot"), pa.array(shards, pa.int64()), pa.array(offsets, pa.int64()), batch.column("n_tokens"), batch.column("parts"), pa.array(digests, pa.string())], names=["slot", "shard", "offset", "n_tokens", "parts", "tokens_md5"])
            del whole, batch
            give_back()
        if out:
            close()

    return run


def materialise(coded: DataFrame, folder: str, key: int = 1, length: int = LENGTH, per_shard: int = PER_SHARD, end_id: int = END_ID, work: Work | None = None) -> DataFrame:
    """Writes shards of token ids to folder in a keyed random order and returns slot, shard, offset, n_tokens, parts, tokens_md5.

    coded: doc_id and ids (16-bit token ids). The rows of an input partition are laid one after another, an end mark after each, and cut
    into sequences of length ids; only the last one of a partition may be shorter, and parts tells which ids of which rows a sequence
    holds, so one very long row fills many sequences. Rows without ids or with null ids have no part. Sequences are numbered in
    pieces of the input side by side, and the keyed Feistel permutation with cycle-walking turns the numbers 0 to n - 1 into slots 0 to n - 1.
    Range partitions of whole shards are sorted by slot and written as records of 2 * length + 2 bytes, so slot s is at (s mod per_shard)
    times the stride of shard s // per_shard, and a reader resumes at any slot. A shard appears under its name only when it is whole, so
    lost and repeated tasks do no harm; the folder must hold no shards yet. Null doc_ids stay; repeated rows are written each; other
    columns, whatever their names, are left out; an empty table writes no shard.
    """
    shared = coded.sparkSession.sparkContext.broadcast(b"")
    cut = coded.select("doc_id", "ids").mapInArrow(_cut(length, end_id, shared), SEQUENCE)
    return _shards(cut, folder, key, length, per_shard, shared, work or Work(coded.sparkSession))


def _shards(cut: DataFrame, folder: str, key: int, length: int, per_shard: int, shared, work: Work) -> DataFrame:
    spark = cut.sparkSession
    place = (F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1).cast("int")
    held = work.table(cut.withColumn("piece", F.spark_partition_id()).withColumn("place", place), "sequences")
    counts = sorted((r[0], r[1]) for r in held.groupBy("piece").agg(F.count("*")).collect())  # one row for each input partition
    first, n = {}, 0
    for piece, count in counts:
        first[piece] = n
        n += count
    placed = held.mapInArrow(_slotted(spark.sparkContext.broadcast(first), max(n, 1), key), f"{SEQUENCE}, slot bigint")
    # whole shards to a task; slots are even whatever the rows are like
    ranged = placed.repartitionByRange(-(-n // per_shard) or 1, F.expr(f"slot div {per_shard}")).sortWithinPartitions("slot")
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(base)
    if any(f.base_name.startswith("shard-") for f in fs.get_file_info(pyarrow.fs.FileSelector(base))):
        raise ValueError(f"{folder} holds shards already")
    return ranged.mapInArrow(_writer(folder, length, per_shard, shared), "slot bigint, shard bigint, offset bigint, n_tokens bigint, parts array<struct<doc_id bigint, begin bigint, n bigint, at bigint>>, tokens_md5 string")


def read(folder: str, slot: int, count: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> Iterator[np.ndarray]:
    """Token ids of count sequences from a slot on, read in order."""
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    stride = 2 * length + 2
    while count > 0:
        try:
            file = fs.open_input_file(f"{base}/shard-{slot // per_shard:08d}.bin")
        except FileNotFoundError:
            return
        with file:
            file.seek(slot % per_shard * stride)
            while count > 0 and (body := file.read(stride)):
                yield np.frombuffer(body, "<u2", offset=2)[: int.from_bytes(body[:2], "little")]
                slot, count = slot + 1, count - 1
            if slot % per_shard:
                return


@functools.cache
def _encoding(path: str, pattern: str):
    """The tiktoken library's encoder; a worker makes it once."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=bpe.ranks(path), special_tokens={})


def _flat(encode, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the ids of each text begin and the last ones end, and all ids."""
    ids = [np.array(encode(t), np.int32) for t in texts.to_pylist()]
    return np.cumsum([0, *map(len, ids)]), np.concatenate(ids)


def sampled_dictionary(rows: DataFrame, path: str, pattern: str, length: int = LENGTH) -> bytes:
    """dictionary() of the sequences of at most SAMPLE texts."""
    encode = _encoding(path, pattern).encode_ordinary
    texts = [r[0] for r in by_hash(rows.where(F.length("text") < 1 << 16), "doc_id", SAMPLE).select("text").collect()]
    return dictionary([np.array(encode(t), "<u2") for t in texts if t], length)


def materialise_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """Tokenises documents by the tiktoken library with a public rank file and materialises them below the session's shared folder; see
    materialise(). Null and empty texts have no part; repeated rows are materialised each; a text of any length fills as many sequences as it needs; columns other than
    key and text are never read, whatever their names. Sequences travel compressed with a dictionary made from SAMPLE texts at most, which
    changes no result."""
    import public_tokenizers

    path, pattern = path or environment_path(bpe.RANKS), public_tokenizers.PATTERN
    spark = docs.sparkSession
    work = Work(spark)
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    shared = spark.sparkContext.broadcast(sampled_dictionary(rows, path, pattern))
    cut = rows.mapInArrow(_cut_texts(path, pattern, LENGTH, END_ID, shared), SEQUENCE)
    return _shards(cut, work.path("shards"), 1, LENGTH, PER_SHARD, shared, work)
