"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words by Spark's higher-order functions.

Documents are split by Spark's own regular expressions. A Python step turns each slice of documents into one block row:
the slice's distinct words as byte arrays, and for each document the positions of its words among them. The fold then
runs once for each distinct word of a block, and a last step lays the words' ids out again. Nothing is shuffled, and a
block is bounded by BLOCK_BYTES or by its longest text. Words that a bounded sample of the texts holds more than once are
folded ahead and broadcast, so that a block folds only what they lack; this saves time and changes no result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Work, environment_path, give_back, text_bytes, text_slices

RANKS = "byte_bpe_50k.tiktoken"
#: Bytes of marked words that make one block at most.
BLOCK_BYTES = 4 << 20
#: Ends each word on its way to Python: U+FFFF, which is never a character.
MARK = b"\xef\xbf\xbf"
#: Bytes of text that are sampled for words to fold ahead, and how many words at most; both bound what is broadcast.
AHEAD_BYTES, AHEAD_WORDS = 64 << 20, 400_000
#: Characters of a plan's text that the driver keeps for each query: the literal rank map alone has megabytes.
PLAN_TEXT = 1 << 16
#: Words of more bytes are merged with a heap in the last step: a fold needs the square of a word's length.
FOLD_BYTES = 128
#: Words of documents that are joined at once.
DOCUMENT_WORDS = 1 << 17
#: More than any merged id and place: no pair of a word is left.
NONE = 1 << 48


@functools.cache
def ranks(path: str) -> dict[bytes, int]:
    """The file's ranks by token: lines of base64, a space and the rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@functools.cache
def merges(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left id, right id and merged id of each pair of tokens whose bytes together are a token."""
    known = ranks(path)
    found = [(a, b, merged) for token, merged in known.items() for cut in range(1, len(token)) if (a := known.get(token[:cut])) is not None and (b := known.get(token[cut:])) is not None]
    return tuple(np.array(found, np.int64).reshape(-1, 3).T)


@functools.cache
def rank_map(path: str) -> tuple[str, str]:
    """The rank map as two lists of numbers: where the row of each left id begins, and all rows laid over one another.

    Entry (begin of left) + right holds left * 65536 + merged id; rows are shifted until no two entries meet, the longest row
    first. An entry of another row differs in its upper bits, so entry XOR left * 65536 is the merged id, or else at least 65536.
    """
    left, right, merged = merges(path)
    ids = max(ranks(path).values(), default=0) + 1
    if ids > 65535:
        raise ValueError("ids need more than 16 bits")
    order = np.lexsort((right, left))
    ends = np.append(np.flatnonzero(np.diff(left[order], prepend=-1)), len(order))
    begin, taken = np.zeros(ids, np.int64), 0  # taken: one bit a place
    for g in sorted((order[a:b] for a, b in zip(ends, ends[1:])), key=len, reverse=True):
        columns = right[g].tolist()
        clash = 0  # one bit for each beginning at which an entry would meet another
        for column in columns:
            clash |= taken >> column
        at = (~clash & (clash + 1)).bit_length() - 1
        begin[left[g[0]]] = at
        row = np.zeros(columns[-1] // 8 + 1, np.uint8)
        np.bitwise_or.at(row, right[g] // 8, (1 << (right[g] % 8)).astype(np.uint8))
        taken |= int.from_bytes(row.tobytes(), "little") << at
    # a place without an entry must match no left id: 0 does only for id 0, whose own row is filled with an upper half that no id has
    entry = ["0"] * (int(begin.max()) + ids)
    entry[begin[0] : begin[0] + ids] = [str(65535 << 16)] * ids
    for at, value in zip((begin[left] + right).tolist(), (left << 16 | merged).tolist()):
        entry[at] = str(value)
    return ",".join(map(str, begin.tolist())), ",".join(entry)


def _numbers(text: str) -> Column:
    """A literal array, which the optimiser folds: read as JSON, since splitting and casting make some strings an item, which the driver's memory feels."""
    return F.from_json(F.lit(f"[{text}]"), "array<bigint>")


def fold(word: Column, path: str) -> Column:
    """Token ids of one word, given as an array of bytes.

    Each round merges the pair of the lowest rank, the leftmost of equals, until no pair has a rank. A round takes two steps of
    the fold: one looks up the ranks of all neighbours, the next one merges.
    """
    known = ranks(path)
    begins, entries = rank_map(path)
    single = _numbers(",".join(str(known[bytes([b])]) for b in range(256)))
    begin, entry = _numbers(begins), _numbers(entries)

    def look_up(ids: Column) -> Column:
        """merged id * 65536 + position of each pair; large where the two make no token, null at the end."""
        return F.transform(ids, lambda a, i: F.shiftleft(F.get(entry, F.get(begin, a) + F.get(ids, i + 1)).bitwiseXOR(F.shiftleft(a, 16)), 16).bitwiseOR(i))

    def merge(ids: Column, low: Column) -> Column:
        at = low.bitwiseAND(65535).cast("int")
        return F.flatten(F.array(F.slice(ids, F.lit(1), at), F.array(F.shiftright(low, 16)), F.slice(ids, at + 3, F.lit(1 << 30))))

    def step(state: Column, _: Column) -> Column:
        ids, low = state["ids"], state["low"]
        return (
            F.when(low.isNull(), F.struct(ids.alias("ids"), F.coalesce(F.array_min(look_up(ids)), F.lit(NONE)).alias("low")))
            .when(low >= 1 << 32, state)
            .otherwise(F.struct(merge(ids, low).alias("ids"), F.lit(None).cast("bigint").alias("low")))
        )

    start = F.struct(F.transform(word, lambda b: F.get(single, b.cast("int").bitwiseAND(255))).alias("ids"), F.lit(None).cast("bigint").alias("low"))
    return F.aggregate(F.sequence(F.lit(1), 2 * F.size(word)), start, step, lambda s: s["ids"].cast("array<int>"))


def merge_long(word: bytes, known: dict[bytes, int]) -> list[int]:
    """The same merges for one long word, in n log n: a heap of pairs and links between the parts that are left."""
    begin, after, before = list(range(len(word) + 1)), list(range(1, len(word) + 2)), list(range(-1, len(word)))
    alive = [True] * len(word)

    def pair(i: int) -> None:
        j = after[i]
        if j < len(word) and (r := known.get(word[begin[i] : begin[after[j]]])) is not None:
            heapq.heappush(heap, (r, i, after[j]))

    heap: list[tuple[int, int, int]] = []
    for i in range(len(word)):
        pair(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= len(word) or after[j] != end:
            continue  # one of the two has been merged since
        alive[j] = False
        after[i] = end
        if end < len(word):
            before[end] = i
        pair(i)
        if before[i] >= 0:
            pair(before[i])
    out, i = [], 0
    while i < len(word):
        out.append(known[word[i : after[i]]])
        i = after[i]
    return out


def _java(pattern: str) -> str:
    """The split pattern for Java, whose \\s is ASCII unless told otherwise. The endings after an apostrophe are tried at one."""
    return "(?U)" + pattern.replace("'s|'t|'re|'ve|'m|'ll|'d|", "'(?:[stmd]|re|ve|ll)|")


def one(values: pa.Array) -> pa.Array:
    """A list column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


class Ahead:
    """Words folded ahead and their ids, as Arrow arrays."""

    def __init__(self, words: pa.Array, ids: pa.Array):
        self.words, self.ids = words.cast(pa.large_binary()), ids

    @functools.cached_property
    def length(self) -> np.ndarray:
        return pc.list_value_length(self.ids).to_numpy()

    def rendered(self, render) -> pa.Array:
        """render() of each word's ids; kept, since all blocks of a worker need it, as one array, since a worker that waits keeps it, too."""
        kept = self.__dict__.setdefault("_rendered", {})
        if render not in kept:
            kept[render] = rendered(self.ids, render)
        return kept[render]


def rendered(lists: pa.Array, render) -> pa.Array:
    """render() of each list of ids."""
    parts = [pa.array([render(x) for x in lists.slice(at, 10_000).to_pylist()], pa.large_binary()) for at in range(0, len(lists), 10_000)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.large_binary())


def numbers(ids: list[int]) -> bytes:
    """Decimal numbers with one space between them."""
    return b" ".join([b"%d" % x for x in ids])


@functools.cache
def bodies(path: str):
    """Renders ids as the bytes that they stand for."""
    piece = pieces(path)
    return lambda ids: b"".join([piece[x] for x in ids])


def _words(batch: pa.RecordBatch, split) -> tuple[pa.Array, np.ndarray]:
    """The words of a slice's rows, one after another, and how many each row has. MARK ends each word; rows that Java can't split are split here."""
    data, ends = text_bytes(batch.column("cut"))
    mark = np.flatnonzero((data[:-2] == MARK[0]) & (data[1:-1] == MARK[1]) & (data[2:] == MARK[2])) if len(data) > 2 else np.zeros(0, np.int64)
    keep = np.ones(len(data), bool)
    for k in range(3):
        keep[mark + k] = False
    offsets = np.concatenate([[0], mark - 3 * np.arange(len(mark))]).astype(np.int32)
    flat = pa.Array.from_buffers(pa.binary(), len(mark), [None, pa.py_buffer(offsets), pa.py_buffer(data[keep])])
    counts = np.diff(np.searchsorted(mark, ends))
    rare = batch.column("text")
    if rare.null_count < len(rare):
        own = {i: split.findall(rare[i].as_py()) for i in np.flatnonzero(rare.is_valid().to_numpy(zero_copy_only=False))}
        at, parts = np.concatenate([[0], np.cumsum(counts)]), []
        last = 0
        for i, words in own.items():
            parts += [flat.slice(last, at[i] - last), pa.array([w.encode() for w in words], pa.binary())]
            last, counts[i] = at[i], len(words)
        flat = pa.concat_arrays([*parts, flat.slice(last)])
    return flat, counts


def _blocks(pattern: str, ahead):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split, known = regex.compile(pattern), ahead.value.words.cast(pa.binary())
        for batch in text_slices(batches, "cut", BLOCK_BYTES, rows=4096):
            flat, counts = _words(batch, split)
            coded = flat.dictionary_encode()
            vocab = coded.dictionary
            code = pc.fill_null(pc.index_in(vocab, value_set=known), -1).to_numpy(zero_copy_only=False)
            rest = pa.concat_arrays([vocab.filter(pa.array(code < 0))])
            offsets = pa.Array.from_buffers(pa.int32(), len(rest) + 1, [None, rest.buffers()[1]], offset=rest.offset)
            data = rest.buffers()[2]
            inner = pa.ListArray.from_arrays(offsets, pa.Array.from_buffers(pa.int8(), data.size if data else 0, [None, data or pa.py_buffer(b"")]))
            yield pa.RecordBatch.from_arrays(
                [
                    one(batch.column("key")),
                    one(pa.array(counts.astype(np.int32))),
                    pa.array([coded.indices.to_numpy(zero_copy_only=False).astype(np.int32).tobytes()], pa.binary()),
                    pa.array([code.astype(np.int32).tobytes()], pa.binary()),
                    one(inner),
                ],
                names=["keys", "counts", "at", "code", "vocab"],
            )
            del batch, flat, coded, vocab, rest, inner  # before the next slice comes

    return run


def fold_ahead(docs: DataFrame, text: str, path: str, pattern: str):
    """A broadcast Ahead: the words that a sample of about AHEAD_BYTES holds at least twice, AHEAD_WORDS at most, with their ids."""
    spark = docs.sparkSession
    body = F.coalesce(docs[text], F.lit(""))
    total = docs.agg(F.sum(F.octet_length(body))).first()[0] or 0
    some = docs.select(body.alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < F.lit(min(1 << 20, (AHEAD_BYTES << 20) // max(1, total))))
    words = some.select(F.explode(F.regexp_extract_all("t", F.lit(_java(pattern)), F.lit(0))).alias("w")).groupBy("w").count().where((F.col("count") > 1) & (F.octet_length("w") <= FOLD_BYTES))
    words = words.orderBy(F.desc("count"), "w").limit(AHEAD_WORDS).select("w").repartition(spark.sparkContext.defaultParallelism)
    bytes_ = Work(spark).table(words.mapInArrow(_as_bytes, "w string, b array<tinyint>"), "ahead")  # so that the plan that holds the literal has one stage, and is told once
    found = bytes_.select("w", fold(F.col("b"), path).alias("ids")).toArrow().combine_chunks()
    arrays = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in found.columns]
    shared = spark.sparkContext.broadcast(Ahead(*arrays))
    del found, arrays
    give_back()
    return shared


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("w"), pa.array([np.frombuffer(w.encode(), np.int8) for w in batch.column("w").to_pylist()], pa.list_(pa.int8()))], names=["w", "b"])


def blocks(docs: DataFrame, ahead, text: str, key: str, pattern: str) -> DataFrame:
    """One row a block: keys, counts (words of each document), at (32-bit positions of the words among the distinct ones), code (for each
    distinct word its place among those folded ahead, or -1) and vocab (the distinct words of code -1, as byte arrays)."""
    body = F.coalesce(docs[text], F.lit(""))
    rare = body.rlike(r"\p{Cn}")  # characters that Java doesn't know yet; MARK is one of them, so no other text holds it
    cut = F.regexp_replace(body, F.lit(_java(pattern)), F.lit(f"$0{MARK.decode()}"))
    rows = docs.select(docs[key].cast("bigint").alias("key"), F.when(~rare, cut).alias("cut"), F.when(rare, body).alias("text"))
    return rows.mapInArrow(_blocks(pattern, ahead), "keys array<bigint>, counts array<int>, at binary, code binary, vocab array<array<tinyint>>")


def encode_blocks(found: DataFrame, path: str) -> DataFrame:
    """Blocks with ids: the token ids of each word of vocab, null for words of over FOLD_BYTES bytes."""
    return found.withColumn("ids", F.transform("vocab", lambda w: F.when(F.size(w) <= FOLD_BYTES, fold(w, path))))


class Block:
    """One block on its way back: ids of its distinct words, and documents as positions among them."""

    def __init__(self, batch: pa.RecordBatch, i: int, known: dict[bytes, int], ahead: Ahead):
        self.keys, self.ahead = batch.column("keys")[i].values, ahead
        counts = batch.column("counts")[i].values.to_numpy()
        self.at = np.frombuffer(batch.column("at")[i].as_py(), np.int32)
        self.code = np.frombuffer(batch.column("code")[i].as_py(), np.int32)
        self.ends = np.concatenate([[0], np.cumsum(counts)])
        own = batch.column("ids")[i].values
        if own.null_count:
            vocab = batch.column("vocab")[i].values
            own = pa.array([x.as_py() if x.is_valid else merge_long(vocab[j].values.to_numpy().tobytes(), known) for j, x in enumerate(own)], pa.list_(pa.int32()))
        self.own = own
        length = np.empty(len(self.code), np.int64)
        length[self.code < 0] = pc.list_value_length(own).to_numpy(zero_copy_only=False)
        length[self.code >= 0] = ahead.length[self.code[self.code >= 0]]
        self.length = length
        self.tokens = np.concatenate([[0], np.cumsum(length[self.at])])[self.ends]

    def token_ids(self) -> np.ndarray:
        """Ids of all documents, one after another; tokens has their ends."""
        both = np.concatenate([self.ahead.ids.flatten().to_numpy(), self.own.flatten().to_numpy()])
        first = np.cumsum(np.concatenate([self.ahead.length, self.length[self.code < 0]])) - np.concatenate([self.ahead.length, self.length[self.code < 0]])
        place = self.code.astype(np.int64)
        place[self.code < 0] = len(self.ahead.length) + np.arange(int((self.code < 0).sum()))
        n = self.length[self.at]
        return both[np.repeat(first[place][self.at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] if len(self.at) else both[:0]

    def rendered(self, render) -> pa.Array:
        """Those of the distinct words: first the ones folded ahead, then the block's own."""
        return pa.concat_arrays([self.ahead.rendered(render).take(pa.array(self.code[self.code >= 0])), rendered(self.own, render)])

    def per_document(self, render, gap: bytes) -> Iterator[bytes]:
        words, own = self.rendered(render), self.code < 0
        place = np.where(own, int((~own).sum()) + np.cumsum(own) - 1, np.cumsum(~own) - 1)[self.at]
        row = 0
        while row < len(self.ends) - 1:  # some documents at once
            to = max(row + 1, int(np.searchsorted(self.ends, self.ends[row] + DOCUMENT_WORDS, "right")) - 1)
            some = words.take(pa.array(place[self.ends[row] : self.ends[to]]))
            for body in pc.binary_join(pa.ListArray.from_arrays(pa.array(self.ends[row : to + 1] - self.ends[row], pa.int32()), some), pa.scalar(gap, pa.large_binary())):
                yield body.as_py()
            row = to


def pieces(path: str) -> list[bytes]:
    """Bytes of each id; ids without a token have none."""
    known = ranks(path)
    out = [b""] * (max(known.values(), default=-1) + 1)
    for token, i in known.items():
        out[i] = token
    return out


def _emit(path: str, ahead, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, before = ranks(path), ahead.value
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch, i, known, before)
                n = pa.array(np.diff(block.tokens), pa.int64())
                if digest:
                    shas = [[hashlib.sha256(x).hexdigest() for x in block.per_document(*how)] for how in ((numbers, b" "), (bodies(path), b""))]
                    yield pa.RecordBatch.from_arrays([block.keys, n, *[pa.array(x, pa.string()) for x in shas]], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    ids = pa.ListArray.from_arrays(pa.array(block.tokens, pa.int32()), pa.array(block.token_ids(), pa.int32()))
                    yield pa.RecordBatch.from_arrays([block.keys, ids], names=["doc_id", "ids"])
                del block
            del batch
            give_back()

    return run


def _chain(docs: DataFrame, text: str, key: str, path: str | None, digest: bool, schema: str) -> DataFrame:
    import public_tokenizers

    path, pattern = path or environment_path(RANKS), public_tokenizers.PATTERN
    conf = docs.sparkSession.conf
    if conf.get("spark.sql.maxPlanStringLength", None) is None:  # else the driver would keep the literal as text, once for each plan that holds it
        conf.set("spark.sql.maxPlanStringLength", PLAN_TEXT)
    ahead = fold_ahead(docs, text, path, pattern)
    return encode_blocks(blocks(docs, ahead, text, key, pattern), path).mapInArrow(_emit(path, ahead, digest), schema)


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """doc_id and ids: the token ids of each text, one row per row of docs, in no order.

    Null texts are empty and have no ids. Null keys stay null, repeated rows repeat, other columns are left out, an empty
    table gives no rows. Special tokens are never made: their spelling in a text is ordinary text.
    """
    return _chain(docs, text, key, path, False, "doc_id bigint, ids array<int>")


def decode(coded: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """coded with a binary column decoded: the ids' pieces one after another. Null ids, null lists and unknown ids have no bytes."""
    path = path or environment_path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pieces(path)
        for batch in batches:
            body = [b"".join([piece[i] for i in x or () if i is not None and 0 <= i < len(piece)]) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(body, pa.binary())], names=[*batch.schema.names, "decoded"])

    return coded.mapInArrow(run, T.StructType([*coded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode() and decode() of each text, of which only digests leave the executors."""
    return _chain(docs, text, key, path, True, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
