"""Benchmark decontamination: suffix arrays of training words, searched with every suffix of the test items."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, text_slices

#: Bytes of item text that go to the executors in one pass; more items make more passes.
TEST_BYTES = 8 << 20
WINDOW = 10


class Tests:
    """All suffixes of the items' words: hashes, and how many words the suffix's window has."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        words = Words(pa.array([t for _, t in items], pa.large_string()))
        n = np.diff(words.first)
        row = words.row_of_word()
        left = words.first[1:][row] - np.arange(len(row))  # words from here to the item's end
        need = np.minimum(window, n)[row]
        begins = np.flatnonzero(left >= need)  # each is one window
        self.words, self.hash = words, words.hash
        self.at, self.need, self.item = begins.astype(np.int32), need[begins].astype(np.int32), row[begins].astype(np.int32)
        self.ids, self.first = [i for i, _ in items], words.first


_KEPT: dict[int, tuple[list, Tests]] = {}


def tests_of(items: list[tuple[str, str]], window: int) -> Tests:
    """Tests of a broadcast list, made once in a worker; those of an earlier pass go."""
    kept = _KEPT.get(window)
    if kept is None or kept[0] is not items:
        _KEPT.clear()
        _KEPT[window] = kept = (items, Tests(items, window))
    return kept[1]


def same_words(a: Words, i: np.ndarray, b: Words, j: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Whether need[k] words of a from i[k] on equal those of b from j[k] on, byte by byte."""
    out = np.ones(len(i), bool)
    for at in range(0, len(i), 1 << 15):
        some = slice(at, at + (1 << 15))
        hit = np.repeat(np.arange(len(i[some])), need[some])
        step = np.arange(len(hit)) - np.repeat(np.cumsum(need[some]) - need[some], need[some])
        p, q = i[some][hit] + step, j[some][hit] + step
        size = a.end[p] - a.start[p]
        alike = size == b.end[q] - b.start[q]
        out[some][hit[~alike]] = False
        p, q, size, hit = p[alike], q[alike], size[alike], hit[alike]
        byte = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        differ = a.bytes[np.repeat(a.start[p], size) + byte] != b.bytes[np.repeat(b.start[q], size) + byte]
        out[some][np.repeat(hit, size)[differ]] = False
    return out


class SuffixArray:
    """Suffixes of a shard's words in order of their first depth words. Words are ordered by hash; rows end with a mark of their own."""

    def __init__(self, words: Words, depth: int):
        rows = len(words.first) - 1
        self.place = np.arange(len(words.hash)) + words.row_of_word()  # a mark follows each row
        n = len(words.hash) + rows
        self.known, rank = np.unique(words.hash, return_inverse=True)
        text = np.zeros(n + depth, np.int64)  # 0: mark; words from 1
        text[self.place] = rank + 1
        self.text, order = text, text[:n]
        reach = 1
        while reach < depth:
            following = np.zeros(n, np.int64)
            following[: max(0, n - reach)] = order[reach:n]
            keys = order * (int(order.max(initial=0)) + 1) + following
            self.suffixes = np.argsort(keys, kind="stable" if n < 64 else None)
            at = keys[self.suffixes]
            order = np.empty(n, np.int64)
            order[self.suffixes] = np.cumsum(np.concatenate([[0], (at[1:] != at[:-1]).astype(np.int64)])[:n])
            reach *= 2
        self.suffixes = np.argsort(order)

    def matches(self, tests: Tests) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 place in the suffix array of each test suffix's window, by binary search for all of them at once."""
        number = np.searchsorted(self.known, tests.hash)
        there = np.append(self.known, 0)[number] == tests.hash if len(self.known) else np.zeros(len(number), bool)
        deep = int(tests.need.max(initial=0))
        step = np.arange(deep)
        # only windows whose words are all known here can occur
        missing = np.concatenate([[0], np.cumsum(~there)])
        possible = np.flatnonzero(missing[tests.at + tests.need] == missing[tests.at])
        low, high = np.zeros(len(tests.at), np.int64), np.zeros(len(tests.at), np.int64)
        if not len(possible):
            return low, high
        used = step[None, :] < tests.need[possible, None]
        wanted = np.where(used, np.append(number, 0)[np.minimum(tests.at[possible, None] + step, len(number))] + 1, 0)
        for side, out in ((0, low), (1, high)):
            a, b = np.zeros(len(possible), np.int64), np.full(len(possible), len(self.suffixes))
            while (a < b).any():
                mid = (a + b) // 2
                suffix = self.suffixes[np.minimum(mid, len(self.suffixes) - 1)]
                found = np.where(used, self.text[np.minimum(suffix[:, None] + step, len(self.text) - 1)], 0)
                differ = found != wanted
                first = differ.argmax(axis=1)
                line = np.arange(len(possible))
                less = np.where(differ.any(axis=1), found[line, first] < wanted[line, first], side == 1)  # equal: below the upper end
                go = a < b
                a, b = np.where(go & less, mid + 1, a), np.where(go & ~less, mid, b)
            out[possible] = a
        return low, high


#: Marked spans of words in a document, [from, to), and the items with their longest verbatim match there.
FOUND = T.StructType([T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), T.StructField("words", T.LongType()), T.StructField("doc_word", T.LongType()), T.StructField("item_word", T.LongType())])))])


def shard_matches(words: Words, tests: Tests, depth: int) -> np.ndarray:
    """Row, first word in the row, words, item, first word in the items of every window occurrence, checked byte by byte: [5, hits]."""
    if not len(words.hash) or not len(tests.at):
        return np.zeros((5, 0), np.int64)
    array = SuffixArray(words, depth)
    low, high = array.matches(tests)
    word_at = np.full(len(array.text), -1, np.int64)
    word_at[array.place] = np.arange(len(words.hash))
    n = np.maximum(high - low, 0)
    test = np.repeat(np.arange(len(n)), n)
    word = word_at[array.suffixes[low[test] + np.arange(len(test)) - np.repeat(np.cumsum(n) - n, n)]]
    right = same_words(words, word, tests.words, tests.at[test], tests.need[test])
    test, word = test[right], word[right]
    row = words.row_of_word()[word] if len(word) else word
    return np.array([row, word - words.first[row], tests.need[test], tests.item[test], tests.at[test]], np.int64).reshape(5, -1)


def spans_of(hits: np.ndarray, rows: int) -> list[list[list[int]]]:
    """For each row the ranges of words that hits cover, those that touch as one."""
    out: list[list[list[int]]] = [[] for _ in range(rows)]
    row, at, need = hits[:3, np.lexsort((hits[1], hits[0]))]
    if len(row):
        base = row * (int((at + need).max()) + 2)  # rows don't touch one another
        end = np.maximum.accumulate(base + at + need)
        fresh = np.append(True, base[1:] + at[1:] > end[:-1])
        begins = np.flatnonzero(fresh)
        for r, a, b in zip(row[begins].tolist(), at[begins].tolist(), (end[np.append(begins[1:], len(row)) - 1] - base[begins]).tolist()):
            out[r].append([a, b])
    return out


def longest(hits: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
    """For each row and item the longest run of windows that follow one another in both: words, place in the row, place in the items; of equal ones the first."""
    row, at, need, item, place = hits[:, np.lexsort((hits[1], hits[1] - hits[4], hits[3], hits[0]))]
    if not len(row):
        return {}
    line = at - place
    fresh = np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (line[1:] != line[:-1]) | (at[1:] > at[:-1] + 1))
    begins = np.flatnonzero(fresh)
    last = np.append(begins[1:], len(row)) - 1
    words = at[last] + need[last] - at[begins]
    order = np.lexsort((at[begins], -words, item[begins], row[begins]))
    keys = np.stack([row[begins], item[begins]])[:, order]
    best = order[np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))]
    return {(int(row[b]), int(item[b])): (int(words[k]), int(at[b]), int(place[b])) for k, b in zip(best, begins[best])}


def _pass(broadcast, window: int, text: str, first: bool):
    depth = window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = tests_of(broadcast.value, window)
        for batch in text_slices(batches, text, within="doc"):
            words = Words(batch.column(text))
            hits = shard_matches(words, tests, depth)
            spans = spans_of(hits, batch.num_rows)
            items: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for (row, item), (n, at, place) in longest(hits).items():
                items[row].append({"item_id": tests.ids[item], "words": n, "doc_word": at, "item_word": place - int(tests.first[item])})
            counts = pa.array(np.diff(words.first), pa.int64())
            if not first:
                spans = [a + b for a, b in zip(batch.column("spans").to_pylist(), spans)]
                items = [a + b for a, b in zip(batch.column("items").to_pylist(), items)]
            arrays = [batch.column("doc"), counts, pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.struct([("item_id", pa.string()), ("words", pa.int64()), ("doc_word", pa.int64()), ("item_word", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc", "n_words", "spans", "items"])

    return run


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc (all columns of docs), n_words, spans (marked word ranges) and items (those found, with their longest verbatim match and both places).

    Words are runs of digits, letters and non-ASCII characters, A-Z lowered. A window is `window` consecutive words of an item, or a
    whole item of fewer words; an item without words has none. Each Python task keeps the suffix array of one slice of whole
    documents, so memory is bounded by the slice or the longest text. Documents are read once a pass and never shuffled; a pass holds
    TEST_BYTES of item text. Null texts have no words. Items with null text have none; null item ids count as "". Repeated items count once
    by id. Empty tables are fine.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(benchmark[item].cast("string"), F.lit("")).alias("i"), F.coalesce(benchmark[item_text], F.lit("")).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    passes = -(-total // TEST_BYTES) or 1
    out = docs.select(F.struct(*docs.columns).alias("doc"))
    schema = T.StructType([*out.schema.fields, T.StructField("n_words", T.LongType()), *FOUND])
    for p in range(passes):
        mine = [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == p).collect()]
        out = out.mapInArrow(_pass(spark.sparkContext.broadcast(mine), window, text, p == 0), schema)
    return out


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit, n_items, digest = [], [], []
        for spans, items in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist()):
            end = total = 0
            for a, b in sorted(spans):
                total += max(0, b - max(a, end))
                end = max(end, b)
            ids = sorted({i["item_id"] for i in items})
            hit.append(total)
            n_items.append(len(ids))
            digest.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def report(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row per row of docs, so repeated rows repeat. See matches(). Columns other than key and text are
    left out, whatever their names."""
    found = matches(docs.select(docs[key].alias("doc_id"), docs[text].alias("text")), benchmark, window=window)
    return found.select("doc.doc_id", "n_words", "spans", "items").mapInArrow(_merged, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs that hold no window of any item, with the columns of docs."""
    return matches(docs, benchmark, text=text, window=window).where(F.size("spans") == 0).select("doc.*")


ORACLE = r"""
WITH lowered AS (SELECT row_number() OVER () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, '') item_id, w FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, least(10, len(w)) n, list_slice(w, i, i + least(10, len(w)) - 1) win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) i FROM items)),
sizes AS (SELECT DISTINCT n FROM windows),
spots AS (SELECT rid, n, i, list_slice(w, i, i + n - 1) win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) i FROM lowered, sizes WHERE len(w) >= n)),
hits AS (SELECT rid, item_id, i, windows.n FROM spots JOIN windows ON spots.n = windows.n AND spots.win = windows.win),
marked AS (SELECT rid, count(DISTINCT p) n_hit FROM (SELECT rid, unnest(range(i, i + n)) p FROM hits) GROUP BY rid),
found AS (SELECT rid, count(DISTINCT item_id) n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) ids FROM hits GROUP BY rid)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM lowered LEFT JOIN marked USING (rid) LEFT JOIN found USING (rid)
"""
