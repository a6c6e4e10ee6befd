"""Spelling variants: words at one edit's distance, found by a forward and a backward minimal acyclic automaton with perfect-hash word numbers."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Work, give_back

#: Words of one pair of automata, about; the vocabulary is dealt into ranges of so many.
SLICE = 20_000
#: Queries that walk an automaton at once.
BATCH = 4096
#: Fixed values of the contract: what a word is, how short and how rare it may be, and which occurrences are misspelled on purpose.
RUN, LEAST_LENGTH, LEAST_COUNT, MISSPELT = "[A-Za-z\\u00C0-\\u00FF]+", 5, 3, 97
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEALT = pa.schema([("slice", pa.int64()), ("role", pa.int32()), ("key", pa.string()), ("n", pa.int64())])
NEAR = "word string, n long, n_near long, best_n long, best string"
_NEAR = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def vocabulary(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """word and n: how often each word of at least LEAST_LENGTH code points occurs, if at least LEAST_COUNT times.

    Occurrences are runs of letters with A-Z lowered; where MISSPELT divides the crc32 of "<key>:<run>", one code point of the run is
    left out. Null texts hold none; a null key counts as an empty one.
    """
    runs = docs.select(F.coalesce(docs[key].cast("string"), F.lit("")).alias("k"), F.explode(F.regexp_extract_all(docs[text], F.lit(RUN), F.lit(0))).alias("w"))
    ascii_only = F.octet_length("w") == F.length("w")
    runs = runs.select("k", F.when(ascii_only, F.lower("w")).otherwise(F.translate("w", UPPER, LOWER)).alias("w"))
    h = F.crc32(F.concat("k", F.lit(":"), "w"))
    at = F.pmod(h, F.length("w")).cast("int")
    word = F.when(h % MISSPELT == 0, F.concat(F.substr("w", F.lit(1), at), F.substr("w", at + 2))).otherwise(F.col("w"))
    return runs.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Automaton:
    """The minimal acyclic automaton of sorted, different words. A walk adds up, arc by arc, how many words come before: at the end of a
    word that is its number in the order of the words."""

    def __init__(self, words: list[str]):
        self.count = len(words)
        parent, char, final = [-1], [0], [False]  # the tree of beginnings, node by node; a parent comes before its children
        path, before = [0], ""
        for word in words:
            same, most = 0, min(len(before), len(word))
            while same < most and before[same] == word[same]:
                same += 1
            del path[same + 1 :]
            for c in word[same:]:
                parent.append(path[-1])
                char.append(ord(c))
                final.append(False)
                path.append(len(parent) - 1)
            final[path[-1]] = True
            before = word
        known: dict[tuple, int] = {}  # nodes with the same words below are one state: it is known by whether a word ends there, and by its arcs
        arcs: list[tuple[int, int, int]] = []
        sizes: list[int] = []  # words that end at or below a state
        ends: list[bool] = []
        below: dict[int, list[tuple[int, int]]] = {}
        for node in range(len(parent) - 1, -1, -1):
            mine = (final[node], *below.pop(node, ()))
            state = known.get(mine)
            if state is None:
                state = known[mine] = len(sizes)
                sizes.append(int(mine[0]) + sum(sizes[t] for _, t in mine[1:]))
                ends.append(mine[0])
                arcs += [(state, c, t) for c, t in mine[1:]]
            below.setdefault(parent[node], []).append((char[node], state))
        self.root = state
        table = np.array(sorted(arcs), np.int64).reshape(len(arcs), 3)  # by state, then character
        self.final, source = np.array(ends, bool), table[:, 0]
        self.char, self.target, self.key = table[:, 1], table[:, 2], source << 21 | table[:, 1]
        self.first = np.searchsorted(source, np.arange(len(sizes) + 1))  # where a state's arcs begin
        passed = np.concatenate([[0], np.cumsum(np.array(sizes)[self.target])]) if arcs else np.zeros(1, np.int64)
        # words before those of an arc: one if a word ends at its source, and those of the arcs before it there
        self.skipped = passed[:-1] - passed[self.first[source]] + self.final[source]

    def step(self, state: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which (state, character) pairs have an arc, and the arcs of those."""
        if not len(self.key):
            return np.zeros(len(state), bool), np.zeros(0, np.int64)
        key = state << 21 | char
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        there = self.key[at] == key
        return there, at[there]

    def one_error(self, words: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word number) of all words that begin like a query's first exact[query] characters and go on with one error, each once."""
        length = np.array([len(w) for w in words])
        chars = np.array([ord(c) for w in words for c in w], np.int64)
        base = np.cumsum(length) - length
        query, state, number = np.arange(len(words)), np.full(len(words), self.root), np.zeros(len(words), np.int64)
        found_q, found_n = [], []
        # what still has to match exactly: query, state, number so far, place in the query
        pending = [np.zeros(0, np.int64)] * 4
        place = 0
        while len(query) or len(pending[0]):
            # 1. spend the error here: leave the query's character out, put an arc's in its place, or put an arc in between
            here = place >= exact[query]
            q, s, n = query[here], state[here], number[here]
            more = place < length[q]
            fresh = [[q[more], s[more], n[more], np.full(int(more.sum()), place + 1)]]
            width = self.first[s + 1] - self.first[s]
            each = np.repeat(np.arange(len(q)), width)
            arc = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width) + np.repeat(self.first[s], width)
            q2, n2 = q[each], n[each] + self.skipped[arc]
            other = place < length[q2]
            other[other] = self.char[arc[other]] != chars[base[q2[other]] + place]
            fresh.append([q2[other], self.target[arc[other]], n2[other], np.full(int(other.sum()), place + 1)])
            fresh.append([q2, self.target[arc], n2, np.full(len(q2), place)])
            # 2. what has spent its error goes on exactly, a step at a time; where its query ends, it is a word or nothing
            q, s, n, at = [np.concatenate([a, *b]) for a, *b in zip(pending, *fresh)]
            over = at >= length[q]
            hit = over & self.final[s]
            found_q.append(q[hit])
            found_n.append(n[hit])
            q, s, n, at = q[~over], s[~over], n[~over], at[~over]
            there, arc = self.step(s, chars[base[q] + at])
            pending = [q[there], self.target[arc], n[there] + self.skipped[arc], at[there] + 1]
            # 3. the walk without an error
            on = place < length[query]
            query, state, number = query[on], state[on], number[on]
            there, arc = self.step(state, chars[base[query] + place])
            query, state, number = query[there], self.target[arc], number[there] + self.skipped[arc]
            place += 1
        pairs = np.unique(np.concatenate(found_q) * max(1, self.count) + np.concatenate(found_n))
        return pairs // max(1, self.count), pairs % max(1, self.count)


def halves(word: str) -> tuple[str, str]:
    """The half that the forward automaton matches exactly, and the one that the backward one does."""
    return word[: len(word) // 2], word[len(word) // 2 :]


def _deal(forward: list[str], backward: list[str]):
    """Words to the ranges of keys that hold them, as words (role 0), and to those that can hold their variants, as queries (1).

    A key is the word, or the word backward. Ranges of the second kind have odd numbers.
    """

    def ranges(bounds: list[str], begin: str) -> range:
        return range(bisect.bisect_right(bounds, begin), bisect.bisect_right(bounds, begin + "\U0010ffff") + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                first, second = halves(word)
                for way, bounds, key, begin in ((0, forward, word, first), (1, backward, word[::-1], second[::-1])):
                    out.append((bisect.bisect_right(bounds, key) << 1 | way, 0, key, n))
                    out += [(r << 1 | way, 1, key, n) for r in ranges(bounds, begin)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), DEALT)] if out else [pa.array([], f.type) for f in DEALT], schema=DEALT)

    return run


def variants(words: list[str], counts: np.ndarray, queries: list[str], backward: bool) -> Iterator[tuple[list[int], list[int], list[str | None]]]:
    """For batches of queries: how many near words lie among the words, the count of the most frequent one and that one (ties: smallest).

    Words and queries are keys of one direction. The backward direction leaves out what the forward one finds: words with the query's first half.
    """
    automaton = Automaton(words)
    plain = [w[::-1] for w in words] if backward else words
    rank = np.empty(len(plain), np.int64)
    rank[sorted(range(len(plain)), key=plain.__getitem__)] = np.arange(len(plain))
    for first in range(0, len(queries), BATCH):
        some = queries[first : first + BATCH]
        exact = np.array([len(w) - len(w) // 2 if backward else len(w) // 2 for w in some])
        query, number = automaton.one_error(some, exact)
        if backward and len(query):
            begins = [halves(w[::-1])[0] for w in some]
            keep = np.array([not plain[k].startswith(begins[q]) for q, k in zip(query.tolist(), number.tolist())])
            query, number = query[keep], number[keep]
        order = np.lexsort((rank[number], -counts[number], query))
        query, number = query[order], number[order]
        found = np.bincount(query, minlength=len(some))
        best = np.flatnonzero(np.diff(query, prepend=-1))
        top: list[int | None] = [None] * len(some)
        for q, k in zip(query[best].tolist(), number[best].tolist()):
            top[q] = k
        yield found.tolist(), [0 if k is None else int(counts[k]) for k in top], [None if k is None else plain[k] for k in top]


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of DEALT, sorted by slice, role and key: a slice's words become an automaton, then its queries walk it."""
    slice_, words, counts, queries, asked = -1, [], [], [], []

    def answers() -> Iterator[pa.RecordBatch]:
        at = 0
        for found, best_n, best in variants(words, np.array(counts, np.int64), queries, bool(slice_ & 1)):
            some = [w[::-1] if slice_ & 1 else w for w in queries[at : at + len(found)]]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array(asked[at : at + len(found)], pa.int64()), pa.array(found, pa.int64()), pa.array(best_n, pa.int64()), pa.array(best, pa.string())], schema=_NEAR)
            at += len(found)

    for batch in batches:
        for s, role, key, n in zip(*(c.to_pylist() for c in batch.columns)):
            if s != slice_:
                yield from answers()
                slice_, words, counts, queries, asked = s, [], [], [], []
            (queries if role else words).append(key)
            (asked if role else counts).append(n)
    yield from answers()
    give_back()


def _bounds(words: DataFrame, key: Column, slices: int) -> list[str]:
    """Where ranges of about equal numbers of keys begin, but for the first: one string for each SLICE words."""
    if slices < 2:
        return []
    dealt = words.select(key.alias("key")).repartitionByRange(slices, "key")
    return sorted(r[1] for r in dealt.groupBy(F.spark_partition_id()).agg(F.min("key")).collect())[1:]


def near_words(words: DataFrame, work: Work) -> DataFrame:
    """word, n, n_near, best_n, best of each word of a written table: the number of words at one edit's distance, and the most frequent of them.

    Words are split into halves. An edit leaves one half as it is: the forward automaton of a range of words is walked along the first
    half exactly and then with one error, the backward one along the second. A range holds about SLICE words however many share a
    beginning; a query goes to each range that can hold its variants.
    """
    slices = max(words.sparkSession.sparkContext.defaultParallelism, -(-words.count() // SLICE))
    forward, backward = _bounds(words, F.col("word"), slices), _bounds(words, F.reverse("word"), slices)
    dealt = words.mapInArrow(_deal(forward, backward), "slice long, role int, key string, n long")
    found = dealt.repartition(2 * slices, "slice").sortWithinPartitions("slice", "role", "key").mapInArrow(_match, NEAR)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))))
    merged = found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return merged.select("word", "n", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame, work: Work) -> DataFrame:
    """word and root: the end of each chain of forms. forms: word, form (null: none).

    Each round doubles what a word has followed, by one join on written tables. A form occurs at least twice as often as its word, so
    chains are short and end.
    """
    now = work.table(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next")).where("root <> _next")
        then = work.table(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        if not then.where("_moved").limit(1).count():
            return then.select("word", "root")
        now = then.select("word", "root")


def group(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """word, n, n_near, form, form_n, root of each word of the documents.

    Two words are near if one inserted, deleted or replaced code point tells them apart. A word's form is its most frequent near word (ties: the first in
    code-point order) if that occurs at least twice as often; root follows the forms to the last one. Null and empty texts hold no words; repeated rows count each;
    a null key counts as an empty one; texts and words are read whole, a walk takes as many steps as a word has code points. Columns other than key and
    text are never read. An empty table gives no rows.
    """
    work = Work(docs.sparkSession)
    words = work.table(vocabulary(docs, text, key), "words")
    near = near_words(words, work)
    often = F.col("best_n") >= 2 * F.col("n")
    forms = work.table(near.select("word", "n", "n_near", F.when(often, F.col("best")).alias("form"), F.when(often, F.col("best_n")).alias("form_n")), "forms")
    return forms.join(roots(forms, work), "word").select("word", "form", "root", "n", "n_near", "form_n")


ORACLE = """
WITH RECURSIVE steps AS (SELECT i, i::BIGINT c, 0 k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) t FROM steps WHERE k = 8),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') d, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') w FROM documents),
o AS (SELECT d, w, count(*) n FROM runs GROUP BY d, w),
b AS (SELECT w, n, flatten(list_transform(string_split(d || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 + (unicode(x) >> 6))::BIGINT, (128 + unicode(x) % 64)::BIGINT] END)) bytes FROM o),
h AS (SELECT w, n, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) h FROM b, tab),
m AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT n FROM m WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, word part, -1 i FROM v UNION SELECT word, n, substr(word, 1, i) || substr(word, i + 2), i FROM v, range(length(word)) t(i)),
near AS (SELECT DISTINCT a.word, a.n, b.word other, b.n other_n FROM cut a JOIN cut b ON a.part = b.part AND a.word <> b.word AND (a.i = b.i OR a.i = -1 OR b.i = -1)),
best AS (SELECT word, count(*) n_near, arg_min(other, (-other_n, encode(other))) form, max(other_n) form_n FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) n_near, CASE WHEN form_n >= 2 * n THEN form END form, CASE WHEN form_n >= 2 * n THEN form_n END form_n FROM v LEFT JOIN best USING (word)),
way AS (SELECT word, word root FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON way.root = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT way.word, root FROM way JOIN f ON root = f.word WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)
"""
