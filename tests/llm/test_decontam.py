import hashlib
import re

import numpy as np
import pyarrow as pa

from atlas.llm import decontam
from atlas.llm.common import Words
from tests.llm.conftest import words


def cut(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = []
    for i, t in docs:
        w, hit, found = cut(t), set(), set()
        for item, text in items:
            x = cut(text)
            n = min(window, len(x))
            for s in range(len(x) - n + 1) if x else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[s : s + n]:
                        hit.update(range(p, p + n))
                        found.add(str(item) if item is not None else "")
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(map(str, out))


def test_odd_rows(spark, odd, odd_rows, monkeypatch):
    items = [(1, " ".join(words(1, 120).split()[20:45])), (10, "ONE two"), (2, words(3, 40).upper()), (3, None), (4, "?"), (5, "one"), (1, "two"), (None, words(5, 30)), (20, " ".join(words(2, 60_000, 3000).split()[30_000:30_015]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute([(r[0], r[1]) for r in odd_rows], items)
    assert sorted(str(tuple(r)) for r in decontam.report(odd, bench).collect()) == want
    monkeypatch.setattr(decontam, "TEST_BYTES", 64)  # several passes
    assert sorted(str(tuple(r)) for r in decontam.report(odd, bench).collect()) == want
    kept = decontam.remove(odd, bench)
    assert kept.columns == odd.columns and kept.count() == sum("True" not in w for w in want)


def test_empty_tables(spark, odd, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert {(r.n_hit, r.contaminated) for r in decontam.report(odd, bench).collect()} == {(0, False)}
    assert decontam.report(empty, bench).count() == 0


def test_suffix_array_is_sorted():
    texts = [words(i, 50, 5) for i in range(20)] + ["", "a"]
    w = Words(pa.array(texts, pa.large_string()))
    array = decontam.SuffixArray(w, 10)
    assert sorted(array.suffixes) == list(range(len(w.hash) + len(texts)))
    keys = [tuple(array.text[s : s + 10]) for s in array.suffixes]
    assert keys == sorted(keys)


def test_longest_match_has_both_places(spark):
    passage = words(7, 30, 10**6)
    docs = spark.createDataFrame([(1, "x y " + passage + " z")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "q " + passage + " r s")], "item_id long, text string")
    row = decontam.matches(docs, bench).first()
    assert row.spans == [[2, 32]] and [tuple(x) for x in row.items] == [("9", 30, 2, 1)]


def test_word_hashes_tell_words_apart():
    w = Words(pa.array(["ab ba a b aab AB é É", "ab"], pa.large_string()))
    h = w.hash
    assert h[0] == h[5] == h[8] and len(np.unique(h)) == 7 and list(w.first) == [0, 8, 9]
