"""Spelling variants against brute force."""

import collections
import random
import re
import zlib

import pytest

from atlas.llm import spelling


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else (a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i:])


def brute(rows):
    seen = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            seen[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}
    others = {w: [v for v in words if near(w, v)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in others.items() if v}
    form = {w: best[w] if w in best and words[best[w]] >= 2 * n else None for w, n in words.items()}
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(others[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def found(frame):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group(frame).collect()), key=str)


@pytest.mark.parametrize("slice_words", [20_000, 40])
def test_against_brute_force(spark, monkeypatch, slice_words):
    """Whole vocabularies in one range and in many; a third of the words begin alike."""
    monkeypatch.setattr(spelling, "SLICE", slice_words)
    r = random.Random(3)
    words = ["".join(r.choice("abéÿ") for _ in range(r.randint(4, 8))) for _ in range(500)] + ["abab" + "".join(r.choice("abc") for _ in range(r.randint(0, 5))) for _ in range(250)]
    rows = [(i, " ".join(r.choice(words[: 20 + 12 * i]).title() + r.choice(["", ".", "1", "-x"]) for _ in range(200))) for i in range(60)]
    want = brute(rows)
    assert len(want) > 300 and any(x[1] and x[1] != x[2] for x in want)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == want


def test_odd_rows(spark, odd, odd_rows, empty):
    assert found(odd) == brute([(r[0], r[1]) for r in odd_rows])
    assert found(empty) == []
    long = "x" * 4000
    rows = [(1, f"{long} {long[1:]} {long[:-2]}y "), (2, f"{long} {long[1:]} {long[:-2]}y"), (3, f"{long} {long[1:]} {long[:-2]}y {long}" + " {long}"), (None, "ÀÉÎÕÜ àéîõü ÀÉÎÕÜ ÀÉÎÕÜ × ÷÷÷÷÷ ÷÷÷÷÷ ÷÷÷÷÷"), (4, ""), (5, None)]
    assert found(spark.createDataFrame(rows, "doc_id int, text string")) == brute(rows)


def test_automaton_is_minimal_and_numbers_words():
    words = sorted({"tap", "taps", "top", "tops", "stop", "stops", "a", "", "été"})
    a = spelling.Automaton(words)
    ways = {tuple(w[n:] for w in words if w.startswith(v[:n])) for v in words for n in range(len(v) + 1)}  # how one can go on from a beginning
    assert len(a.first) - 1 == len(ways) and a.final.sum() == sum("" in x for x in ways)
    for k, word in enumerate(words):
        state, number = a.root, 0
        for c in word:
            there, arc = a.step(*(spelling.np.array([x]) for x in (state, ord(c))))
            assert there.all()
            state, number = a.target[arc[0]], number + a.skipped[arc[0]]
        assert a.final[state] and number == k
    assert spelling.Automaton([]).one_error(["abc"], spelling.np.array([1]))[0].size == 0
