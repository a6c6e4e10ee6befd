import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from atlas.llm import jaccard
from atlas.llm.common import Work
from atlas.llm.components import components


def shingles(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """class_id, n_links, n_copies of each row, by comparing all texts."""
    texts = sorted({t or "" for _, t in rows})
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = collections.Counter()
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, t in rows:
        ids[find(texts.index(t or ""))].append(i)
    same = collections.Counter(sets[texts.index(t or "")] or ("text", t or "") for _, t in rows)
    out = []
    for i, t in rows:
        k = texts.index(t or "")
        known = [x for x in ids[find(k)] if x is not None]
        out.append((i, min(known) if known else None, links[k], same[sets[k] or ("text", t or "")] - 1))
    return sorted(map(str, out))


def got(df):
    return sorted(str((r.doc_id, r.class_id, r.n_links, r.n_copies)) for r in df.collect())


def test_odd_rows(odd, odd_rows):
    assert got(jaccard.join(odd)) == brute([(r[0], r[1]) for r in odd_rows])


def family(seed, copies, edits, n=60):
    r = random.Random(seed)
    base = [f"{seed}x{r.randrange(10**6)}" for _ in range(n)]
    out = []
    for _ in range(copies):
        mine = list(base)
        for _ in range(r.randrange(edits + 1)):
            mine[r.randrange(n)] = f"e{r.randrange(10**6)}"
        out.append(" ".join(mine))
    return out


def test_families_against_brute_force(spark, monkeypatch):
    """Large buckets are split, and components are dealt out in blocks; no link may be lost."""
    monkeypatch.setattr(jaccard, "LEAF", 20)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    texts = [t for s, k in enumerate([80, 30, 5, 2, 2, 1, 1, 1]) for t in family(s, k, 3)] + family(99, 40, 0)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard.join(df)) == brute(rows)


def test_representatives(odd, odd_rows):
    kept = jaccard.representatives(odd)
    assert kept.columns == odd.columns
    classes = {r.class_id for r in jaccard.join(odd).collect()}
    found = [r.doc_id for r in kept.collect()]
    assert sorted(map(str, found)) == sorted(map(str, classes))


def test_empty(empty):
    assert jaccard.join(empty).count() == 0 and jaccard.representatives(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 230)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long").select(F.col("a"), F.col("b"))
    assert {(x.node, x.root) for x in components(df, Work(spark)).collect()} == {(x, find(x)) for x in root}


def test_runs_reach_the_target():
    assert (1 - jaccard.survival(0.8, jaccard.LEVELS)) ** jaccard.runs(0.8, 0.999) <= 0.001
