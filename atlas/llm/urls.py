"""URL filters: host and path rules, and gradient-boosted trees on lexical features for URLs on which no rule speaks."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Work, by_hash

#: Different labelled URLs that the trees are fitted on at most, by the order of a hash of the URL. Statistics cover all labelled rows.
FITTED = 20_000
#: Trees, their depth, bins of a feature, the step of each tree, the penalty on a leaf's value, and the weight of the overall share in a statistic.
TREES, DEPTH, BINS, RATE, PENALTY, PRIOR = 40, 4, 32, 0.3, 1.0, 8.0
#: Statistics are taken of these parts of a URL: the last label and the last two labels of the host, the path's first segment, the ending of its last one.
PARTS = ["label1", "label2", "segment", "ending"]
LEXICAL = ["length", "host_length", "path_length", "labels", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "fragment", "secure"]
FEATURES = [*LEXICAL, *(f"{p}_{x}" for p in PARTS for x in ("share", "seen"))]

#: What op13_urls judges with: a verdict, then host and path.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty without a "://"."""
    after = F.when(F.contains(url, F.lit("://")), F.substr(url, F.length(F.substring_index(url, "://", 1)) + 4))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """verdict and rule of the longest rule that fits, null if none does; of equally long ones the first in alphabetical order.

    A rule is a host, which stands for its subdomains, too, and the beginning of a path. Rules are a short list, written into the plan.
    """
    out = None
    for verdict, text in sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0])):
        at, _, begin = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + begin)
        found = F.struct(F.lit(verdict).alias("verdict"), F.lit(text).alias("rule"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return F.lit(None).cast("struct<verdict:string,rule:string>") if out is None else out


def parts(host: Column, path: Column) -> dict[str, Column]:
    """The texts of PARTS, each with its kind in front."""
    end = F.regexp_extract(path, r"\.([^./]{1,8})$", 1)
    return {"label1": F.regexp_extract(host, r"[^.]*$", 0), "label2": F.regexp_extract(host, r"[^.]*(\.[^.]*)?$", 0), "segment": F.regexp_extract(path, r"^/([^/]*)", 1), "ending": end}


def lexical(url: str, host: str, path: str) -> list[float]:
    """The features LEXICAL of one URL."""
    n = len(url)
    seen = Counter(url)
    entropy = -sum(c / n * math.log2(c / n) for c in seen.values()) if n else 0.0
    query = url.partition("#")[0].partition("?")[2]
    digits = sum(c for x, c in seen.items() if "0" <= x <= "9")
    labels, depth = host.count(".") + 1 if host else 0, sum(1 for x in path.split("/") if x)
    parameters = sum(1 for x in query.split("&") if x)
    return [float(n), float(len(host)), float(len(path)), float(labels), float(depth), digits / n if n else 0.0, entropy, float(parameters), float(seen["-"]), float("#" in url), float(url[:8].lower() == "https://")]


@dataclass
class Trees:
    """Trees as arrays: a node's feature (-1: a leaf), threshold (values up to it go left), children and value; and the score before any tree."""

    base: float
    feature: np.ndarray  # trees, nodes
    threshold: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log odds that a URL is to be blocked."""
        out = np.full(len(x), self.base)
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                split = feature[node]
                right = x[np.arange(len(x)), np.maximum(split, 0)] > threshold[node]
                node = np.where(split < 0, node, 2 * node + 1 + right)
            out += value[node]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for the log loss: second-order gains on binned features, each tree level by level.

    Of equally good splits the first feature and the lowest threshold are taken. Without rows, or with rows of one class alone, there is no tree.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = math.log(share / (1 - share))
    nodes = (1 << (DEPTH + 1)) - 1
    if not len(y) or y.min() == y.max():
        return Trees(base if len(y) else -1.0, np.zeros((0, nodes), int), np.zeros((0, nodes)), np.zeros((0, nodes)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
    score = np.full(len(y), base)
    made = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        slope, bend = p - y, np.maximum(p * (1 - p), 1e-12)
        feature, threshold, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        at = np.zeros(len(y), np.int64)
        for depth in range(DEPTH + 1):
            first, count = (1 << depth) - 1, 1 << depth
            here = at >= first  # rows whose node was split above
            g, h = (np.bincount(at[here] - first, w[here], count) for w in (slope, bend))
            value[first : first + count] = -RATE * g / (h + PENALTY)
            if depth == DEPTH:
                break
            best = np.full(count, 1e-6)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                cell = (at[here] - first) * BINS + binned[here, f]
                left_g, left_h = (np.cumsum(np.bincount(cell, w[here], count * BINS).reshape(count, BINS), axis=1)[:, : len(e)] for w in (slope, bend))
                gain = left_g**2 / (left_h + PENALTY) + (g[:, None] - left_g) ** 2 / (h[:, None] - left_h + PENALTY) - (g**2 / (h + PENALTY))[:, None]
                cut = gain.argmax(axis=1)
                most = gain[np.arange(count), cut]
                better = np.flatnonzero(most > best + 1e-9)
                best[better], feature[first + better], threshold[first + better] = most[better], f, e[cut[better]]
            split = feature[at]
            moved = here & (split >= 0)
            right = x[np.arange(len(y)), np.maximum(split, 0)] > threshold[at]
            at = np.where(moved, 2 * at + 1 + right, at)
        value[feature >= 0] = 0.0
        score = score + value[at]
        made.append((feature, threshold, value))
    return Trees(base, *(np.array(a) for a in zip(*made)))


def statistics(labelled: DataFrame) -> DataFrame:
    """kind, part, n and blocked over all labelled rows (host, path, blocked): one row for each different part of a URL."""
    of = parts(F.col("host"), F.col("path"))
    kinds = F.explode(F.array(*[F.struct(F.lit(p).alias("kind"), of[p].alias("part")) for p in PARTS]))
    return labelled.select(kinds.alias("k"), "blocked").groupBy("k.kind", "k.part").agg(F.count("*").alias("n"), F.sum("blocked").alias("blocked"))


def with_statistics(urls: DataFrame, stats: DataFrame) -> DataFrame:
    """urls with, for each part, how many labelled rows share it and how many of these are blocked (0 if none).

    Left joins with a written table: Spark broadcasts it where it is small, and otherwise splits skewed parts.
    """
    of = parts(F.col("host"), F.col("path"))
    for p in PARTS:
        mine = stats.where(F.col("kind") == p).select(F.col("part").alias(f"_{p}"), F.col("n").alias(f"{p}_n"), F.col("blocked").alias(f"{p}_b"))
        urls = urls.withColumn(f"_{p}", of[p]).join(mine, f"_{p}", "left").drop(f"_{p}").fillna(0, [f"{p}_n", f"{p}_b"])
    return urls


def matrix(batch: pa.RecordBatch, share: float, own: np.ndarray | None = None) -> np.ndarray:
    """The features of a batch with url, host, path and the columns of with_statistics. own: a training row's label, which is taken out of its statistics."""
    texts = zip(*(batch.column(c).to_pylist() for c in ("url", "host", "path")))
    out = [np.array([lexical(u or "", h, p) for u, h, p in texts], float).reshape(batch.num_rows, len(LEXICAL))]
    for p in PARTS:
        n, b = (batch.column(f"{p}_{x}").to_numpy().astype(float) for x in "nb")
        if own is not None:
            n, b = n - 1, b - own
        out.append(np.stack([(b + PRIOR * share) / (n + PRIOR), np.log1p(n)], axis=1))
    return np.concatenate(out, axis=1)


@dataclass
class Model:
    trees: Trees
    share: float  # of blocked URLs among the labelled ones
    stats: DataFrame

    def judge(self, urls: DataFrame) -> DataFrame:
        """urls (with host and path) and `blocked`, the probability that each is to be blocked."""
        trees, share, kept = self.trees, self.share, urls.columns
        wide = with_statistics(urls, self.stats)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = 1 / (1 + np.exp(-np.clip(trees.scores(matrix(batch, share)), -40, 40)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(p)], names=[*kept, "_p"])

        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema)
        return wide.mapInArrow(run, f"{types}, _p double")


def train(labelled: DataFrame, fitted: int = FITTED) -> Model:
    """A model from labelled URLs: url, host, path, blocked (1 or 0). Rows with a null label are passed over.

    Statistics of the parts cover all rows; trees are fitted on at most `fitted` different rows, those with the smallest hashes of their URL, each with
    statistics that leave itself out. No row: every URL is allowed. Rows of one class: that class.
    """
    work = Work(labelled.sparkSession)
    labelled = labelled.select("url", "host", "path", F.col("blocked").cast("int").alias("blocked")).where("blocked is not null")
    stats = work.table(statistics(labelled), "url-parts")
    whole = stats.where(F.col("kind") == "label1").agg(F.sum("n"), F.sum("blocked")).first()
    share = (whole[1] or 0) / whole[0] if whole[0] else 0.0
    some = with_statistics(by_hash(labelled.withColumn("url", F.coalesce("url", F.lit(""))), "url", fitted), stats)
    rows = some.orderBy("url", "blocked").toArrow().combine_chunks()
    x, y = np.zeros((0, len(FEATURES))), np.zeros(0)
    if rows.num_rows:
        batch = rows.to_batches()[0]
        y = batch.column("blocked").to_numpy().astype(float)
        x = matrix(batch, share, y)
    return Model(boost(x, y), share, stats)


def judge(urls: DataFrame, rules: list[tuple[str, str]], url: str = "url", key: str = "page_id", labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, blocked: the longest rule's verdict, else that of the trees (blocked, their probability, from a half on).

    The trees learn from `labelled` (url, host, path, blocked), or from the URLs that the rules judge. A null URL, or one without
    "://", has an empty host and path, which no rule fits. Repeated rows are judged each; a URL of any length is read whole. Columns other
    than key and url are never read. An empty table gives no rows.
    """
    host, path = split_url(F.col("url"))
    rows = urls.select(urls[key].alias("page_id"), urls[url].cast("string").alias("url")).withColumns({"host": host, "path": path})
    rows = rows.withColumn("found", rule(F.col("host"), F.col("path"), rules))
    known = rows.where("found is not null").select("url", "host", "path", (F.col("found.verdict") == "block").cast("int").alias("blocked")) if labelled is None else labelled
    told = train(known).judge(rows.select("page_id", "url", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("verdict")))
    return told.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("_p") >= 0.5, "block").otherwise("allow")).alias("verdict"), F.round("_p", 6).alias("blocked"))
