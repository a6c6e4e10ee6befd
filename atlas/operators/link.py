"""Links between repositories: call sites against endpoints, repository names and manual overrides."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atlas.functions import text as X

from .rounds import Rounds
from .tables import node_id


def _first(pairs: DataFrame, order: list[str]) -> DataFrame:
    return pairs.withColumn("_r", F.row_number().over(Window.partitionBy("call_id").orderBy(*order))).where("_r = 1").drop("_r")


def confirmed(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Call sites whose normalised path is an endpoint of another repository: the first endpoint in order. Methods don't matter.

    calls: call_id, repo, literal; endpoints: repo, path (normalised), ord. Endpoints that can never win are dropped before the join:
    of each path the first one, and the first one of another repository, are all that any caller needs.
    """
    each = endpoints.groupBy("path", F.col("repo").alias("target_repo")).agg(F.min("ord").alias("ord"))
    first = each.groupBy("path").agg(F.min(F.struct("ord", "target_repo")).alias("e"))  # minima are taken before rows are dealt out, so a path of many endpoints does no harm
    second = each.join(first, "path").where("target_repo <> e.target_repo").groupBy("path").agg(F.min(F.struct("ord", "target_repo")).alias("e"))
    few = first.unionByName(second).select("e.target_repo", "path", "e.ord")
    sites = calls.withColumn("path", X.normalize_path(X.strip_host(F.col("literal"))))
    return _first(sites.join(few, "path").where("repo <> target_repo"), ["ord", "target_repo"]).withColumn("confidence", F.lit("confirmed"))


#: Bytes of repository names that go to the call sites in one pass.
NAME_BYTES = 16 << 20


def _rank(bearer: tuple) -> tuple:
    """Order of repositories (ord, name): nulls first, as Spark sorts them."""
    return ((0,) if bearer[0] is None else (1, bearer[0])), bearer[1]


def _names_in(sent, calls: DataFrame, kind: str) -> DataFrame:
    """Call sites with the first repository of a pass whose name their text holds: one walk along the text, whatever the number of names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bearers = list(sent.value.items())
        automaton = ahocorasick.Automaton()
        for i, (name, _) in enumerate(bearers):
            automaton.add_word(name, i)
        automaton.make_automaton()
        for batch in batches:
            picked = []
            for text, own in zip(batch.column("_bare").to_pylist(), batch.column("repo").to_pylist()):
                fit = (x for _, i in (automaton.iter(text) if text and bearers and own is not None else ()) for x in bearers[i][1] if x[1] != own)
                picked.append(min(fit, key=_rank, default=(None, None)))
            kept = [c for c in batch.schema.names if c != "_bare"]
            ord_, target = pa.array([x[0] for x in picked], schema.field("ord").type), pa.array([x[1] for x in picked], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), target, ord_], names=[*kept, "target_repo", "ord"])

    from pyspark.sql.pandas.types import to_arrow_schema

    wide = T.StructType([*calls.schema.fields, T.StructField("target_repo", T.StringType()), T.StructField("ord", kind)])
    schema = to_arrow_schema(wide)
    return calls.withColumn("_bare", X.name_norm(F.col("literal"))).mapInArrow(run, wide).where("target_repo is not null")


def inferred(calls: DataFrame, repos: DataFrame, name_bytes: int = NAME_BYTES) -> DataFrame:
    """Call sites whose literal holds the name of another repository: the first in order. Names are compared without case, - and _.

    calls: call_id, repo, literal; repos: repo (a name), ord. All names of a pass make one Aho-Corasick automaton, which reads each literal once. Names of
    more than name_bytes go in several passes by the hash of the name, each a written table; so what a task holds stays bounded, and no
    pair of a call site and a name that it lacks is ever made. Of repositories with one name two are enough: a call site can belong to only one of them.
    Null literals, call sites without a repository and names without a letter link to nothing.
    """
    spark = calls.sparkSession
    calls = calls.select("call_id", "repo", "literal")
    names = repos.select(F.col("repo").cast("string").alias("target_repo"), "ord", X.name_norm(F.col("repo")).alias("name")).where("name <> ''")
    few = names.groupBy("name", "target_repo").agg(F.min("ord").alias("ord"))
    few = few.withColumn("_k", F.row_number().over(Window.partitionBy("name").orderBy("ord", "target_repo"))).where("_k < 3").drop("_k")
    size = few.agg(F.sum(F.octet_length("name") + F.octet_length("target_repo") + 32)).first()[0] or 0
    passes = max(1, -(-size // name_bytes))
    rounds, found = Rounds(spark), None
    for p in range(passes):
        held: dict[str, list] = {}
        for r in few.where(F.pmod(F.xxhash64("name"), F.lit(passes)) == p).collect():
            held.setdefault(r["name"], []).append((r["ord"], r["target_repo"]))
        sent = spark.sparkContext.broadcast(held)
        part = _names_in(sent, calls, repos.schema["ord"].dataType)
        if passes > 1:
            part = rounds.table(part)
            sent.destroy()
        found = part if found is None else found.unionByName(part)
    return _first(found, ["ord", "target_repo"]).withColumn("confidence", F.lit("inferred"))


# What a repository's root is called, and the kinds of edges.
ROOT, HTTP, GRPC, MANUAL = "__service_root__", "http_call", "grpc_call", "manual"


def service_roots(repos: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id, repo_id, node_type, qualified_name, file_path of each repository's root: the node that is there, else a new one with a deterministic id.

    repos: id, name. nodes: those that are known.
    """
    name = F.concat("name", F.lit(f"::{ROOT}"))
    wanted = repos.select(node_id(F.col("id"), F.lit("module"), name).alias("id"), F.col("id").alias("repo_id"), F.lit("module").alias("node_type"), name.alias("qualified_name"), F.lit("").alias("file_path"))
    if nodes is None:
        return wanted
    there = nodes.groupBy("repo_id", "qualified_name").agg(F.min("id").alias("_id"))
    return wanted.join(there, ["repo_id", "qualified_name"], "left").select(F.coalesce("_id", "id").alias("id"), "repo_id", "node_type", "qualified_name", "file_path")


def endpoint_nodes(endpoints: DataFrame) -> DataFrame:
    """Endpoints (repo_id, method, path as normalised, ord) as nodes: one for each repository, method and path, the first in order."""
    name = F.concat(F.coalesce(F.concat(F.upper("method"), F.lit(" ")), F.lit("")), "path")
    first = endpoints.groupBy("repo_id", "method", "path").agg(F.min("ord").alias("ord"))
    return first.select(node_id(F.col("repo_id"), F.lit("endpoint"), name).alias("id"), "repo_id", F.lit("endpoint").alias("node_type"), name.alias("qualified_name"), F.lit("").alias("file_path"), "method", "path", "ord")


def link(repos: DataFrame, endpoints: DataFrame, calls: DataFrame, overrides: DataFrame | None = None, nodes: DataFrame | None = None, scope: list | None = None) -> dict[str, DataFrame]:
    """nodes (endpoints and roots) and edges between repositories, each once and with the same id in every run.

    repos: id, name, status; endpoints: repo_id, method (null: a service's rpc), path, ord; calls: source_node_id, repo_id, literal; overrides:
    source_repo, target_repo, edge_type; nodes: those known so far. Active repositories, in scope if one is given, are linked; if there are fewer than two, nothing
    is. A call leads to the first endpoint of another repository with its path (confirmed), else to the root of the first repository
    whose name its text holds (inferred); overrides lead from root to root. Calls that lead from one node to one target the same way are one edge.
    """
    active = repos.where(F.col("status") == "active") if scope is None else repos.where((F.col("status") == "active") & F.col("id").isin(scope))
    enough = active.agg(F.count("*").alias("_n")).where("_n > 1")
    active = active.join(F.broadcast(enough), F.lit(True), "left_semi").select("id", "name")  # one row or none
    mine = active.select(F.col("id").alias("repo_id"))
    rounds = Rounds(repos.sparkSession)  # what is read more than once is written first
    ends = rounds.table(endpoint_nodes(endpoints.join(mine, "repo_id", "left_semi")))
    roots = rounds.table(service_roots(active, nodes))
    sites = rounds.table(calls.join(mine, "repo_id", "left_semi").select(F.struct("source_node_id", "literal").alias("call_id"), F.col("repo_id").alias("repo"), "literal").distinct())
    by_path = rounds.table(ends.groupBy("repo_id", "path").agg(F.min(F.struct("ord", "method", "id")).alias("e")))
    sure = confirmed(sites, by_path.select(F.col("repo_id").alias("repo"), "path", F.col("e.ord").alias("ord")))
    sure = rounds.table(sure)
    way = by_path.select(F.col("repo_id").alias("target_repo"), "path", F.col("e.id").alias("target_node_id"), F.when(F.col("e.method").isNotNull(), HTTP).otherwise(GRPC).alias("edge_type"))
    first = sure.join(way, ["target_repo", "path"]).select("call_id", "repo", "target_repo", "target_node_id", "edge_type", F.lit("confirmed").alias("confidence"))
    names = active.select("name", F.col("id").alias("_target"))
    rest = sites.join(sure.select("call_id"), "call_id", "left_anti").join(active.select(F.col("id").alias("repo"), F.col("name").alias("_own")), "repo").withColumn("repo", F.col("_own"))
    guess = inferred(rest.select("call_id", "repo", "literal"), active.select(F.col("name").alias("repo"), F.col("name").alias("ord")))
    guess = guess.withColumnRenamed("target_repo", "name").join(names, "name").join(active.select(F.col("name").alias("repo"), F.col("id").alias("_source")), "repo")
    root_ids = roots.select(F.col("repo_id").alias("_target"), F.col("id").alias("target_node_id"))
    second = guess.join(root_ids, "_target").select("call_id", F.col("_source").alias("repo"), F.col("_target").alias("target_repo"), "target_node_id", F.lit(HTTP).alias("edge_type"), F.lit("inferred").alias("confidence"))
    found = first.unionByName(second).select(F.col("call_id.source_node_id").alias("source_node_id"), F.col("repo").alias("source_repo_id"), F.col("target_repo").alias("target_repo_id"), "target_node_id", "edge_type", "confidence")
    if overrides is not None:
        told = manual(overrides, active)
        source = roots.select(F.col("repo_id").alias("source_id"), F.col("id").alias("source_node_id"))
        target = roots.select(F.col("repo_id").alias("target_id"), F.col("id").alias("target_node_id"))
        found = found.unionByName(told.join(source, "source_id").join(target, "target_id").select("source_node_id", F.col("source_id").alias("source_repo_id"), F.col("target_id").alias("target_repo_id"), "target_node_id", "edge_type", "confidence"))
    edges = found.distinct().select(node_id(F.col("source_node_id"), F.col("target_node_id"), F.col("edge_type"), F.col("confidence")).alias("id"), "*", F.lit(True).alias("is_cross_repo"))
    return {"nodes": ends.select(*roots.columns).unionByName(roots), "edges": edges}


def links(calls: DataFrame, endpoints: DataFrame, repos: DataFrame) -> DataFrame:
    """call_id, repo, target_repo, path, confidence: confirmed links, and inferred ones for the call sites that have none."""
    sure = confirmed(calls, endpoints)
    maybe = inferred(calls.join(sure.select("call_id"), "call_id", "left_anti"), repos).withColumn("path", F.lit(None).cast("string"))
    columns = ["call_id", "repo", "target_repo", "path", "confidence"]
    return sure.select(*columns).unionByName(maybe.select(*columns))


def manual(overrides: DataFrame, repos: DataFrame) -> DataFrame:
    """Overrides between known repositories, as edges between service roots."""
    a, b = (repos.select(F.col("name").alias(f"{s}_repo"), F.col("id").alias(f"{s}_id")) for s in ("source", "target"))
    return overrides.join(a, "source_repo").join(b, "target_repo").select("source_repo", "target_repo", "source_id", "target_id", F.coalesce("edge_type", F.lit("manual")).alias("edge_type"), F.lit("confirmed").alias("confidence"))
