"""Queries that take many steps over the driver's tables, with their SQL: reachability over cycles, traces with every ending, pull requests in pages."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from atlas.operators import graph, registry, tables
from atlas.operators.rounds import Rounds
from atlas.sources import remote

from .catalogue import _trim, table
from .fixtures import supplier_specs

# --- a graph of parts with one cycle through all of them, and shortcuts


def reachability_deep(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey")
    m = p.agg(F.max("p_partkey").alias("m"))
    k = F.col("p_partkey")
    on = p.join(F.broadcast(m), F.lit(True))  # one row
    edges = on.select(k.alias("source_node_id"), (k % F.col("m") + 1).alias("target_node_id")).unionByName(on.where(k % 5 == 0).select(k.alias("source_node_id"), ((k * 3) % F.col("m") + 1).alias("target_node_id")))
    return graph.reachable(edges, p.where(k % 100 == 0).select(k.alias("node_id")), 20, hub=1)


# --- traces of parts whose policy ends them in all ways


class ByNumber:
    """Decides by the last digit of the node's number: an unreadable answer, enough, a wrong choice, or else the first option."""

    def decide(self, question, node, content, options):
        digit = int(node["qualified_name"][1:]) % 10
        if digit == 0:
            return f"I can't tell: {question}"
        return json.dumps({"sufficient": digit == 1, "follow_target_id": -1 if digit == 2 else options[0]["target_node_id"]})


def trace_reasons(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), "p_name")
    name = F.concat(F.lit("n"), F.col("id").cast("string"))
    nodes = p.where("id % 11 <> 5").select("id", name.alias("qualified_name"), F.col("p_name").alias("file_path"))
    ways = p.where("id % 13 <> 4").select(F.col("id").alias("node_id"), F.explode(F.array(F.struct(((F.col("id") * 7 + 3) % 97 + 1).alias("t"), F.lit(False).alias("via")), F.struct((F.col("id") % 89 + 1).alias("t"), F.lit(True).alias("via")))).alias("w"))
    options = ways.select("node_id", F.col("w.t").alias("target_node_id"), F.col("w.via").alias("via_file_level_import"), F.concat(F.lit("n"), F.col("w.t").cast("string")).alias("target_qualified_name"))
    contents = nodes.select(F.col("id").alias("node_id"), F.col("file_path").alias("content"))
    traces = p.select(F.col("id").alias("trace_id"), F.col("id").alias("node_id"), F.col("p_name").alias("question"))
    steps, ends = graph.trace_many(options, nodes, contents, traces, ByNumber(), 6)
    n = steps.groupBy("trace_id").agg(F.count("*").alias("n_steps"))
    return ends.join(n, "trace_id", "left").select("trace_id", "reason", F.coalesce("n_steps", F.lit(0)).alias("n_steps"))


# --- pull requests in pages: each role's turns are a repository; a page that a broken line stands in fails


def _pages(spark, sf_dir) -> tuple:
    """Pages of ten pull requests, written as a dump; the repositories that they belong to, and one that has another host."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") % 40).alias("r"), "role", "text")
    ranked = c.withColumn("n", F.row_number().over(Window.partitionBy("r").orderBy("conv_id", "turn")) - 1)
    page, place = F.floor(F.col("n") / 10) + 1, F.col("n") % 10
    line = F.to_json(F.struct(place.alias("place"), (F.col("conv_id") * 1000 + F.col("turn")).alias("number"), F.col("role").alias("title"), F.col("text").alias("body"), F.lit("open").alias("state")))
    line = F.when((F.col("r") % 5 == 1) & (page == 2) & (place == 3), F.lit("{broken")).otherwise(line)
    rounds = Rounds(spark)
    at = f"{rounds.base}/pages"
    ranked.select(F.lit("talk").alias("owner"), F.concat(F.lit("r"), F.col("r").cast("string")).alias("repo"), page.alias("page"), line.alias("value")).repartition("repo", "page").write.partitionBy("owner", "repo", "page").text(at)
    repos = c.select("r").distinct().select(F.concat(F.lit("r"), F.col("r").cast("string")).alias("id"), F.concat(F.lit("https://"), F.when(F.col("r") % 7 == 3, "gitlab.com").otherwise("github.com"), F.lit("/talk/r"), F.col("r").cast("string"), F.lit(".git")).alias("git_url"))
    return repos, remote.Dump(at)


def pull_request_pages(spark, sf_dir):
    repos, pages = _pages(spark, sf_dir)
    found, _ = remote.pull_requests(spark, repos, pages, most=25, size=10)
    return found.select("repo_id", "pr_number", "state", F.md5("content").alias("content_md5"))


def pull_request_failures(spark, sf_dir):
    repos, pages = _pages(spark, sf_dir)
    return remote.pull_requests(spark, repos, pages, most=25, size=10, span=2)[1].select("repo_id", "page")


# --- a registry of two repositories: what suppliers' descriptions offer, and files that ask for it; then some descriptions go


def registry_cascade(spark, sf_dir):
    """Edges between the two after a sync that takes every third description away, by name."""
    specs_, s = supplier_specs(spark, sf_dir), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("k"))
    source = F.concat(F.lit("def ask_"), "k", F.lit("(i):\n    return get(f'http://offers/v1/s"), "k", F.lit("/offers/{i}')\n"))
    askers = s.select(F.lit("r").alias("repo_id"), F.concat(F.lit("s"), "k", F.lit(".py")).alias("file_path"), source.alias("content"))
    gone = F.regexp_extract("file_path", "^api/([0-9]+)/", 1).cast("int") % 3 == 0
    state = {"offers": specs_, "shop": askers}
    fetch = lambda repo: state[repo["name"]].select(F.lit(repo["id"]).alias("repo_id"), "file_path", "content")
    r = registry.Registry(tables.Snapshots(spark, f"{Rounds(spark).base}/registry"), fetch)
    offers, _ = r.register("offers", "/clones/offers"), r.register("shop", "/clones/shop")
    r.link()
    state["offers"] = specs_.where(~gone)
    r.sync(offers)
    names = r.nodes().select("id", "qualified_name")
    ends = (names.select(F.col("id").alias(f"{x}_node_id"), F.col("qualified_name").alias(x)) for x in ("source", "target"))
    edges = r.edges().where("is_cross_repo")
    for x in ends:
        edges = edges.join(x, x.columns[0])
    return edges.select("source", "target", "edge_type", "confidence")


_TALK = """
WITH c AS (SELECT conv_id, turn, conv_id % 40 r, role, text, row_number() OVER (PARTITION BY conv_id % 40 ORDER BY conv_id, turn) - 1 n FROM conversations),
p AS (SELECT *, n // 10 + 1 page, r % 5 = 1 AND n = 13 broken FROM c WHERE r % 7 <> 3), bad AS (SELECT r, min(page) page FROM p WHERE broken AND page <= 3 GROUP BY r)
"""
QUERIES = {f.__name__: f for f in (reachability_deep, trace_reasons, pull_request_pages, pull_request_failures, registry_cascade)}
SQL = {
    "pull_request_pages": _TALK + f"""SELECT 'r' || p.r repo_id, (conv_id * 1000 + turn)::INT pr_number, 'open' state, md5({_trim("'PR #' || (conv_id * 1000 + turn) || ': ' || coalesce(role, '') || chr(10) || coalesce(text, '')")}) content_md5
FROM p LEFT JOIN bad ON p.r = bad.r WHERE n < 25 AND (bad.page IS NULL OR p.page < bad.page)""",
    "pull_request_failures": _TALK + "SELECT 'r' || r repo_id, page::INT page FROM bad",
    "registry_cascade": """
SELECT 's' || s_suppkey || '.py' AS source, CASE WHEN s_suppkey % 77 = 0 THEN 'offers::__service_root__' ELSE 'GET /s' || s_suppkey || '/offers/*' END target, 'http_call' edge_type, CASE WHEN s_suppkey % 77 = 0 THEN 'inferred' ELSE 'confirmed' END confidence
FROM supplier WHERE s_suppkey % 77 = 0 OR s_suppkey % 3 <> 0
""",
    "reachability_deep": """
WITH RECURSIVE n AS (SELECT max(p_partkey) m FROM part),
e AS (SELECT p_partkey a, p_partkey % m + 1 b FROM part, n UNION SELECT p_partkey, (p_partkey * 3) % m + 1 FROM part, n WHERE p_partkey % 5 = 0),
w(start_id, node_id, hops) AS (SELECT p_partkey, p_partkey, 0 FROM part WHERE p_partkey % 100 = 0 UNION SELECT start_id, b, hops + 1 FROM w JOIN e ON a = node_id WHERE hops < 20)
SELECT start_id, node_id, min(hops)::INT hops FROM w GROUP BY ALL
""",
    "trace_reasons": f"""
WITH RECURSIVE w(trace_id, hop, node, seen, why) AS (
  SELECT p_partkey, 0, p_partkey::BIGINT, []::BIGINT[], NULL::VARCHAR FROM part
  UNION ALL SELECT trace_id, CASE WHEN v IS NULL THEN hop + 1 ELSE hop + grown END, (node * 7 + 3) % 97 + 1, list_append(seen, node), v FROM (
    SELECT *, CASE WHEN list_contains(seen, node) THEN '{graph.CYCLE}' WHEN node % 11 = 5 OR node NOT IN (SELECT p_partkey FROM part) THEN '{graph.NOT_FOUND}' WHEN node % 13 = 4 THEN '{graph.DEAD_END}'
      WHEN node % 10 = 0 THEN '{graph.UNPARSEABLE}' WHEN node % 10 = 1 THEN '{graph.SUFFICIENT}' WHEN node % 10 = 2 THEN '{graph.INVALID}' END v,
      CASE WHEN list_contains(seen, node) OR node % 11 = 5 OR node NOT IN (SELECT p_partkey FROM part) THEN 0 ELSE 1 END grown FROM w WHERE why IS NULL AND hop < 6))
SELECT trace_id, coalesce(why, '{graph.MAX_HOPS}') reason, hop::BIGINT n_steps FROM w WHERE why IS NOT NULL OR hop = 6
""",
}
