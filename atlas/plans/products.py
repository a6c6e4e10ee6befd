"""Queries of whole products over the driver's tables, with their SQL: links, roots, chunks, scopes, options."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlas.functions import text as X
from atlas.operators import chunk, graph, link, registry, search

from .catalogue import _LINES, _SIM, _STRIP, _norm, _trim, table
from .fixtures import API, supplier_specs

# --- links between repositories: hosts are repositories, their pages are endpoints, and each calls another host's pages by address or by name


def _parts(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    host, path = F.regexp_extract("url", r"^https?://([^/]*)", 1), X.normalize_path(X.strip_host(F.col("url")))
    pages = p.select("page_id", "url", host.alias("host"), path.alias("path"))
    names = pages.select("host").distinct().unionByName(pages.select(F.concat(F.lit("app-"), "host").alias("host")).distinct())
    repos = names.select(F.concat(F.lit("r:"), "host").alias("id"), F.col("host").alias("name"), F.when(F.col("host") == "app-", "inactive").otherwise("active").alias("status"))
    endpoints = pages.select(F.concat(F.lit("r:"), "host").alias("repo_id"), F.when(F.col("page_id") % 2 == 0, "get").alias("method"), "path", F.col("page_id").alias("ord"))
    literal = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://"), "host", F.lit("/nothing/"), F.col("page_id").cast("string"), F.lit("/here"))).otherwise(F.col("url"))
    calls = pages.select(F.concat(F.lit("n"), F.col("page_id").cast("string")).alias("source_node_id"), F.concat(F.lit("r:app-"), "host").alias("repo_id"), literal.alias("literal"))
    return repos, endpoints, calls


_PARTS = f"""
WITH h AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/]*)', 1) host, {_STRIP.format(u='url')} sp FROM pages),
pg AS (SELECT page_id, url, host, {_norm('sp')} path FROM h),
names AS (SELECT DISTINCT host FROM pg UNION SELECT DISTINCT 'app-' || host FROM pg),
roots AS (SELECT 'r:' || host repo_id, host || '::__service_root__' qualified_name, sha256('r:' || host || chr(1) || 'module' || chr(1) || host || '::__service_root__') id FROM names),
ends AS (SELECT 'r:' || host repo_id, method, path, min(page_id) ord FROM (SELECT *, CASE WHEN page_id % 2 = 0 THEN 'get' END method FROM pg) GROUP BY ALL),
end_nodes AS (SELECT *, CASE WHEN method IS NULL THEN path ELSE 'GET ' || path END qualified_name, sha256(repo_id || chr(1) || 'endpoint' || chr(1) || CASE WHEN method IS NULL THEN path ELSE 'GET ' || path END) id FROM ends),
calls AS (SELECT 'n' || page_id source_node_id, 'r:app-' || host repo_id, 'app-' || host own, CASE WHEN page_id % 3 = 0 THEN 'https://' || host || '/nothing/' || page_id || '/here' ELSE url END literal FROM pg),
cs AS (SELECT *, {_STRIP.format(u='literal')} lp FROM calls), cp AS (SELECT *, {_norm('lp')} path FROM cs),
hit AS (SELECT cp.source_node_id, cp.repo_id source_repo_id, e.repo_id target_repo_id, e.id target_node_id, CASE WHEN e.method IS NULL THEN 'grpc_call' ELSE 'http_call' END edge_type, 'confirmed' confidence,
  row_number() OVER (PARTITION BY cp.source_node_id ORDER BY e.ord, e.repo_id) n FROM cp JOIN end_nodes e ON e.path = cp.path AND e.repo_id <> cp.repo_id),
guess AS (SELECT c.source_node_id, c.repo_id source_repo_id, r.repo_id target_repo_id, r.id target_node_id, 'http_call' edge_type, 'inferred' confidence, row_number() OVER (PARTITION BY c.source_node_id ORDER BY o.host) n
  FROM calls c JOIN names o ON o.host <> c.own AND translate(lower(o.host), '-_', '') <> '' AND contains(translate(lower(c.literal), '-_', ''), translate(lower(o.host), '-_', '')) JOIN roots r ON r.repo_id = 'r:' || o.host
  WHERE c.source_node_id NOT IN (SELECT source_node_id FROM hit)),
edges AS (SELECT * EXCLUDE n FROM hit WHERE n = 1 UNION ALL SELECT * EXCLUDE n FROM guess WHERE n = 1)
"""


def link_edges(spark, sf_dir):
    return link.link(*_parts(spark, sf_dir))["edges"].select("id", "source_node_id", "source_repo_id", "target_repo_id", "target_node_id", "edge_type", "confidence")


def link_nodes(spark, sf_dir):
    return link.link(*_parts(spark, sf_dir))["nodes"].select("id", "repo_id", "node_type", "qualified_name")


def service_roots(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    repos = n.select(F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"))
    there = n.where("n_regionkey = 1").select(F.concat(F.lit("old"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("repo_id"), F.concat("n_name", F.lit("::__service_root__")).alias("qualified_name"))
    return link.service_roots(repos, there).select("id", "repo_id", "qualified_name")


# --- chunks of an index: some documents are source files with known ranges, the others fall back to windows


def index_chunks(spark, sf_dir):
    d, b, c = (table(spark, sf_dir, t) for t in ("documents", "benchmark", "conversations"))
    name = F.concat("source", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".py"))
    files = d.select(F.lit("r").alias("repo_id"), name.alias("file_path"), F.col("text").alias("content"))
    whole = d.where("doc_id % 3 = 0").withColumn("n", F.size(chunk.lines(F.col("text")))).where("n > 0")
    node = F.lit("r").alias("repo_id"), name.alias("file_path"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("id"), name.alias("qualified_name")
    nodes = whole.select(*node, F.when(F.col("doc_id") % 2 == 0, "function").otherwise("class").alias("node_type"), F.lit(1).alias("start_line"), F.when(F.col("doc_id") % 9 != 0, F.col("n")).alias("end_line"))
    docs = b.select(F.lit("r").alias("repo_id"), F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("file_path"), F.col("text").alias("content"))
    pulls = c.select(F.lit("r").alias("repo_id"), (F.col("conv_id") * 1000 + F.col("turn")).cast("int").alias("pr_number"), chunk.pull_request_text(F.col("turn"), F.col("role"), F.col("text")).alias("content"))
    specs_ = supplier_specs(spark, sf_dir).select("repo_id", "file_path", "content")
    o = table(spark, sf_dir, "orders").select(F.lit("r").alias("repo_id"), F.col("o_orderkey").cast("string").alias("k"), "o_orderpriority", "o_orderstatus")
    logs = o.select("repo_id", F.concat(F.lpad("k", 40, "0"), F.lit("\u001f"), "o_orderpriority", F.lit("\u001f"), "o_orderstatus", F.lit("\u001e")).alias("log"))
    found = registry.index_chunks(files.unionByName(specs_), nodes, docs=docs, logs=logs, pulls=pulls)
    return found.select("source_type", "file_path", "graph_node_id", "start_line", "end_line", "pr_number", "commit_sha", F.md5("content").alias("content_md5"))


_INDEX = f"""
WITH l AS (SELECT doc_id, source || '/d' || doc_id || '.py' file_path, {_LINES.format(t="text")} ls FROM documents),
e AS (SELECT *, CASE WHEN len(ls) > 0 AND doc_id % 3 = 0 AND doc_id % 9 <> 0 THEN 'f' || doc_id END node FROM l WHERE len(ls) > 0),
w AS (SELECT *, unnest(CASE WHEN node IS NOT NULL AND len(ls) <= 120 THEN [-1] ELSE range(0, greatest(ceil((len(ls) - 60) / 50.0)::BIGINT, 0) + 1) END) k FROM e),
code AS (SELECT 'code' source_type, file_path, node graph_node_id, CASE WHEN k < 0 THEN 1 ELSE k * 50 + 1 END start_line, CASE WHEN k < 0 THEN len(ls) ELSE least(k * 50 + 60, len(ls)) END end_line,
  {_trim("array_to_string(CASE WHEN k < 0 THEN ls ELSE list_slice(ls, k * 50 + 1, k * 50 + 60) END, chr(10))")} content FROM w),
doc AS (SELECT 'doc' source_type, 'b' || item_id file_path, {_trim("text")} content FROM benchmark),
pr AS (SELECT 'pr_description' source_type, conv_id * 1000 + turn pr_number, {_trim("'PR #' || turn || ': ' || role || chr(10) || coalesce(text, '')")} content FROM conversations)
SELECT source_type, file_path, graph_node_id, start_line::INT start_line, end_line::INT end_line, NULL::INT pr_number, NULL::VARCHAR commit_sha, md5(content) content_md5 FROM code WHERE content <> ''
UNION ALL SELECT source_type, file_path, NULL, NULL, NULL, NULL, NULL, md5(content) FROM doc WHERE content <> '' UNION ALL SELECT DISTINCT source_type, NULL, NULL, NULL, NULL, pr_number::INT, NULL, md5(content) FROM pr
UNION ALL SELECT 'api_spec', file_path, NULL, NULL, NULL, NULL, NULL, md5(rtrim(upper(method) || ' ' || path || ': ' || coalesce(summary, '') || CASE WHEN description IS NULL THEN '' ELSE chr(10) || description END)) FROM (""" + API + """)
UNION ALL SELECT 'commit', NULL, NULL, NULL, NULL, NULL, lpad(o_orderkey::VARCHAR, 40, '0'), md5(o_orderpriority || chr(10) || o_orderstatus) FROM orders
"""


def chunk_whole_ranges(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")).withColumn("n", F.size(chunk.lines(F.col("content"))))
    whole = d.where("n > 0").select("doc_id", "content", F.lit(1).alias("start_line"), F.col("n").alias("end_line"))
    some = d.where("n >= 5").select("doc_id", "content", F.lit(3).alias("start_line"), F.lit(5).alias("end_line"))
    return chunk.ranges(whole.unionByName(some)).select("doc_id", "start_line", "end_line", F.md5("content").alias("content_md5"))


# --- search, graph and scopes


def cosine_topk_queries(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.search_batch(e, q, 5, vector="embedding", key="vec_id").select("query_id", "rank", "vec_id", F.round("similarity", 6).alias("similarity"))


def edges_direct_or_file(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    direct = o.select(F.col("o_custkey").alias("node_id"), F.col("o_orderpriority").alias("target_node_id")).distinct()
    # the enclosing file of a customer is the nation's; its edges are those of all its customers
    files = c.select("c_nationkey", F.col("c_custkey").alias("o_custkey")).join(o, "o_custkey").select("c_nationkey", F.col("o_orderpriority").alias("target_node_id")).distinct()
    above = c.select(F.col("c_custkey").alias("node_id"), "c_nationkey").join(files, "c_nationkey").select("node_id", "target_node_id")
    return graph.with_fallback(direct, above)


def _edges(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("node_id"), F.col("l_suppkey").alias("s_suppkey"), F.when(F.col("l_returnflag") == "R", "inferred").otherwise("confirmed").alias("confidence"), "l_linenumber").join(table(spark, sf_dir, "supplier"), "s_suppkey")
    return e.select("node_id", F.col("s_suppkey").alias("target_node_id"), F.lit("http_call").alias("edge_type"), (F.col("s_nationkey") % 2 == 0).alias("is_cross_repo"), "confidence", (F.col("l_linenumber") > 3).alias("via_file_level_import"), F.col("s_name").alias("target_qualified_name"), F.col("s_nationkey").cast("string").alias("target_repo_name"), F.lit("f").alias("target_file_path"))


def hop_options(spark, sf_dir):
    return graph.render_options(_edges(spark, sf_dir).distinct()).select("node_id", F.md5("lines").alias("lines_md5"))


def edges_by_confidence(spark, sf_dir):
    found = graph.by_confidence(_edges(spark, sf_dir), ["node_id"], "target_qualified_name")
    return found.select("node_id", "confidence", F.array_join("labels", ",").alias("labels"))


def repo_by_name(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return registry.by_name(n, "NATION_7").unionByName(registry.by_id(n, F.lit(3)))


def repo_scope(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region"), F.lit("active").alias("status"))
    two = registry.scope(n, [1, 2, 999], least=2).withColumn("kind", F.lit("two"))
    one = registry.scope(n, [4, 999], least=2).withColumn("kind", F.lit("one"))
    return two.unionByName(one).unionByName(registry.scope(n, None, least=2).withColumn("kind", F.lit("all"))).select("kind", "id", "region")


def beyond_allow_list(spark, sf_dir):
    """Kinds of events of users that no allow list names: the check of an access filter."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    allowed = e.where("user_id % 2 = 0").withColumn("event_type", F.when(F.col("user_id") % 3 == 0, "click").otherwise("view")).distinct()
    return e.exceptAll(allowed)


_EDGES = "WITH e AS (SELECT DISTINCT l_orderkey node_id, s_suppkey t, s_nationkey n, CASE WHEN l_returnflag = 'R' THEN 'inferred' ELSE 'confirmed' END confidence, l_linenumber > 3 via, s_name name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"
QUERIES = {f.__name__: f for f in (link_edges, link_nodes, service_roots, index_chunks, chunk_whole_ranges, cosine_topk_queries, edges_direct_or_file, hop_options, edges_by_confidence, repo_by_name, repo_scope, beyond_allow_list)}
SQL = {
    "link_edges": _PARTS + "SELECT DISTINCT sha256(source_node_id || chr(1) || target_node_id || chr(1) || edge_type || chr(1) || confidence) id, * FROM edges",
    "link_nodes": _PARTS + "SELECT id, repo_id, 'endpoint' node_type, qualified_name FROM end_nodes UNION ALL SELECT id, repo_id, 'module', qualified_name FROM roots",
    "service_roots": "SELECT CASE WHEN n_regionkey = 1 THEN 'old' || n_nationkey ELSE sha256('r' || n_nationkey || chr(1) || 'module' || chr(1) || n_name || '::__service_root__') END id, 'r' || n_nationkey repo_id, n_name || '::__service_root__' qualified_name FROM nation",
    "index_chunks": _INDEX,
    "chunk_whole_ranges": f"""
WITH l AS (SELECT doc_id, {_LINES.format(t="text")} ls FROM documents),
r AS (SELECT doc_id, ls, 1 s, len(ls) e FROM l WHERE len(ls) > 0 UNION ALL SELECT doc_id, ls, 3 s, 5 e FROM l WHERE len(ls) >= 5),
p AS (SELECT doc_id, list_slice(ls, s, e) ls, s, e FROM r),
w AS (SELECT doc_id, s, e, ls, unnest(CASE WHEN e - s + 1 > 120 THEN range(0, greatest(ceil((len(ls) - 60) / 50.0)::BIGINT, 0) + 1) ELSE [-1] END) k FROM p),
c AS (SELECT doc_id, CASE WHEN k < 0 THEN s ELSE s + k * 50 END start_line, CASE WHEN k < 0 THEN e ELSE s - 1 + least(k * 50 + 60, len(ls)) END end_line,
  {_trim("array_to_string(CASE WHEN k < 0 THEN ls ELSE list_slice(ls, k * 50 + 1, k * 50 + 60) END, chr(10))")} content FROM w)
SELECT doc_id, start_line::INT start_line, end_line::INT end_line, md5(content) content_md5 FROM c WHERE content <> ''
""",
    "cosine_topk_queries": f"""
WITH q AS (SELECT vec_id query_id, embedding FROM embeddings WHERE vec_id % 20 = 0),
r AS (SELECT q.query_id, e.vec_id, {_SIM} s, row_number() OVER (PARTITION BY q.query_id ORDER BY {_SIM} DESC NULLS LAST, e.vec_id) rank FROM embeddings e, q)
SELECT query_id, rank::INT rank, vec_id, round(s, 6) similarity FROM r WHERE rank <= 5
""",
    "edges_direct_or_file": """
WITH d AS (SELECT o_custkey node_id, o_orderpriority target_node_id FROM orders GROUP BY ALL),
f AS (SELECT DISTINCT c_nationkey, o_orderpriority target_node_id FROM customer JOIN orders ON o_custkey = c_custkey),
a AS (SELECT c_custkey node_id, target_node_id FROM customer JOIN f USING (c_nationkey))
SELECT node_id, target_node_id, false via_file_level_import FROM d UNION ALL SELECT node_id, target_node_id, true FROM a ANTI JOIN d USING (node_id, target_node_id)
""",
    "hop_options": _EDGES + """
SELECT node_id, md5(string_agg('- id=' || t || ': http_call' || CASE WHEN n % 2 = 0 THEN ' [cross-repo]' ELSE '' END || CASE WHEN confidence = 'inferred' THEN ' (inferred, lower confidence)' ELSE '' END
  || CASE WHEN via THEN ' (an import of the file, not of this code)' ELSE '' END || ' -> ' || name || ' in ' || n || ' (f)', chr(10) ORDER BY via, confidence = 'inferred', name, t)) lines_md5 FROM e GROUP BY node_id
""",
    "edges_by_confidence": "SELECT l_orderkey node_id, CASE WHEN l_returnflag = 'R' THEN 'inferred' ELSE 'confirmed' END confidence, string_agg(s_name, ',' ORDER BY s_name) labels FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2",
    "repo_by_name": "SELECT n_nationkey id, n_name \"name\" FROM nation WHERE n_name = 'NATION_7' UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 3",
    "repo_scope": "SELECT 'two' kind, n_nationkey id, n_regionkey region FROM nation WHERE n_nationkey IN (1, 2) UNION ALL SELECT 'all', n_nationkey, n_regionkey FROM nation",
    "beyond_allow_list": "SELECT user_id, event_type FROM events GROUP BY ALL EXCEPT SELECT user_id, CASE user_id % 3 WHEN 0 THEN 'click' ELSE 'view' END FROM events WHERE user_id % 2 = 0",
}
