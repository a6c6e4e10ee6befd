"""Queries over the driver's tables, one per operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlas.functions import text as X
from atlas.operators import chunk, graph, link, search, tables

from . import answer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- vector search

_SIM = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _first_vector(e: DataFrame) -> list[float]:
    row = e.orderBy("vec_id").select("embedding").first()
    return row[0] if row else [0.0]


@register(f"""
WITH q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT e.vec_id, e.label, round({_SIM}, 6) similarity FROM embeddings e, q ORDER BY {_SIM} DESC NULLS LAST, e.vec_id LIMIT 10
""")
def cosine_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return search.search(e, _first_vector(e), 10, vector="embedding", key="vec_id").select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@register(f"""
WITH q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT e.vec_id, e.label, round({_SIM}, 6) similarity FROM embeddings e, q WHERE e.label IN (1, 3) ORDER BY {_SIM} DESC NULLS LAST, e.vec_id LIMIT 8
""")
def cosine_topk_scoped(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return search.search(e, _first_vector(e), 8, scope=[1, 3], scope_col="label", vector="embedding", key="vec_id").select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


# --- chunks

_LINES = "CASE WHEN {t} LIKE '%' || chr(10) THEN string_split({t}, chr(10))[:-2] ELSE string_split({t}, chr(10)) END"
_TRIM = r"regexp_replace({x}, '^[\s\x0B\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}]+|[\s\x0B\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}]+$', '', 'g')"


def _trim(x: str) -> str:
    return _TRIM.format(x=x)


@register(f"""
WITH l AS (SELECT doc_id, {_LINES.format(t="text")} ls FROM documents),
w AS (SELECT doc_id, ls, unnest(range(0, greatest(ceil((len(ls) - 60) / 50.0)::BIGINT, 0) + 1)) k FROM l WHERE len(ls) > 0),
c AS (SELECT doc_id, (k * 50 + 1)::INT start_line, least(k * 50 + 60, len(ls))::INT end_line, {_trim("array_to_string(list_slice(ls, k * 50 + 1, k * 50 + 60), chr(10))")} content FROM w)
SELECT doc_id, start_line, end_line, md5(content) content_md5 FROM c WHERE content <> ''
""")
def chunk_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunk.windows(d, "text").select("doc_id", "start_line", "end_line", F.md5("content").alias("content_md5"))


@register(f"""
WITH l AS (SELECT doc_id, list_transform(list_zip({_LINES.format(t="text")}, range(len({_LINES.format(t="text")}))), lambda x: CASE WHEN x[2] % 7 = 6 THEN '# ' || x[1] ELSE x[1] END) ls FROM documents),
n AS (SELECT doc_id, unnest(ls) ln, unnest(range(len(ls))) i FROM l),
s AS (SELECT doc_id, ln, i, sum(CASE WHEN ln LIKE '#%' AND i > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) sec FROM n),
c AS (SELECT doc_id, sec, {_trim("string_agg(ln, chr(10) ORDER BY i)")} content FROM s GROUP BY doc_id, sec)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1)::INT section, md5(content) content_md5 FROM c WHERE content <> ''
""")
def chunk_headings(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    marked = F.transform(chunk.lines(F.col("text")), lambda s, i: F.when(i % 7 == 6, F.concat(F.lit("# "), s)).otherwise(s))
    return chunk.headings(d.select("doc_id", F.array_join(marked, "\n").alias("text")), "text").select("doc_id", "section", F.md5("content").alias("content_md5"))


@register("SELECT source, count(*) n FROM documents GROUP BY source")
def chunk_count_by_type(spark, sf_dir):
    return tables.count_by(table(spark, sf_dir, "documents"), "source")


@register(f"""
SELECT item_id, trim(string_split(text, ' ')[1]) method, {_trim("upper(trim(string_split(text, ' ')[1])) || ' /items/' || item_id || ': ' || coalesce(string_split(text, ' ')[2], '') || chr(10) || text")} content FROM benchmark
""")
def endpoint_chunks(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    word = F.split("text", " ", -1)
    method = F.trim(F.get(word, F.lit(0)))
    return b.select("item_id", method.alias("method"), chunk.endpoint_text(method, F.concat(F.lit("/items/"), F.col("item_id").cast("string")), F.get(word, F.lit(1)), F.col("text")).alias("content"))


@register(f"""
WITH r AS (SELECT 'sha' || item_id commit_sha, string_split(text, '.')[1] subject, text body FROM benchmark)
SELECT commit_sha, {_trim(_trim("subject") + " || chr(10) || " + _trim("body"))} content FROM r
""")
def commit_log_parse(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    record = F.concat(F.lit("sha"), F.col("item_id").cast("string"), F.lit("\x1f"), X.trim_all(F.get(F.split("text", r"\.", -1), F.lit(0))), F.lit("\x1f"), X.trim_all(F.col("text")), F.lit("\x1e\n"))
    log = b.groupBy(F.lit("all").alias("repo_id"), F.pmod("item_id", F.lit(16)).alias("part")).agg(F.concat_ws("", F.collect_list(record)).alias("log"))
    return chunk.commits(log).select("commit_sha", "content")


@register(f"""
SELECT conv_id, turn, {_trim("'PR #' || turn || ': ' || role || chr(10) || coalesce(text, '')")} content FROM conversations
""")
def pull_request_chunks(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", chunk.pull_request_text(F.col("turn"), F.col("role"), F.col("text")).alias("content"))


# --- paths, names, questions, citations

_STRIP = "CASE WHEN regexp_replace({u}, '^https?://[^/]*', '') = '' THEN '/' ELSE regexp_replace({u}, '^https?://[^/]*', '') END"
_BARE = "CASE WHEN regexp_matches({p}, '^/(v1|v2|v3|api)(/|$)') THEN regexp_replace({p}, '^/(v1|v2|v3|api)', '') ELSE {p} END"


def _norm(p: str) -> str:
    return f"'/' || array_to_string(list_transform(string_split(regexp_replace({_BARE.format(p=p)}, '^/+|/+$', '', 'g'), '/'), lambda s: CASE WHEN regexp_matches(s, '^([{{:<].*|[0-9]+)$') THEN '*' ELSE s END), '/')"


@register(f"SELECT page_id, {_STRIP.format(u='url')} path FROM pages")
def strip_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.strip_host(F.col("url")).alias("path"))


@register(f"WITH s AS (SELECT page_id, {_STRIP.format(u='url')} p FROM pages) SELECT page_id, {_norm('p')} path FROM s")
def normalize_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.normalize_path(X.strip_host(F.col("url"))).alias("path"))


@register("""
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) literal FROM pages)
SELECT page_id, literal, count(*) n FROM h WHERE regexp_matches(literal, '^https?://') OR (literal LIKE '/%' AND length(literal) > 1) GROUP BY ALL
""")
def url_literal_filter(spark, sf_dir):
    h = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("literal"))
    return tables.count_by(h.where(X.is_url_literal(F.col("literal"))), "page_id", "literal")


@register("SELECT p_partkey, replace(replace(lower(replace(p_name, ' ', '-_')), '-', ''), '_', '') name FROM part")
def name_norm(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.name_norm(F.regexp_replace("p_name", " ", "-_")).alias("name"))


@register("""
SELECT conv_id, turn, CASE WHEN contains(lower(text), 'why') OR contains(lower(text), 'reason') OR contains(lower(text), 'decided') OR contains(lower(text), 'history') THEN 'why_historical'
WHEN contains(lower(text), 'architecture') OR contains(lower(text), 'overview') OR contains(lower(text), 'design') THEN 'architecture_overview'
WHEN contains(lower(text), 'how does') OR contains(lower(text), 'trace') OR contains(lower(text), 'flow') OR contains(lower(text), 'call') THEN 'specific_trace' ELSE 'general' END question_type
FROM conversations
""")
def question_type(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.question_type(F.col("text")).alias("question_type"))


@register("""
WITH u AS (SELECT page_id, 'https://github.com/' || string_split(url, '/')[3] || '/' || page_id || CASE page_id % 3 WHEN 0 THEN '.git' WHEN 1 THEN '/' ELSE '/x' END u FROM pages)
SELECT page_id, nullif(regexp_extract(u, '^https?://github\\.com/([^/]+)/([^/]+?)(?:\\.git)?/?$', 1), '') owner, nullif(regexp_extract(u, '^https?://github\\.com/([^/]+)/([^/]+?)(?:\\.git)?/?$', 2), '') repo FROM u
""".replace("\\\\", "\\"))
def github_owner_repo(spark, sf_dir):
    end = F.when(F.col("page_id") % 3 == 0, ".git").when(F.col("page_id") % 3 == 1, "/").otherwise("/x")
    u = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://github.com/"), F.get(F.split("url", "/", -1), F.lit(2)), F.lit("/"), F.col("page_id").cast("string"), end).alias("u"))
    return u.select("page_id", X.github_owner(F.col("u")).alias("owner"), X.github_repo(F.col("u")).alias("repo"))


@register("""
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE (props::JSON ->> '$.k')::BIGINT END k, event_id % 4 <> 3 parsed FROM events
""")
def json_safe_parse(spark, sf_dir):
    which = F.col("event_id") % 4
    raw = F.when(which == 0, F.col("props")).when(which == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(which == 2, F.concat(F.lit("  ```"), "props", F.lit("``` "))).otherwise(F.concat(F.lit("Sure: "), "props"))
    found = table(spark, sf_dir, "events").select("event_id", X.safe_json(raw, "k bigint").alias("j"))
    return found.select("event_id", F.col("j.k").alias("k"), F.col("j").isNotNull().alias("parsed"))


@register("""
WITH c AS (SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN source || '/' || doc_id || '.md' END p, CASE doc_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 0 END s, CASE WHEN doc_id % 5 < 2 THEN 9 END e, CASE WHEN doc_id % 2 = 0 THEN 'f' || doc_id END q, CASE WHEN doc_id % 5 = 3 THEN md5(doc_id::VARCHAR) END sha, CASE WHEN doc_id % 10 = 4 THEN doc_id END pr, source FROM documents)
SELECT doc_id, CASE WHEN p IS NOT NULL AND coalesce(s, 0) <> 0 AND coalesce(e, 0) <> 0 THEN p || ':' || s || '-' || e || CASE WHEN q IS NOT NULL THEN ' (' || q || ')' ELSE '' END
WHEN p IS NOT NULL THEN p WHEN sha IS NOT NULL THEN 'commit ' || substr(sha, 1, 8) WHEN coalesce(pr, 0) <> 0 THEN 'PR #' || pr ELSE '(' || source || ')' END citation FROM c
""")
def citation(spark, sf_dir):
    i, m = F.col("doc_id"), F.col("doc_id") % 5
    path = F.when(m < 3, F.concat("source", F.lit("/"), i.cast("string"), F.lit(".md")))
    out = X.citation(path, F.when(m == 0, 3).when(m == 1, 0), F.when(m < 2, 9), F.when(i % 2 == 0, F.concat(F.lit("f"), i.cast("string"))), F.when(m == 3, F.md5(i.cast("string"))), F.when(i % 10 == 4, i), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", out.alias("citation"))


@register("""
WITH r AS (SELECT source, doc_id, text, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) i FROM documents),
k AS (SELECT * FROM r WHERE i <= 3)
SELECT source, md5(string_agg('[' || i || '] doc ' || doc_id || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY i)) context_md5, string_agg('[' || i || '] doc ' || doc_id, chr(10) ORDER BY i) sources FROM k GROUP BY source
""")
def context_assembly(spark, sf_dir):
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").withColumn("i", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).where("i <= 3")
    hits = d.select("source", "i", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("citation"), F.col("text").alias("content"))
    return tables.context(hits, ["source"], [F.col("i")]).select("source", F.md5("context").alias("context_md5"), "sources")


# --- graph

@register("""
SELECT l_orderkey source_node_id, l_linenumber id, s_suppkey target_node_id, s_name target_qualified_name, 'f' || s_nationkey target_file_path, n_name target_repo_name
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
""")
def edge_targets(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_node_id"), F.col("l_linenumber").alias("id"), F.col("l_suppkey").alias("target_node_id"))
    n = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("qualified_name"), F.concat(F.lit("f"), F.col("s_nationkey").cast("string")).alias("file_path"), F.col("s_nationkey").alias("repo_id"))
    r = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return graph.edge_targets(e, n, r)


@register("SELECT o_orderstatus edge_type, l_returnflag confidence, count(*) n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def edge_counts(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return tables.count_by(e.select(F.col("o_orderstatus").alias("edge_type"), F.col("l_returnflag").alias("confidence")), "edge_type", "confidence")


@register("SELECT 'c' || c_custkey node_id, 'n' || n_nationkey file_node_id FROM customer JOIN nation ON c_nationkey = n_nationkey")
def enclosing_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.lit(1).alias("repo_id"), F.col("c_nationkey").alias("file_path"), F.lit("function").alias("node_type"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.lit(1).alias("repo_id"), F.col("n_nationkey").alias("file_path"), F.lit("file").alias("node_type"))
    return graph.enclosing_files(c.unionByName(n))


@register("""
WITH o AS (SELECT l_orderkey, l_linenumber, unnest([l_partkey * 7, l_suppkey, l_partkey]) k, unnest([0, 1, 2]) i FROM lineitem),
r AS (SELECT o.*, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY i) n FROM o JOIN part ON k = p_partkey)
SELECT l_orderkey, l_linenumber, k p_partkey, i path_ord FROM r WHERE n = 1
""")
def import_first_match(spark, sf_dir):
    # numbers of lines are repeated: of candidates at the same place the table's first one counts
    at = F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    options = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *at, F.posexplode(F.array(F.col("l_partkey") * 7, "l_suppkey", "l_partkey")).alias("path_ord", "p_partkey"))
    found = graph.first_match(options, table(spark, sf_dir, "part"), ["l_orderkey", "l_linenumber"], ["path_ord", "file", "row"], ["p_partkey"])
    return found.select("l_orderkey", "l_linenumber", "p_partkey", "path_ord")


def _turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    me = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return c.select(me.alias("source_node_id"), F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") + 1).cast("string")).alias("target_node_id")), c.where("turn = 0").select(me.alias("node_id")).distinct()


@register("""
WITH RECURSIVE e AS (SELECT DISTINCT conv_id || '-' || turn a, conv_id || '-' || (turn + 1) b FROM conversations),
p(start_id, node_id, hops) AS (SELECT DISTINCT conv_id || '-' || turn, conv_id || '-' || turn, 0 FROM conversations WHERE turn = 0 UNION ALL SELECT start_id, b, hops + 1 FROM p JOIN e ON a = node_id WHERE hops < 4)
SELECT start_id, node_id, min(hops)::INT hops FROM p GROUP BY ALL
""")
def reachability(spark, sf_dir):
    e, start = _turns(spark, sf_dir)
    return graph.reachable(e, start, 4)


@register("""
WITH RECURSIVE e AS (SELECT DISTINCT conv_id || '-' || turn a, conv_id || '-' || (turn + 1) b FROM conversations),
p(start_id, node_id, hop) AS (SELECT DISTINCT conv_id || '-' || turn, conv_id || '-' || turn, 0 FROM conversations WHERE turn = 0 UNION ALL SELECT start_id, b, hop + 1 FROM p JOIN e ON a = node_id WHERE hop < 4)
SELECT start_id, hop::INT hop, node_id FROM p
""")
def trace_path(spark, sf_dir):
    e, start = _turns(spark, sf_dir)
    options = e.distinct().select(F.col("source_node_id").alias("node_id"), "target_node_id", F.lit(False).alias("via_file_level_import"), F.col("target_node_id").alias("target_qualified_name"))
    return graph.first_option_paths(options, start, 5)


@register("SELECT n_name, r_name || ':' || n_name label FROM nation JOIN region ON n_regionkey = r_regionkey")
def node_labels(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_name", F.concat("r_name", F.lit(":"), "n_name").alias("label"))


@register("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%AR%' ORDER BY p_name, p_partkey LIMIT 5")
def ilike_nodes(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_name").ilike("%AR%")).orderBy("p_name", "p_partkey").limit(5).select("p_partkey", "p_name")


@register("""
WITH c AS (SELECT o_orderkey node_id, min_by(l_returnflag || l_linenumber, (l_linenumber, l_returnflag || l_linenumber)) ch FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 25 GROUP BY 1)
SELECT node_id, coalesce(ch, CASE WHEN node_id % 2 = 0 THEN o_orderpriority END, '(no content available)') content FROM c JOIN orders ON o_orderkey = node_id
""")
def node_contents(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    nodes = o.select(F.col("o_orderkey").alias("id"), F.lit(1).alias("repo_id"), F.col("o_orderkey").alias("file_path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
    chunks = li.where("l_quantity > 25").select(F.col("l_orderkey").alias("graph_node_id"), F.col("l_linenumber").alias("start_line"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("content"))
    files = o.where("o_orderkey % 2 = 0").select(F.lit(1).alias("repo_id"), F.col("o_orderkey").alias("file_path"), F.col("o_orderpriority").alias("content"))
    return graph.node_contents(nodes, chunks, files)


# --- links: hosts are repositories, addresses are endpoints, references are call sites

def _link_tables(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^https?://([^/]*)", 1)
    endpoints = p.select(host.alias("repo"), X.normalize_path(X.strip_host(F.col("url"))).alias("path"), F.col("page_id").alias("ord"))
    # call sites: an address under another scheme, and a mention of a host
    other = F.concat(F.lit("http://gateway/v1"), F.regexp_replace(X.strip_host(F.col("url")), r"^/(v1|v2|v3|api)(?=/|$)", ""))
    calls = p.select(F.col("page_id").alias("call_id"), F.concat(F.lit("m."), host).alias("repo"), F.when(F.col("page_id") % 2 == 0, other).otherwise(F.concat(F.lit("http://"), F.upper(host), F.lit("/none/"), F.col("page_id").cast("string"), F.lit("/x"))).alias("literal"))
    repos = endpoints.groupBy("repo").agg(F.min("ord").alias("ord"))
    return calls, endpoints, repos


_LINK = f"""
WITH h AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/]*)', 1) host, {_STRIP.format(u='url')} p FROM pages),
ep AS (SELECT host repo, {_norm('p')} path, page_id ord FROM h),
c AS (SELECT page_id call_id, 'm.' || host repo, CASE WHEN page_id % 2 = 0 THEN 'http://gateway/v1' || {_BARE.format(p='p')} ELSE 'http://' || upper(host) || '/none/' || page_id || '/x' END literal FROM h),
cs AS (SELECT *, {_STRIP.format(u='literal')} lp FROM c),
cp AS (SELECT *, {_norm('lp')} path FROM cs),
m AS (SELECT call_id, cp.repo, ep.repo target_repo, cp.path, row_number() OVER (PARTITION BY call_id ORDER BY ep.ord, ep.repo) n FROM cp JOIN ep ON cp.path = ep.path AND cp.repo <> ep.repo),
sure AS (SELECT call_id, repo, target_repo, path, 'confirmed' confidence FROM m WHERE n = 1),
r AS (SELECT repo, min(ord) ord FROM ep GROUP BY repo),
g AS (SELECT call_id, c.repo, r.repo target_repo, row_number() OVER (PARTITION BY call_id ORDER BY r.ord, r.repo) n FROM c JOIN r ON c.repo <> r.repo AND contains(translate(lower(literal), '-_', ''), translate(lower(r.repo), '-_', ''))),
maybe AS (SELECT call_id, repo, target_repo, NULL::VARCHAR path, 'inferred' confidence FROM g WHERE n = 1)
"""


@register(_LINK + "SELECT call_id, repo, target_repo, path, confidence FROM sure")
def link_confirmed(spark, sf_dir):
    calls, endpoints, _ = _link_tables(spark, sf_dir)
    return link.confirmed(calls, endpoints).select("call_id", "repo", "target_repo", "path", "confidence")


@register(_LINK + "SELECT call_id, repo, target_repo, confidence FROM maybe")
def link_inferred(spark, sf_dir):
    calls, _, repos = _link_tables(spark, sf_dir)
    return link.inferred(calls, repos).select("call_id", "repo", "target_repo", "confidence")


@register(_LINK + "SELECT * FROM sure UNION ALL SELECT * FROM maybe ANTI JOIN sure USING (call_id)")
def link_priority(spark, sf_dir):
    return link.links(*_link_tables(spark, sf_dir))


@register("""
WITH o AS (SELECT * FROM (VALUES ('NATION_1', 'NATION_2', NULL), ('NATION_3', 'NOWHERE', 'manual'), ('NATION_4', 'NATION_5', 'grpc_call')) t(source_repo, target_repo, edge_type))
SELECT source_repo, target_repo, a.n_nationkey source_id, b.n_nationkey target_id, coalesce(edge_type, 'manual') edge_type, 'confirmed' confidence FROM o JOIN nation a ON a.n_name = source_repo JOIN nation b ON b.n_name = target_repo
""")
def link_manual(spark, sf_dir):
    o = spark.createDataFrame([("NATION_1", "NATION_2", None), ("NATION_3", "NOWHERE", "manual"), ("NATION_4", "NATION_5", "grpc_call")], "source_repo string, target_repo string, edge_type string")
    return link.manual(o, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))


# --- access and table life cycle

_GRANTS = "(SELECT user_id, CASE user_id % 3 WHEN 0 THEN 'click' ELSE 'view' END event_type FROM events WHERE user_id % 2 = 0 GROUP BY ALL)"


def _grants(e: DataFrame) -> DataFrame:
    return e.where("user_id % 2 = 0").select("user_id", F.when(F.col("user_id") % 3 == 0, "click").otherwise("view").alias("event_type")).distinct()


@register(f"""
WITH g AS {_GRANTS}
SELECT event_id, user_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.user_id = e.user_id) OR EXISTS (SELECT 1 FROM g WHERE g.user_id = e.user_id AND g.event_type = e.event_type)
""")
def access_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return tables.allowed(e, _grants(e), "user_id", "event_type")


@register(f"WITH g AS {_GRANTS} SELECT user_id, event_type FROM events ANTI JOIN g USING (user_id) GROUP BY ALL UNION ALL SELECT user_id, event_type FROM g")
def upsert_do_nothing(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type")
    g = _grants(e)
    fresh = e.join(g.select("user_id"), "user_id", "left_anti")
    return tables.insert_new(g, fresh.unionByName(g), ["user_id", "event_type"])


@register("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'inactive' ELSE 'active' END status FROM customer")
def soft_delete(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("status", F.lit("active"))
    return tables.soft_delete(c, F.col("c_nationkey") == 3).select("c_custkey", "status")


@register("""
SELECT 'orders' t, count(*) n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_suppkey IS NOT NULL UNION ALL SELECT 'nulled', count(*) FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)
UNION ALL SELECT 'parent', count(*) FROM customer WHERE c_nationkey <> 3
""")
def cascade_delete(spark, sf_dir):
    c, o, li, s = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "supplier"))
    a = tables.delete_cascade(c, c.where("c_nationkey = 3"), "c_custkey", {"orders": (o, "o_custkey")})
    b = tables.delete_cascade(s, s.where("s_nationkey = 3"), "s_suppkey", {}, {"lineitem": (li, "l_suppkey")})
    count = lambda name, df, what="*": df.agg(F.lit(name).alias("t"), F.count(what).alias("n"))
    nulled = b["lineitem"].where("l_suppkey is null")
    return count("orders", a["orders"]).unionByName(count("lineitem", b["lineitem"])).unionByName(count("nulled", nulled)).unionByName(count("parent", a["parent"]))


@register("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT DISTINCT c_nationkey + 20, 'service_root' FROM customer WHERE c_nationkey + 20 NOT IN (SELECT n_nationkey FROM nation)")
def get_or_create(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    wanted = table(spark, sf_dir, "customer").select((F.col("c_nationkey") + 20).alias("n_nationkey"), F.lit("service_root").alias("n_name"))
    return tables.get_or_create(n, wanted, ["n_nationkey"])


@register("""
SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 10 = 0 THEN 'new' ELSE o_orderstatus END o_orderstatus FROM orders WHERE NOT (o_custkey % 10 = 0 AND o_orderkey % 2 = 1)
""")
def sync_replace(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    fresh = o.where("o_custkey % 10 = 0 and o_orderkey % 2 = 0").withColumn("o_orderstatus", F.lit("new"))
    gone = o.where("o_custkey % 10 = 0 and o_orderkey % 2 = 1")
    kept = tables.replace_rows(o, fresh, "o_custkey")
    return kept.join(gone.select("o_orderkey"), "o_orderkey", "left_anti").select("o_orderkey", "o_custkey", "o_orderstatus")


@register(f"""
WITH g AS {_GRANTS}, q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1), a AS (SELECT DISTINCT label FROM embeddings WHERE label % 2 = 0)
SELECT e.vec_id, round({_SIM}, 6) similarity FROM embeddings e, q WHERE e.label IN (SELECT label FROM a) AND e.label < 6 ORDER BY {_SIM} DESC NULLS LAST, e.vec_id LIMIT 8
""")
def retrieve(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    grants = e.where("label % 2 = 0").select(F.lit("u").alias("user_id"), F.col("label").alias("repo_id")).distinct()
    found = answer.retrieve(e.withColumnRenamed("label", "repo_id"), grants, "u", [0, 1, 2, 3, 4, 5], _first_vector(e), key="vec_id")
    return found.select("vec_id", F.round("similarity", 6).alias("similarity"))


def queries():
    from . import fixtures, journeys, products

    return QUERIES | products.QUERIES | fixtures.QUERIES | journeys.QUERIES


def oracle_sql():
    from . import fixtures, journeys, products

    return SQL | products.SQL | fixtures.SQL | journeys.SQL
