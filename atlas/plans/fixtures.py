"""Queries over source files that are made from the supplier and part tables: Python, TypeScript, API descriptions, service definitions, files that don't parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlas.operators import chunk, graph
from atlas.operators.rounds import Rounds
from atlas.sources import code, specs

#: Tasks for each core that rows are dealt to before files are made of them.
DEALT = 4


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt to all cores by a key. The narrow rows of a table stand in a few splits, however long the files made of them take to parse."""
    return rows.repartition(DEALT * rows.sparkSession.sparkContext.defaultParallelism, key)


def _parsed(files: DataFrame) -> DataFrame:
    """What the parsers found, written: nodes and edges read it several times."""
    return Rounds(files.sparkSession).table(code.parse_files(files))


def supplier_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file for each supplier, and one for each nation that theirs import; a nation is a repository."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("k"), F.col("s_nationkey").cast("string").alias("n"))
    source = F.concat(
        F.lit("import os\nfrom kit"), "n", F.lit(" import weigh\n\nHOST = 'http://nation-"), "n", F.lit("'\n\n\ndef offer_"), "k", F.lit("(part):\n    address = f'{HOST}/offers/"), "k",
        F.lit("/{part}'\n    return ask(address)\n\n\nclass Stock"), "k", F.lit(":\n    pass\n\n\noffer_"), "k", F.lit("(1)\n"),
    )
    mine = _dealt(s, "k").select(F.col("n").alias("repo_id"), F.concat(F.lit("s"), "k", F.lit(".py")).alias("file_path"), source.alias("content"))
    kits = s.select("n").distinct().select(F.col("n").alias("repo_id"), F.concat(F.lit("kit"), "n", F.lit(".py")).alias("file_path"), F.lit("def weigh(x):\n    return x\n").alias("content"))
    return mine.unionByName(kits)


def source_nodes(spark, sf_dir):
    return code.nodes(_parsed(supplier_files(spark, sf_dir))).select("repo_id", "node_type", "qualified_name", "start_line", "end_line")


def source_edges(spark, sf_dir):
    parsed = _parsed(supplier_files(spark, sf_dir))
    n = code.nodes(parsed)
    a, b = (n.select(F.col("id").alias(f"{s}_node_id"), F.col("qualified_name").alias(s)) for s in ("source", "target"))
    return code.edges(parsed).join(a, "source_node_id").join(b, "target_node_id").select("repo_id", "edge_type", "source", "target")


def source_literals(spark, sf_dir):
    return code.parse_files(supplier_files(spark, sf_dir)).select("repo_id", "file_path", F.posexplode("call_site_literals").alias("ord", "literal"))


def nodes_with_literals(spark, sf_dir):
    nodes = code.nodes(_parsed(supplier_files(spark, sf_dir)))
    return nodes.where(F.size("call_site_literals") > 0).select("repo_id", "qualified_name")


def precise_nodes(spark, sf_dir):
    return graph.precise_nodes(code.nodes(_parsed(supplier_files(spark, sf_dir)))).select("repo_id", "qualified_name")


# --- TypeScript: a module for each part, in the folder of its brand, which imports the brand's; every fifth one doesn't parse


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("n"), F.col("p_partkey").cast("string").alias("k"), F.regexp_replace("p_brand", "[^A-Za-z0-9]", "-").alias("brand"))
    source = F.concat(
        F.lit("import { Brand } from './brand';\nconst ROOT = 'https://parts.example';\n// function none"), "k", F.lit("() {}\nexport async function view"), "k", F.lit("(id) {\n  let path = '/parts/"), "k",
        F.lit("';\n  if (id > 9) {\n    const path = '/old/"), "k", F.lit("';\n    ask(path);\n  } else {\n    const path = '/new/"), "k", F.lit("';\n    ask(path);\n  }\n  return fetch(`${ROOT}/parts/"), "k", F.lit("/${id}`);\n}\nclass Card"), "k",
        F.lit(" {}\nconst show"), "k", F.lit(" = (id) => {\n  return view"), "k", F.lit("(id);\n};\n"),
    )
    cut = F.when(F.col("n") % 5 == 0, F.concat(F.lit("function open() {\n"), source)).otherwise(source)
    mine = _dealt(p, "n").select("brand", F.concat(F.lit("src/p"), "k", F.lit(".ts")).alias("file_path"), cut.alias("content"))
    brands = p.select("brand", F.lit("src/brand.ts").alias("file_path"), F.lit("export class Brand {}\n").alias("content")).distinct()
    return mine.unionByName(brands).withColumnRenamed("brand", "repo_id")


def web_nodes(spark, sf_dir):
    return code.nodes(_parsed(part_files(spark, sf_dir))).where("node_type <> 'module'").select("repo_id", "node_type", "qualified_name", "start_line", "end_line")


def web_literals(spark, sf_dir):
    return code.parse_files(part_files(spark, sf_dir)).select("repo_id", "file_path", F.posexplode("call_site_literals").alias("ord", "literal"))


def mapping_errors(spark, sf_dir):
    return graph.mapping_errors(code.nodes(_parsed(part_files(spark, sf_dir)))).select("repo_id", "file_path")


# --- API descriptions and service definitions: one of each kind for a supplier


def supplier_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YAML for even suppliers, JSON for odd ones; every seventh file has a name that only hints, and every eleventh no mark of a description."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("n"), F.col("s_suppkey").cast("string").alias("k"))
    even = F.col("n") % 2 == 0
    mark = F.when(F.col("n") % 11 == 0, "title").otherwise("openapi")
    yaml = F.concat(mark, F.lit(": 3.0.0\npaths:\n  /v1/s"), "k", F.lit("/offers/{offer}:\n    get:\n      summary: Offers of "), "k", F.lit("\n    x-note: none\n    PUT:\n      description: Puts one\n  /s"), "k", F.lit("/:\n    delete: {}\n"))
    json = F.concat(F.lit('{"'), mark, F.lit('": "2", "paths": {"/v1/s'), "k", F.lit('/offers/{offer}": {"get": {"summary": "Offers of '), "k", F.lit('"}, "x-note": 1, "PUT": {"description": "Puts one"}}, "/s'), "k", F.lit('/": {"delete": {}}}}'))
    name = F.concat(F.lit("api/"), "k", F.lit("/"), F.when(F.col("n") % 7 == 0, F.concat(F.lit("spec-"), "k")).otherwise("openapi"), F.when(even, ".yaml").otherwise(".json"))
    return s.select(F.lit("r").alias("repo_id"), name.alias("file_path"), F.when(even, yaml).otherwise(json).alias("content"))


def openapi_rows(spark, sf_dir):
    found = specs.openapi_endpoints(supplier_specs(spark, sf_dir))
    return found.select("file_path", "ord", "method", "path", chunk.endpoint_text(F.col("method"), F.col("path"), F.col("summary"), F.col("description")).alias("content"))


def endpoint_paths(spark, sf_dir):
    """Normalised paths of the descriptions, and rpcs, as links compare them."""
    files = supplier_specs(spark, sf_dir).unionByName(supplier_protos(spark, sf_dir))
    return specs.endpoints(files).select("file_path", "method", "path")


def supplier_protos(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("k"))
    text = F.concat(F.lit("message Offer { string id = 1; }\nservice Shop"), "k", F.lit(" {\n  rpc Find(Id) returns (Offer);\n  rpc  Take"), "k", F.lit(" (Id) returns (Offer);\n}\nservice Desk { rpc Open(Day) returns (Hours); }\n"))
    return s.select(F.lit("r").alias("repo_id"), F.concat(F.lit("proto/"), "k", F.lit(".proto")).alias("file_path"), text.alias("content"))


def proto_rows(spark, sf_dir):
    return specs.proto_rpcs(supplier_protos(spark, sf_dir)).select("file_path", "ord", "path")


_FILES = "WITH s AS (SELECT s_suppkey::VARCHAR k, s_nationkey::VARCHAR n FROM supplier), f AS (SELECT n repo_id, 's' || k || '.py' p, k, n FROM s), m AS (SELECT DISTINCT n repo_id, 'kit' || n || '.py' p, n FROM s) "
_PARTS = "WITH b AS (SELECT regexp_replace(p_brand, '[^A-Za-z0-9]', '-', 'g') repo_id, p_partkey n, p_partkey::VARCHAR k, 'src/p' || p_partkey || '.ts' p FROM part), f AS (SELECT * FROM b WHERE n % 5 <> 0) "
API = """
SELECT 'api/' || s_suppkey || '/' || CASE WHEN s_suppkey % 7 = 0 THEN 'spec-' || s_suppkey ELSE 'openapi' END || CASE WHEN s_suppkey % 2 = 0 THEN '.yaml' ELSE '.json' END file_path, ord, method,
  CASE WHEN ord = 2 THEN '/s' || s_suppkey || '/' ELSE '/v1/s' || s_suppkey || '/offers/{offer}' END AS path, CASE WHEN ord = 0 THEN 'Offers of ' || s_suppkey END summary, CASE WHEN ord = 1 THEN 'Puts one' END description
FROM supplier, (VALUES (0, 'get'), (1, 'put'), (2, 'delete')) o(ord, method) WHERE s_suppkey % 11 <> 0 OR s_suppkey % 7 <> 0
"""
_RPC = "SELECT 'proto/' || s_suppkey || '.proto' file_path, ord::INT ord, CASE ord WHEN 0 THEN 'Shop' || s_suppkey || '.Find' WHEN 1 THEN 'Shop' || s_suppkey || '.Take' || s_suppkey ELSE 'Desk.Open' END AS path FROM supplier, (VALUES (0), (1), (1000)) o(ord)"
QUERIES = {f.__name__: f for f in (source_nodes, source_edges, source_literals, nodes_with_literals, precise_nodes, web_nodes, web_literals, mapping_errors, openapi_rows, endpoint_paths, proto_rows)}
SQL = {
    "source_nodes": _FILES + """
SELECT repo_id, 'file' node_type, p qualified_name, NULL::INT start_line, NULL::INT end_line FROM f UNION ALL SELECT repo_id, 'file', p, NULL, NULL FROM m
UNION ALL SELECT repo_id, 'function', p || '::offer_' || k, 7, 9 FROM f UNION ALL SELECT repo_id, 'class', p || '::Stock' || k, 12, 13 FROM f UNION ALL SELECT repo_id, 'function', p || '::weigh', 1, 2 FROM m""",
    "source_edges": _FILES + """
SELECT repo_id, 'defines' edge_type, p source, p || '::offer_' || k target FROM f UNION ALL SELECT repo_id, 'defines', p, p || '::Stock' || k FROM f UNION ALL SELECT repo_id, 'defines', p, p || '::weigh' FROM m
UNION ALL SELECT repo_id, 'calls', p, p || '::offer_' || k FROM f UNION ALL SELECT repo_id, 'imports', p, 'kit' || n || '.py' FROM f""",
    "source_literals": _FILES + "SELECT repo_id, p file_path, 0 ord, 'http://nation-' || n || '/offers/' || k || '/{}' literal FROM f",
    "nodes_with_literals": _FILES + "SELECT repo_id, p qualified_name FROM f",
    "precise_nodes": _FILES + "SELECT repo_id, p || '::offer_' || k qualified_name FROM f UNION ALL SELECT repo_id, p || '::Stock' || k FROM f UNION ALL SELECT repo_id, p || '::weigh' FROM m",
    "web_nodes": _PARTS + """
SELECT repo_id, 'file' node_type, p qualified_name, NULL::INT start_line, NULL::INT end_line FROM f UNION ALL SELECT repo_id, 'function', p || '::view' || k, 4, 14 FROM f UNION ALL SELECT repo_id, 'class', p || '::Card' || k, 15, 15 FROM f
UNION ALL SELECT repo_id, 'function', p || '::show' || k, 16, 18 FROM f UNION ALL SELECT DISTINCT repo_id, 'file', 'src/brand.ts', NULL::INT, NULL::INT FROM b UNION ALL SELECT DISTINCT repo_id, 'class', 'src/brand.ts::Brand', 1, 1 FROM b""",
    "web_literals": _PARTS + "SELECT repo_id, p file_path, ord, CASE ord WHEN 0 THEN '/old/' || k WHEN 1 THEN '/new/' || k ELSE 'https://parts.example/parts/' || k || '/{}' END literal FROM f, (VALUES (0), (1), (2)) o(ord)",
    "mapping_errors": "SELECT regexp_replace(p_brand, '[^A-Za-z0-9]', '-', 'g') repo_id, 'src/p' || p_partkey || '.ts' file_path FROM part WHERE p_partkey % 5 = 0",
    "openapi_rows": "SELECT file_path, ord::INT ord, method, path, rtrim(upper(method) || ' ' || path || ': ' || coalesce(summary, '') || CASE WHEN description IS NULL THEN '' ELSE chr(10) || description END) AS content FROM (" + API + ")",
    "endpoint_paths": "SELECT file_path, method, regexp_replace(replace(replace(path, '/v1/', '/'), '{offer}', '*'), '/$', '') AS path FROM (" + API + ") UNION ALL SELECT file_path, NULL, path FROM (" + _RPC + ")",
    "proto_rows": _RPC,
}
