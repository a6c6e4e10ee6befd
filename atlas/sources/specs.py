"""API descriptions, commit logs, pull requests and link overrides as tables."""

from __future__ import annotations

import json
import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlas.functions.text import normalize_path
from atlas.operators import chunk

# Names of API descriptions, hints in other names, HTTP methods, how many commits are read, where overrides stand.
SPEC_NAMES = ["openapi.yaml", "openapi.yml", "openapi.json", "swagger.yaml", "swagger.yml", "swagger.json"]
SPEC_HINTS, METHODS, COMMITS = ["spec", "openapi", "swagger"], ["get", "post", "put", "delete", "patch"], 200
LINKS_SETTING, LINKS_FILE = "CROSS_REPO_LINKS_CONFIG", "./cross_repo_links.yaml"
_ENDPOINT = pa.schema([("repo_id", pa.string()), ("file_path", pa.string()), ("ord", pa.int32()), ("method", pa.string()), ("path", pa.string()), ("summary", pa.string()), ("description", pa.string())])


def _load(text: str, name: str):
    if name.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def operations(text: str, name: str) -> list[tuple[str, str, str | None, str | None]]:
    """method, path, summary and description of each operation; none if the text is no API description."""
    base = name.rpartition("/")[2].lower()
    try:
        spec = _load(text, base)
    except Exception:  # noqa: BLE001  whatever a parser says, the file is no description
        return []
    if not isinstance(spec, dict) or (base not in SPEC_NAMES and not ({"openapi", "swagger"} & set(spec))):
        return []
    paths = spec.get("paths")
    out = []
    for path, item in (paths.items() if isinstance(paths, dict) else ()):
        for method, about in (item.items() if isinstance(item, dict) else ()):
            if str(method).lower() in METHODS:
                about = about if isinstance(about, dict) else {}
                out.append((str(method).lower(), str(path), about.get("summary"), about.get("description")))
    return out


def openapi_endpoints(files: DataFrame) -> DataFrame:
    """repo_id, file_path, ord, method, path (as written), summary, description. Names are sifted before any file is parsed."""
    base = F.lower(F.element_at(F.split("file_path", "/"), -1))
    hinted = base.rlike(r"\.(ya?ml|json)$") & base.rlike("|".join(SPEC_HINTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [dict(zip(_ENDPOINT.names, (r["repo_id"], r["file_path"], i, *op))) for r in batch.to_pylist() for i, op in enumerate(operations(r["content"] or "", r["file_path"]))]
            yield pa.RecordBatch.from_pylist(rows, schema=_ENDPOINT)

    return files.where(base.isin(SPEC_NAMES) | hinted).select("repo_id", "file_path", "content").mapInArrow(run, "repo_id string, file_path string, ord int, method string, path string, summary string, description string")


def proto_rpcs(files: DataFrame) -> DataFrame:
    """repo_id, file_path and path (Service.Rpc) of each rpc. A service's text ends at the first closing brace."""
    services = files.where(F.col("file_path").endswith(".proto")).select("repo_id", "file_path", F.arrays_zip(F.regexp_extract_all("content", F.lit(r"(?s)service\s+(\w+)\s*\{(.*?)\}"), F.lit(1)).alias("s"), F.regexp_extract_all("content", F.lit(r"(?s)service\s+(\w+)\s*\{(.*?)\}"), F.lit(2)).alias("b")).alias("z"))
    one = services.select("repo_id", "file_path", F.posexplode("z").alias("so", "z"))
    rpcs = one.select("repo_id", "file_path", "so", F.col("z.s").alias("service"), F.posexplode(F.regexp_extract_all(F.col("z.b"), F.lit(r"rpc\s+(\w+)\s*\("), F.lit(1))).alias("ro", "rpc"))
    return rpcs.select("repo_id", "file_path", (F.col("so") * 1000 + F.col("ro")).alias("ord"), F.concat_ws(".", "service", "rpc").alias("path"))


def endpoints(files: DataFrame) -> DataFrame:
    """Endpoints of API descriptions (normalised paths) and of service definitions, by repository, file and place."""
    api = openapi_endpoints(files).select("repo_id", "file_path", "ord", "method", F.col("path").alias("written"), normalize_path(F.col("path")).alias("path"))
    rpc = proto_rpcs(files).select("repo_id", "file_path", "ord", F.lit(None).cast("string").alias("method"), F.col("path").alias("written"), "path")
    return api.unionByName(rpc)


def git_log(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """repo_id and log of clones, as chunk.commits() reads it; git runs on the executors. A folder that git can't read has an empty log."""
    from .remote import clones

    return clones(spark, folders, "log")


def list_files(folder: str) -> list[str]:
    """Paths of a clone: what git tracks, else all files outside ignored folders."""
    from .code import IGNORED

    done = subprocess.run(["git", "-C", folder, "ls-files"], capture_output=True, text=True, check=False)
    if done.returncode == 0:
        return sorted(x for x in done.stdout.split("\n") if x)
    out = []
    for at, folders, names in os.walk(folder):
        folders[:] = [f for f in folders if f not in IGNORED]
        out += [os.path.relpath(os.path.join(at, n), folder).replace(os.sep, "/") for n in names]
    return sorted(out)


def pull_requests(spark: SparkSession, path: str) -> DataFrame:
    """pr_number, state and content from a JSON-lines dump of pull requests."""
    rows = spark.read.schema("number int, title string, body string, state string").json(path)
    return rows.select(F.col("number").alias("pr_number"), "state", chunk.pull_request_text(F.col("number"), F.col("title"), F.col("body")).alias("content"))


def manual_links(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Overrides from a YAML file with a list `links`: that of path, else of the setting, else the file of the usual name; no file: none."""
    path, rows = path or os.environ.get(LINKS_SETTING, LINKS_FILE), []
    if path and os.path.exists(path):
        with open(path) as f:
            rows = [(x.get("source_repo"), x.get("target_repo"), x.get("edge_type")) for x in (_load(f.read(), path) or {}).get("links") or []]
    return spark.createDataFrame(rows, "source_repo string, target_repo string, edge_type string")
