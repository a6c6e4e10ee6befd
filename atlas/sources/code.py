"""Source files as a code graph: one Arrow pass parses every file once, everything else is joins."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlas.operators.graph import first_match
from atlas.operators.tables import node_id

from . import parse_js, parse_py

# Languages by extension, endings of documents, and folders that are never listed.
LANGUAGES = {".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript"}
DOCUMENTS = [".md", ".mdx", ".rst"]
IGNORED = {".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".mypy_cache", ".pytest_cache"}
PARSED = "repo_id string, file_path string, language string, error string, definitions array<struct<node_type string, name string, start_line int, end_line int, nth int>>, raw_imports array<string>, calls array<string>, call_site_literals array<string>"
_ARROW = pa.schema([("repo_id", pa.string()), ("file_path", pa.string()), ("language", pa.string()), ("error", pa.string()), ("definitions", pa.list_(pa.struct([("node_type", pa.string()), ("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("nth", pa.int32())]))), ("raw_imports", pa.list_(pa.string())), ("calls", pa.list_(pa.string())), ("call_site_literals", pa.list_(pa.string()))])


def read_files(spark, root: str, repo_id: str, extensions: list[str] | None = None) -> DataFrame:
    """source_files of a checked-out repository by Spark's own reader: repo_id, file_path (relative) and content. Bad bytes are dropped."""
    endings = "|".join(re.escape(e) for e in (extensions or LANGUAGES))
    wanted = "*{" + ",".join(extensions or LANGUAGES) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", wanted).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"
    path = F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", "")
    relative = F.substring(path, len(base) + 1, 1 << 20)
    ignored = "|".join(re.escape(x) for x in sorted(IGNORED))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("repo_id"), batch.column("file_path"), pa.array([(b or b"").decode("utf-8", "ignore") for b in batch.column("content").to_pylist()], pa.string())], names=["repo_id", "file_path", "content"])

    kept = found.select(F.lit(repo_id).alias("repo_id"), relative.alias("file_path"), "content").where(F.col("file_path").rlike(f"({endings})$") & ~F.col("file_path").rlike(f"(^|/)({ignored})/"))
    return kept.mapInArrow(decoded, "repo_id string, file_path string, content string")


def _parse(strict: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {name: [] for name in _ARROW.names[2:]}
            for path, content in zip(batch.column("file_path").to_pylist(), batch.column("content").to_pylist()):
                language = next((v for k, v in LANGUAGES.items() if path.endswith(k)), None)
                error, found = None, parse_py.Parsed()
                try:
                    found = (parse_py if language == "python" else parse_js).parse(content or "", strict)
                except Exception as e:  # noqa: BLE001  one bad file doesn't stop the others; it becomes an error row
                    error = f"{type(e).__name__}: {e}"
                same: Counter = Counter()  # definitions of one kind and name are told apart by their order, not by their lines, which move
                definitions = []
                for d in found.definitions:
                    definitions.append((*d, same[d[:2]]))
                    same[d[:2]] += 1
                for column, value in zip(rows.values(), (language, error, definitions, found.imports, found.calls, found.literals)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("repo_id"), batch.column("file_path"), *(pa.array(values, _ARROW.field(name).type) for name, values in rows.items())], schema=_ARROW)

    return run


def parse_files(files: DataFrame, strict: bool = False) -> DataFrame:
    """One row a file: what the parsers found, or the error. Write or cache it: every table below reads it."""
    known = files.where(F.col("file_path").rlike("(" + "|".join(re.escape(e) for e in LANGUAGES) + ")$"))
    return known.select("repo_id", "file_path", "content").mapInArrow(_parse(strict), PARSED)


def nodes(parsed: DataFrame) -> DataFrame:
    """graph_nodes: files, functions and classes, and one node of mapping errors for each repository that has some."""
    good = parsed.where("error is null")
    none = F.lit(None)
    files = good.select(node_id(F.col("repo_id"), F.lit("file"), F.col("file_path")).alias("id"), "repo_id", F.lit("file").alias("node_type"), F.col("file_path").alias("qualified_name"), "file_path", "language", none.cast("int").alias("start_line"), none.cast("int").alias("end_line"), "raw_imports", "call_site_literals")
    d = good.select("repo_id", "file_path", F.posexplode("definitions").alias("ord", "d"))
    name = F.concat("file_path", F.lit("::"), F.col("d.name"))
    defs = d.select(node_id(F.col("repo_id"), F.col("d.node_type"), name, F.col("d.nth")).alias("id"), "repo_id", F.col("d.node_type").alias("node_type"), name.alias("qualified_name"), "file_path", none.cast("string").alias("language"), F.col("d.start_line").alias("start_line"), F.col("d.end_line").alias("end_line"), none.cast("array<string>").alias("raw_imports"), none.cast("array<string>").alias("call_site_literals"))
    out = files.unionByName(defs).withColumn("skipped_files", none.cast("array<struct<file_path:string,error:string>>"))
    bad = parsed.where("error is not null").groupBy("repo_id").agg(F.sort_array(F.collect_list(F.struct("file_path", "error"))).alias("skipped_files"))
    errors = bad.select(node_id(F.col("repo_id"), F.lit("module"), F.lit("__mapping_errors__")).alias("id"), "repo_id", F.lit("module").alias("node_type"), F.lit("__mapping_errors__").alias("qualified_name"), F.lit("").alias("file_path"), "skipped_files")
    return out.unionByName(errors, allowMissingColumns=True)


def import_candidates(raw: str, file_path: str) -> list[str]:
    """Paths that an import can mean, the likeliest first."""
    folder = file_path.rpartition("/")[0]
    raw = " ".join(raw.split())
    if m := re.match(r"from (\.+)([\w.]*) import", raw):
        base = folder.split("/") if folder else []
        up = len(m[1]) - 1
        if up > len(base):
            return []
        parts = base[: len(base) - up]
        return ["/".join([*parts, *m[2].split(".")]) + ".py"] if m[2] else ["/".join([*parts, "__init__.py"])]
    if m := re.search(r"""from ['"]([^'"]+)['"]""", raw):
        if not m[1].startswith("."):
            return []
        parts = folder.split("/") if folder else []
        for step in m[1].split("/"):
            if step == "..":
                if not parts:
                    return []
                parts = parts[:-1]
            elif step != ".":
                parts = [*parts, step]
        return ["/".join(parts) + e for e in (".ts", ".tsx", ".js", ".jsx")]
    if m := re.match(r"from ([\w.]+) import", raw):
        path = m[1].replace(".", "/")
        beside = [f"{folder}/{path}.py" if folder else f"{path}.py"] if "." not in m[1] else []
        return [f"{path}.py", f"{path}/__init__.py", *beside]
    if m := re.match(r"import ([\w.]+)(?: as \w+)?$", raw):
        path = m[1].replace(".", "/")
        return [f"{path}.py", *([f"{folder}/{path}.py" if folder else f"{path}.py"] if "." not in m[1] else [])]
    return []


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [{"repo_id": r["repo_id"], "source_path": r["source_path"], "import_ord": r["import_ord"], "path_ord": i, "file_path": p} for r in batch.to_pylist() for i, p in enumerate(import_candidates(r["raw"], r["source_path"]))]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("repo_id", pa.string()), ("source_path", pa.string()), ("import_ord", pa.int32()), ("path_ord", pa.int32()), ("file_path", pa.string())]))


def edges(parsed: DataFrame) -> DataFrame:
    """graph_edges: defines (file to definition), calls (file to the last definition of a name, one for each call) and imports (once a pair of files)."""
    good = parsed.where("error is null")
    d = good.select("repo_id", "file_path", F.posexplode("definitions").alias("ord", "d"))
    name = F.concat("file_path", F.lit("::"), F.col("d.name"))
    file = node_id(F.col("repo_id"), F.lit("file"), F.col("file_path"))
    d = d.select("repo_id", "file_path", "ord", F.col("d.name").alias("name"), file.alias("source_node_id"), node_id(F.col("repo_id"), F.col("d.node_type"), name, F.col("d.nth")).alias("target_node_id"))
    defines = d.select("repo_id", "source_node_id", "target_node_id", F.lit("defines").alias("edge_type"), F.lit(0).alias("ordinal"))
    last = d.groupBy("repo_id", "file_path", "name").agg(F.max_by("target_node_id", "ord").alias("target_node_id"))
    sites = good.select("repo_id", "file_path", file.alias("source_node_id"), F.posexplode("calls").alias("ordinal", "name"))
    calls = sites.join(last, ["repo_id", "file_path", "name"]).select("repo_id", "source_node_id", "target_node_id", F.lit("calls").alias("edge_type"), "ordinal")
    raw = good.select("repo_id", F.col("file_path").alias("source_path"), F.posexplode("raw_imports").alias("import_ord", "raw"))
    options = raw.mapInArrow(_candidates, "repo_id string, source_path string, import_ord int, path_ord int, file_path string")
    found = first_match(options, good, ["repo_id", "source_path", "import_ord"], ["path_ord"], ["repo_id", "file_path"])
    imports = found.select("repo_id", node_id(F.col("repo_id"), F.lit("file"), F.col("source_path")).alias("source_node_id"), file.alias("target_node_id")).distinct().select("*", F.lit("imports").alias("edge_type"), F.lit(0).alias("ordinal"))
    both = defines.unionByName(calls).unionByName(imports)
    return both.select(node_id(F.col("source_node_id"), F.col("target_node_id"), F.col("edge_type"), F.col("ordinal")).alias("id"), "repo_id", "source_node_id", "target_node_id", "edge_type", F.lit(False).alias("is_cross_repo"), F.lit("confirmed").alias("confidence"))
