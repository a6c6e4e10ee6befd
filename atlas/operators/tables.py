"""Table life cycle: every change is a new snapshot, made from the old one by joins."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def allowed(rows: DataFrame, grants: DataFrame, user: str, resource: str) -> DataFrame:
    """Rows whose user has no grant at all, or one for the row's resource."""
    some = grants.select(F.col(user)).distinct().withColumn("_some", F.lit(True))
    pair = grants.select(user, resource).distinct().withColumn("_pair", F.lit(True))
    return rows.join(some, user, "left").join(pair, [user, resource], "left").where("_some is null or _pair").drop("_some", "_pair")


def insert_new(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """table and those rows whose key it hasn't got; of rows with one key the first."""
    fresh = rows.dropDuplicates(key).join(table.select(*key), key, "left_anti")
    return table.unionByName(fresh.select(*table.columns))


get_or_create = insert_new


def soft_delete(repos: DataFrame, which: Column) -> DataFrame:
    return repos.withColumn("status", F.when(which, "inactive").otherwise(F.col("status")))


def delete_cascade(parent: DataFrame, gone: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]], set_null: dict[str, tuple[DataFrame, str]] | None = None) -> dict[str, DataFrame]:
    """Without the parents in gone: children that refer to them go, or lose their reference."""
    ids = gone.select(key).distinct()
    out = {"parent": parent.join(ids, key, "left_anti")}
    for name, (child, ref) in children.items():
        out[name] = child.join(ids.withColumnRenamed(key, ref), ref, "left_anti").select(*child.columns)
    for name, (child, ref) in (set_null or {}).items():
        marked = child.join(ids.withColumnRenamed(key, ref).withColumn("_gone", F.lit(True)), ref, "left")
        out[name] = marked.withColumn(ref, F.when(F.col("_gone"), None).otherwise(F.col(ref))).select(*child.columns)
    return out


def replace_rows(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with all rows of each key in rows replaced."""
    return table.join(rows.select(key).distinct(), key, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def node_id(*parts: Column) -> Column:
    """A deterministic id, the same in every run and retry."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


class View:
    """All tables of one manifest: what is read through it belongs together, whatever is written meanwhile."""

    def __init__(self, spark: SparkSession, root: str, manifest: dict):
        self.spark, self.root, self.manifest = spark, root, manifest

    @property
    def version(self) -> int:
        return self.manifest["version"]

    def __contains__(self, name: str) -> bool:
        return name in self.manifest["tables"]

    def keys(self, name: str) -> list[str]:
        return sorted(self.manifest["tables"][name]["parts"])

    def read(self, name: str, keys: list[str] | None = None) -> DataFrame:
        """A table, or those of its parts that keys name; only their folders are listed and read."""
        about = self.manifest["tables"][name]
        schema = T.StructType.fromJson(about["schema"])
        found = [f"{self.root}/{at}" for key, at in sorted(about["parts"].items()) if keys is None or key in keys]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)


class Conflict(RuntimeError):
    """Another writer has committed since the view that a commit was made from."""


class Snapshots:
    """Tables in parts (one for each repository, say), as Parquet folders that are never changed, and numbered manifests that name the parts of all tables.

    A commit writes new folders for the parts that change, and then one manifest: all changes become current at once, and parts that don't
    change are neither read nor written. A manifest gets its number by a rename that fails where the number is taken, so of two writers that
    began at one version one gets Conflict. vacuum() removes what old manifests alone refer to. Spark's writers and readers and the Hadoop file system do
    all of it; a manifest holds one line for each part, about a hundred bytes.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        fs, at = self._fs(f"{self.root}/manifests")
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def view(self, version: int | None = None) -> View:
        """The tables of a version: of the last one, unless told otherwise."""
        known = self.versions()
        if not known:
            return View(self.spark, self.root, {"version": 0, "tables": {}})
        fs, at = self._fs(f"{self.root}/manifests/{version or known[-1]:09d}.json")
        stream = fs.open(at)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return View(self.spark, self.root, json.loads(text))

    def read(self, name: str, keys: list[str] | None = None) -> DataFrame:
        return self.view().read(name, keys)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """A table of one part, replaced as a whole."""
        return self.commit({name: {"": df}}).read(name)

    def commit(self, changes: dict[str, dict[str, DataFrame | None] | tuple[DataFrame, str]], base: View | None = None) -> View:
        """Replaces parts of tables, all at once: {table: {key: rows, or None to drop the part}}, or {table: (rows, column)} to split rows into
        parts by a text column, which is not kept, in one write. base: the view that the changes were made from."""
        base = base or self.view()
        made = {"version": base.version + 1, "tables": {n: {"schema": t["schema"], "parts": dict(t["parts"])} for n, t in base.manifest["tables"].items()}}
        for name, change in changes.items():
            split = change[0].drop(change[1]) if isinstance(change, tuple) else next((df for df in change.values() if df is not None), None)
            about = made["tables"].setdefault(name, {"schema": None, "parts": {}})
            if split is not None:
                about["schema"] = T.StructType([T.StructField(f.name, f.dataType) for f in split.schema]).jsonValue()
            folder = f"{name}/{uuid.uuid4().hex}"
            if isinstance(change, tuple):
                rows, column = change
                rows.withColumn("_part", F.col(column)).drop(column).write.partitionBy("_part").parquet(f"{self.root}/{folder}")
                fs, at = self._fs(f"{self.root}/{folder}")
                for status in fs.listStatus(at):
                    label = status.getPath().getName()
                    if label.startswith("_part="):
                        key = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(label.removeprefix("_part="))
                        about["parts"][key] = f"{folder}/{label}"
                continue
            for i, (key, df) in enumerate(change.items()):
                if df is None:
                    about["parts"].pop(key, None)
                else:
                    df.write.parquet(f"{self.root}/{folder}-{i}")
                    about["parts"][key] = f"{folder}-{i}"
        self._publish(made)
        return View(self.spark, self.root, made)

    def _publish(self, manifest: dict) -> None:
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        fs, new = self._fs(f"{self.root}/manifests/{manifest['version']:09d}.json")
        _, draft = self._fs(f"{self.root}/manifests/_{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(draft, new, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(draft, False)
            raise Conflict(f"version {manifest['version']} is there already") from e

    def vacuum(self, keep: int = 2) -> int:
        """Removes all but the last manifests, and the folders that none of these refers to; returns how many folders went. Not to be run while
        something is being written, and only where no reader still uses an older version."""
        known = self.versions()
        kept = {at.split("/")[0] + "/" + at.split("/")[1] for v in known[-keep:] for t in self.view(v).manifest["tables"].values() for at in t["parts"].values()}
        gone = 0
        names = {n for v in known for n in self.view(v).manifest["tables"]}
        for name in names:
            fs, at = self._fs(f"{self.root}/{name}")
            for status in fs.listStatus(at) if fs.exists(at) else []:
                if f"{name}/{status.getPath().getName()}" not in kept:
                    fs.delete(status.getPath(), True)
                    gone += 1
        for v in known[:-keep]:
            fs, at = self._fs(f"{self.root}/manifests/{v:09d}.json")
            fs.delete(at, False)
        return gone


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def context(hits: DataFrame, group: list[str], order: list[Column], cite: str = "citation", content: str = "content") -> DataFrame:
    """One text for each group: [rank] citation, the content, a blank line between blocks; and the list of sources."""
    ranked = hits.withColumn("_i", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    block = F.concat(F.lit("["), F.col("_i").cast("string"), F.lit("] "), F.col(cite), F.lit(":\n"), F.col(content))
    both = ranked.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_i", block.alias("b"), F.col(cite).alias("c")))).alias("_b"))
    sources = F.transform("_b", lambda x: F.concat(F.lit("["), x["_i"].cast("string"), F.lit("] "), x["c"]))
    return both.select(*group, F.array_join(F.transform("_b", lambda x: x["b"]), "\n\n").alias("context"), F.array_join(sources, "\n").alias("sources"))
