"""Repositories and what is known of them, as snapshots: register, sync, index."""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlas.sources import code, specs

from . import chunk, embed, graph, link, tables
from .rounds import Rounds

REPOS = "id string, name string, git_url string, default_branch string, status string, created_at timestamp, last_synced_at timestamp"
NODES = "id string, repo_id string, node_type string, qualified_name string, file_path string, language string, start_line int, end_line int, raw_imports array<string>, call_site_literals array<string>, skipped_files array<struct<file_path:string,error:string>>"
EDGES = "id string, repo_id string, source_node_id string, target_node_id string, edge_type string, is_cross_repo boolean, confidence string"
CHUNKS = "id string, repo_id string, graph_node_id string, source_type string, file_path string, qualified_name string, start_line int, end_line int, commit_sha string, pr_number int, content string"

# What a chunk holds beside these once it is in the index, and the other tables of a registry.
STORED = CHUNKS + ", digest string, embedding array<float>"
ENDPOINTS = "repo_id string, file_path string, ord int, method string, written string, path string"
ENDS = "id string, repo_id string, node_type string, qualified_name string, file_path string"
LINKS = EDGES + ", target_repo_id string"
VECTORS = "digest string, embedding array<float>"


def by_id(repos: DataFrame, repo: Column | str) -> DataFrame:
    return repos.where(F.col("id") == repo)


def by_name(repos: DataFrame, name: Column | str) -> DataFrame:
    return repos.where(F.col("name") == name)


def scope(repos: DataFrame, ids: list | None, least: int = 1) -> DataFrame:
    """Active repositories, of ids if there are some; none if fewer than least are left."""
    mine = repos.where(F.col("status") == "active")
    mine = mine if ids is None else mine.where(F.col("id").isin(ids))
    enough = mine.agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return mine.join(F.broadcast(enough), F.lit(True), "left_semi")  # one row or none


def code_chunks(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Chunks of source files: one for each function or class whose lines are known, windows for files that have none.

    files: repo_id, file_path, content; nodes: id, repo_id, file_path, node_type, qualified_name, start_line, end_line.
    """
    spans = graph.precise_nodes(nodes).select("repo_id", "file_path", F.col("id").alias("graph_node_id"), "qualified_name", "start_line", "end_line")
    exact = chunk.ranges(files.select("repo_id", "file_path", "content").join(spans, ["repo_id", "file_path"]))
    rest = files.select("repo_id", "file_path", "content").join(spans.select("repo_id", "file_path").distinct(), ["repo_id", "file_path"], "left_anti")
    none = F.lit(None).cast("string")
    plain = chunk.windows(rest).withColumns({"graph_node_id": none, "qualified_name": none})
    return exact.unionByName(plain.select(*exact.columns))


def index_chunks(files: DataFrame, nodes: DataFrame, docs: DataFrame | None = None, logs: DataFrame | None = None, pulls: DataFrame | None = None) -> DataFrame:
    """All chunks of repositories with deterministic ids: code, documents, API descriptions, commits and pull requests.

    files and docs: repo_id, file_path, content; logs: repo_id, log; pulls: repo_id, pr_number, content. What is missing gives none.
    """
    api = specs.openapi_endpoints(files)
    parts = [
        code_chunks(files.where(F.col("file_path").rlike("(" + "|".join(e.replace(".", r"\.") for e in code.LANGUAGES) + ")$")), nodes).withColumn("source_type", F.lit("code")),
        api.select("repo_id", "file_path", chunk.endpoint_text(F.col("method"), F.col("path"), F.col("summary"), F.col("description")).alias("content"), F.lit("api_spec").alias("source_type")),
    ]
    if docs is not None:
        parts.append(chunk.headings(docs.select("repo_id", "file_path", "content")).withColumn("source_type", F.lit("doc")))
    if logs is not None:
        parts.append(chunk.commits(logs.select("repo_id", "log")).withColumn("source_type", F.lit("commit")))
    if pulls is not None:
        parts.append(pulls.select("repo_id", "pr_number", "content").withColumn("source_type", F.lit("pr_description")))
    both = tables.union(parts)
    fields = [f.split() for f in CHUNKS.split(", ")]
    known = {c: F.col(c) if c in both.columns else F.lit(None) for c in [*(n for n, _ in fields), "section"]}
    rows = both.select(*[known[n].cast(t).alias(n) for n, t in fields if n != "id"], known["section"].cast("int").alias("section"))
    same = tables.node_id(*[F.col(c) for c in ("repo_id", "source_type", "file_path", "graph_node_id", "start_line", "section", "commit_sha", "pr_number")], F.md5("content"))
    return rows.select(same.alias("id"), *[n for n, _ in fields if n != "id"]).dropDuplicates(["id"])


def with_vectors(chunks: DataFrame, known: DataFrame, embedder: embed.Embedder, dimension: int = embed.DIMENSION, requests: int | None = None, workers: int = 1) -> tuple[DataFrame, DataFrame]:
    """chunks with digest and embedding, and the vectors (digest, embedding) that they use.

    A digest names an embedder and a content. Only contents whose digest isn't among the known ones are embedded, each once; what is
    unchanged makes no request.
    """
    rounds = Rounds(chunks.sparkSession)
    name = getattr(embedder, "name", type(embedder).__name__)
    named = chunks.withColumn("digest", F.sha2(F.concat(F.lit(f"{name}\u0001{dimension}\u0001"), "content"), 256))
    wanted = rounds.table(named.groupBy("digest").agg(F.first("content").alias("content")))
    held = known.dropDuplicates(["digest"])
    fresh = rounds.table(wanted.join(held, "digest", "left_anti"))
    made = rounds.table(embed.embed(fresh, embedder, dimension=dimension, requests=requests, workers=workers).select("digest", "embedding"))
    vectors = held.join(wanted.select("digest"), "digest", "left_semi").unionByName(made)
    return named.drop("embedding").join(vectors, "digest", "left"), vectors


class Registry:
    """Repositories and what is known of them: repos, nodes, edges, endpoints, ends (endpoints and roots as nodes), links (edges between repositories),
    chunks and vectors, as parts of a snapshot folder: one for each repository, links one for each pair. An operation reads and writes the parts
    of its repository only, and commits them all at once; repos is one small table. What one view reads belongs together.

    fetch gives the files (repo_id, file_path, content) of a repository's current state: a clone on a shared disk, or anything else.
    """

    TABLES = {"repos": REPOS, "nodes": NODES, "edges": EDGES, "endpoints": ENDPOINTS, "ends": ENDS, "links": LINKS, "chunks": STORED, "vectors": VECTORS}

    def __init__(self, snapshots: tables.Snapshots, fetch: Callable[[dict], DataFrame]):
        self.at, self.fetch, self.spark = snapshots, fetch, snapshots.spark
        view = self.at.view()
        missing = {name: {"": self.spark.createDataFrame([], schema)} for name, schema in self.TABLES.items() if name not in view}
        if missing:
            self.at.commit(missing, view)

    # --- repositories

    def register(self, name: str, git_url: str, default_branch: str = "main") -> str:
        """A new active repository, mapped; its id follows from the name, which must be new. What can't be fetched isn't registered."""
        view = self.at.view()
        if by_name(view.read("repos"), name).limit(1).count():
            raise ValueError(f"a repository is called {name} already")
        now = datetime.datetime.now(datetime.UTC)
        repo = {"id": hashlib.sha256(name.encode()).hexdigest(), "name": name, "git_url": git_url, "default_branch": default_branch, "status": "active", "created_at": now, "last_synced_at": now}
        fresh = self._mapped(repo)
        repos = view.read("repos").unionByName(self.spark.createDataFrame([repo], REPOS))
        self.at.commit({"repos": {"": repos}, **{t: {repo["id"]: df} for t, df in fresh.items()}}, view)
        return repo["id"]

    def deregister(self, repo_id: str) -> None:
        """Soft delete: the repository becomes inactive, and everything known of it stays."""
        view = self.at.view()
        self._there(view, repo_id)
        self.at.commit({"repos": {"": tables.soft_delete(view.read("repos"), F.col("id") == repo_id)}}, view)

    def purge(self, repo_id: str) -> None:
        """Hard delete: the repository goes with its nodes, edges, chunks and all links from and to it, whose parts alone are dropped. The name is free again."""
        view = self.at.view()
        self._there(view, repo_id)
        gone: dict = {t: {repo_id: None} for t in self.TABLES if t not in ("repos", "links")}
        self.at.commit({**gone, "links": {k: None for k in self._pairs(view, repo_id)}, "repos": {"": view.read("repos").where(F.col("id") != repo_id)}}, view)

    def active(self) -> DataFrame:
        return self.at.read("repos").where("status = 'active'")

    def _there(self, view: tables.View, repo_id: str, active: bool = False) -> dict:
        found = by_id(view.read("repos"), repo_id).limit(1).collect()
        if not found:
            raise ValueError(f"no repository has the id {repo_id}")
        if active and found[0].status != "active":
            raise ValueError(f"repository {repo_id} is {found[0].status}")
        return found[0].asDict()

    @staticmethod
    def _pairs(view: tables.View, repo_id: str) -> list[str]:
        return [k for k in view.keys("links") if repo_id in k.split("-")]

    # --- the graph

    def _mapped(self, repo: dict) -> dict[str, DataFrame]:
        rounds = Rounds(self.spark)
        files = rounds.table(self.fetch(repo).where(F.col("repo_id") == repo["id"]).select("repo_id", "file_path", "content"))
        parsed = rounds.table(code.parse_files(files))
        shaped = lambda df, schema: df.select(*[f.split()[0] for f in schema.split(", ")])
        return {"nodes": shaped(code.nodes(parsed), NODES), "edges": shaped(code.edges(parsed), EDGES), "endpoints": shaped(specs.endpoints(files), ENDPOINTS)}

    def sync(self, repo_id: str) -> None:
        """Maps an active repository's current files.

        Nodes have ids that follow from what they are, so what is still there keeps its edges. The ids that are gone drive the rest, in the same commit: links that begin
        or end at one go, chunks lose their reference to it, endpoints that are gone leave the linked nodes. Of links only the parts of pairs that
        lose some are written.
        """
        view = self.at.view()
        repo, rounds = self._there(view, repo_id, active=True), Rounds(self.spark)
        fresh = {t: rounds.table(df) for t, df in self._mapped(repo).items()}
        kinds = link.endpoint_nodes(fresh["endpoints"]).select("id")
        ends = view.read("ends", [repo_id])
        kept = rounds.table(ends.join(kinds, "id", "left_semi").unionByName(ends.where(F.col("node_type") != "endpoint")))
        there = fresh["nodes"].select("id").unionByName(kept.select("id"))
        gone = rounds.table(view.read("nodes", [repo_id]).select("id").unionByName(ends.select("id")).distinct().join(there, "id", "left_anti"))
        links = view.read("links", self._pairs(view, repo_id))
        lost = [links.join(gone.withColumnRenamed("id", c), c, "left_semi") for c in ("source_node_id", "target_node_id")]
        hit = sorted(r[0] for r in lost[0].unionByName(lost[1]).select(F.concat_ws("-", "repo_id", "target_repo_id")).distinct().collect())  # pairs of this repository
        without = lambda df: df.join(gone.withColumnRenamed("id", "source_node_id"), "source_node_id", "left_anti").join(gone.withColumnRenamed("id", "target_node_id"), "target_node_id", "left_anti").select(*df.columns)
        chunks = view.read("chunks", [repo_id])
        marked = chunks.join(gone.select(F.col("id").alias("graph_node_id"), F.lit(True).alias("_gone")), "graph_node_id", "left").withColumn("graph_node_id", F.when(F.col("_gone").isNull(), F.col("graph_node_id")))
        now = F.lit(datetime.datetime.now(datetime.UTC))
        repos = view.read("repos").withColumn("last_synced_at", F.when(F.col("id") == repo_id, now).otherwise(F.col("last_synced_at")))
        changes: dict = {t: {repo_id: df} for t, df in fresh.items()}
        changes |= {"repos": {"": repos}, "ends": {repo_id: kept}, "chunks": {repo_id: marked.select(*chunks.columns)}, "links": {k: without(view.read("links", [k])) for k in hit}}
        self.at.commit(changes, view)

    def link(self, repo_ids: list | None = None, overrides: DataFrame | None = None) -> DataFrame:
        """Links active repositories, of repo_ids if there are some, and adds what is new: endpoints and roots as nodes, and edges. Returns the edges found.

        Ids are deterministic, so a second call adds nothing. Repositories come in the order in which they were registered.
        """
        view, rounds = self.at.view(), Rounds(self.spark)
        repos = view.read("repos")
        ids = None if repo_ids is None else sorted(repo_ids)
        order = repos.select(F.col("id").alias("repo_id"), "created_at", "name")
        endpoints = view.read("endpoints", ids).join(order, "repo_id").select("repo_id", "method", "path", F.struct("created_at", "name", F.col("method").isNull().alias("rpc"), "file_path", "ord").alias("ord"))
        calls = view.read("nodes", ids).select(F.col("id").alias("source_node_id"), "repo_id", F.explode("call_site_literals").alias("literal"))
        known = view.read("ends", ids)
        found = link.link(repos, endpoints, calls, overrides, known, ids)
        nodes = rounds.table(found["nodes"])
        edges = rounds.table(found["edges"].withColumnRenamed("source_repo_id", "repo_id").select(*[f.split()[0] for f in LINKS.split(", ")]))
        more_nodes = nodes.join(known.select("id"), "id", "left_anti").select("repo_id").distinct()
        pair = F.concat_ws("-", "repo_id", "target_repo_id")
        more_pairs = edges.join(view.read("links").select("id"), "id", "left_anti").select("repo_id", "target_repo_id").distinct()
        held = view.read("links")
        changed_nodes = tables.insert_new(known, nodes, ["id"]).join(more_nodes, "repo_id", "left_semi").select(*known.columns)
        changed_edges = tables.insert_new(held, edges, ["id"]).join(more_pairs, ["repo_id", "target_repo_id"], "left_semi").select(*held.columns)
        self.at.commit({"ends": (changed_nodes.withColumn("_key", F.col("repo_id")), "_key"), "links": (changed_edges.withColumn("_key", pair), "_key")}, view)
        return edges

    def nodes(self) -> DataFrame:
        """Files, functions, classes and errors, and the endpoints and roots that links brought."""
        view = self.at.view()
        return view.read("nodes").unionByName(view.read("ends"), allowMissingColumns=True)

    def edges(self) -> DataFrame:
        """Edges within repositories and between them."""
        view = self.at.view()
        return view.read("edges").unionByName(view.read("links").drop("target_repo_id"))

    # --- the index

    def index(
        self, repo_id: str, docs: DataFrame | None = None, logs: DataFrame | None = None, pulls: DataFrame | None = None,
        embedder: embed.Embedder | None = None, dimension: int = embed.DIMENSION, requests: int | None = None, workers: int = 1,
    ) -> DataFrame:
        """Replaces a repository's chunks and returns them; the old ones go when the new ones are written. Without docs the fetched files with a document's ending are
        taken. With an embedder chunks hold an embedding; contents that were embedded before keep theirs."""
        view = self.at.view()
        repo, rounds = self._there(view, repo_id, active=True), Rounds(self.spark)
        files = rounds.table(self.fetch(repo).where(F.col("repo_id") == repo_id).select("repo_id", "file_path", "content"))
        docs = files.where(F.lower("file_path").rlike("(" + "|".join(e.replace(".", r"\.") for e in code.DOCUMENTS) + ")$")) if docs is None else docs
        fresh = rounds.table(index_chunks(files, view.read("nodes", [repo_id]), docs, logs, pulls))
        changes: dict = {}
        if embedder is None:
            fresh = fresh.withColumns({"digest": F.lit(None).cast("string"), "embedding": F.lit(None).cast("array<float>")})
        else:
            fresh, vectors = with_vectors(fresh, view.read("vectors", [repo_id]), embedder, dimension, requests, workers)
            changes["vectors"] = {repo_id: vectors}
        changes["chunks"] = {repo_id: fresh.select(*[f.split()[0] for f in STORED.split(", ")])}
        return self.at.commit(changes, view).read("chunks", [repo_id])
