"""The registry as a product: three repositories from files to an answer, and what each change reads, writes and keeps."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from atlas.operators import embed, graph, registry, search, tables
from atlas.plans import answer
from atlas.sources import code, specs

FILES = {
    "ledger": {"openapi.yaml": "openapi: 3.0.0\npaths:\n  /entries/{id}:\n    get:\n      operationId: one\n", "main.py": "def entry_of(number):\n    row = load(number)\n    return row\n"},
    "counter": {"desk.py": "import kit\n\nLEDGER = 'http://ledger:80'\n\n\ndef ask(number):\n    place = f'{LEDGER}/entries/{number}'\n    return kit.get(place)\n\n\ndef tell(who):\n    place = f'http://herald:80/call/{who}'\n    return kit.post(place)\n"},
    "herald": {"main.py": "def call_out(who, text):\n    print(who, text)\n    return True\n"},
}


def held(spark, state):
    return lambda repo: spark.createDataFrame([(repo["id"], p, c) for p, c in state[repo["name"]].items()], "repo_id string, file_path string, content string")


class Counted:
    """Leaves a line in a file for each request."""

    name = "counted"

    def __init__(self, log):
        self.log = str(log)

    def embed(self, texts):
        with open(self.log, "a") as f:
            f.write(f"{len(texts)}\n")
        return embed.HashedTokens(16).embed(texts)

    def asked(self):
        return [int(x) for x in open(self.log)] if os.path.exists(self.log) else []


@pytest.fixture()
def three(spark, tmp_path):
    state = {k: dict(v) for k, v in FILES.items()}
    r = registry.Registry(tables.Snapshots(spark, f"file://{tmp_path}/s"), held(spark, state))
    return r, state, {name: r.register(name, f"/clones/{name}") for name in FILES}


def edges_of(r):
    names = {n.id: n.qualified_name for n in r.nodes().collect()}
    return sorted((names[e.source_node_id], names[e.target_node_id], e.edge_type, e.confidence) for e in r.edges().where("is_cross_repo").collect())


LINKS = [
    ("desk.py", "GET /entries/*", "http_call", "confirmed"), ("desk.py", "herald::__service_root__", "http_call", "inferred"), ("ledger::__service_root__", "herald::__service_root__", "manual", "confirmed"),
]


def test_from_files_to_an_answer(spark, three, tmp_path):
    r, _, ids = three
    told = spark.createDataFrame([("ledger", "herald", "manual")], "source_repo string, target_repo string, edge_type string")
    assert r.link(overrides=told).count() == 3 and r.link(overrides=told).count() == 3  # the second call adds nothing
    assert r.nodes().count() == 11 and r.edges().where("not is_cross_repo").count() == 4 and edges_of(r) == LINKS
    counted = Counted(tmp_path / "requests")
    for name, i in ids.items():
        log = spark.createDataFrame([(i, f"{'0' * 39}{len(name)}\x1ffirst commit of {name}\x1f\x1e")], "repo_id string, log string")
        r.index(i, logs=log, embedder=counted, dimension=16)
    assert {k: n for k, n in r.at.read("chunks").groupBy("source_type").count().collect()} == {"code": 4, "api_spec": 1, "commit": 3}
    assert r.at.read("chunks").where("embedding is null or digest is null").count() == 0
    chunks, repos = r.at.read("chunks"), [x.asDict() for x in r.active().collect()]
    found = answer.retrieve(chunks, spark.createDataFrame([("u", ids["counter"])], "user_id string, repo_id string"), "u", answer.route("how does ask work", repos)["repo_ids"], embed.HashedTokens(16).embed(["def ask number place kit.get(place)"])[0])
    top = found.collect()[0]
    assert top.qualified_name.endswith("ask") and {x.repo_id for x in found.collect()} == {ids["counter"]}
    files = r.fetch({"id": ids["counter"], "name": "counter"})
    options = graph.hop_options(r.edges(), r.nodes(), r.at.read("repos"))
    steps, why = graph.trace(options, r.nodes(), graph.node_contents(r.nodes(), chunks, files), top.graph_node_id, "how does ask work")
    assert [s["qualified_name"] for s in steps][0] == "desk.py::ask" and steps[1]["qualified_name"] in {"desk.py::tell", "GET /entries/*", "herald::__service_root__"} and why == graph.DEAD_END
    assert "desk.py:6-8 (desk.py::ask)" in answer.synthesise(found, "how does ask work")["answer"]


def test_only_changes_are_embedded(three, tmp_path):
    r, state, ids = three
    counted = Counted(tmp_path / "requests")
    first = {x.id: x.embedding for x in r.index(ids["counter"], embedder=counted, dimension=16).collect()}
    assert sum(counted.asked()) == 2
    again = {x.id: x.embedding for x in r.index(ids["counter"], embedder=counted, dimension=16).collect()}
    assert again == first and sum(counted.asked()) == 2
    state["counter"]["notes.md"] = "# one\nmore\n"
    r.index(ids["counter"], embedder=counted, dimension=16)
    assert sum(counted.asked()) == 3 and r.at.read("vectors", [ids["counter"]]).count() == 3
    del state["counter"]["notes.md"]
    r.index(ids["counter"], embedder=counted, dimension=16)
    assert sum(counted.asked()) == 3 and r.at.read("vectors", [ids["counter"]]).count() == 2


def loose_ends(r):
    """Edges without a node, and chunks with a node that is gone, by SQL."""
    con = duckdb.connect()
    for name, df in (("n", r.nodes()), ("e", r.edges()), ("c", r.at.read("chunks"))):
        con.register(name, df.toPandas())
    return con.execute("SELECT (SELECT count(*) FROM e ANTI JOIN n ON e.source_node_id = n.id) + (SELECT count(*) FROM e ANTI JOIN n ON e.target_node_id = n.id) + (SELECT count(*) FROM c ANTI JOIN n ON c.graph_node_id = n.id WHERE graph_node_id IS NOT NULL)").fetchall()[0][0]


def test_sync_cascades(spark, three):
    r, state, ids = three
    told = spark.createDataFrame([("ledger", "herald", None)], "source_repo string, target_repo string, edge_type string")
    r.link(overrides=told)
    for i in ids.values():
        r.index(i)
    before, parts = r.at.view(), lambda v, t: v.manifest["tables"][t]["parts"]
    state["ledger"] = {"main.py": FILES["ledger"]["main.py"]}  # the description goes, and its endpoint with it
    r.sync(ids["ledger"])
    after = r.at.view()
    assert edges_of(r) == [x for x in LINKS if x[0] != "desk.py" or "herald" in x[1]] and loose_ends(r) == 0
    pair = f"{ids['counter']}-{ids['ledger']}"
    for t in ("nodes", "edges", "endpoints", "ends", "chunks", "links"):
        changed = {k for k, at in parts(after, t).items() if parts(before, t).get(k) != at}
        assert changed == ({pair} if t == "links" else {ids["ledger"]}), t
    state["counter"] = {"desk.py": "def tell(who):\n    return who\n"}
    r.sync(ids["counter"])
    assert loose_ends(r) == 0 and r.at.read("chunks", [ids["counter"]]).where("graph_node_id is null").count() == 1
    assert before.read("nodes").count() == 7 and before.read("links").count() == 3  # who holds the old view still reads old nodes with old edges
    when = {x.name: (x.created_at, x.last_synced_at) for x in r.at.read("repos").collect()}
    assert when["counter"][1] > when["counter"][0] and when["herald"][0] == when["herald"][1]


def test_reads_only_its_parts(three):
    r, _, ids = three
    mine = r.at.read("nodes", [ids["herald"]])
    everything = r.at.read("nodes")
    assert set(mine.inputFiles()) < set(everything.inputFiles()) and {x.repo_id for x in mine.collect()} == {ids["herald"]}


def test_deletes(three):
    r, _, ids = three
    r.link()
    r.index(ids["ledger"])
    r.deregister(ids["ledger"])
    assert r.active().count() == 2 and r.at.read("chunks", [ids["ledger"]]).count() > 0
    with pytest.raises(ValueError, match="inactive"):
        r.sync(ids["ledger"])
    r.purge(ids["ledger"])
    assert loose_ends(r) == 0 and r.at.read("repos").count() == 2
    assert all(ids["ledger"] not in k.split("-") for t in registry.Registry.TABLES for k in r.at.view().keys(t))
    assert r.register("ledger", "/clones/ledger") == ids["ledger"]
    with pytest.raises(ValueError):
        r.purge("nobody")


def test_commits(spark, tmp_path):
    store = tables.Snapshots(spark, f"file://{tmp_path}")
    base = store.commit({"t": {"a": spark.range(3), "b": spark.range(5)}, "u": {"": spark.range(1)}})
    assert (base.version, store.read("t").count(), store.read("t", ["b"]).count(), base.keys("t")) == (1, 8, 5, ["a", "b"])
    store.commit({"t": {"a": spark.range(1)}}, base)
    with pytest.raises(tables.Conflict):
        store.commit({"t": {"a": spark.range(9)}}, base)
    assert store.read("t").count() == 6 and base.read("t").count() == 8
    store.commit({"t": (spark.range(4).withColumn("k", F.concat(F.lit("x/"), (F.col("id") % 2).cast("string"))), "k")})
    assert store.view().keys("t") == ["a", "b", "x/0", "x/1"] and store.read("t", ["x/1"]).count() == 2
    store.commit({"t": {"a": None}})
    assert store.vacuum(1) == 3 and store.versions() == [4] and store.read("t").count() == 9 and store.read("u").count() == 1
    assert store.view().read("t", []).count() == 0 and json.loads(json.dumps(store.view().manifest))["version"] == 4


def test_specs_of_a_linked_repository(spark):
    files = spark.createDataFrame([("r", "openapi.yaml", FILES["ledger"]["openapi.yaml"])], "repo_id string, file_path string, content string")
    assert [(e.method, e.path) for e in specs.endpoints(files).collect()] == [("get", "/entries/*")]
    assert code.parse_files(files).count() == 0 and search.norm(F.lit(None)) is not None
