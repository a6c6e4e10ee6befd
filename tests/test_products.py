"""Registry, index, links and routing as wholes."""

import pytest

from atlas.operators import embed, graph, link, registry, tables
from atlas.plans import answer
from atlas.sources import code

KEEPER = "def weigh(x):\n    return x\n\n\nclass Scale:\n    pass\n"
ASKER = "HOST = 'http://keeper'\n\n\ndef ask(i):\n    return get(f'{HOST}/stones/{i}')\n\n\ndef tell():\n    return post('http://scribe.local/notes/add')\n"


def files_of(spark, state):
    return lambda repo: spark.createDataFrame([(repo["id"], p, c) for p, c in state[repo["name"]].items()], "repo_id string, file_path string, content string")


def test_registry(spark, tmp_path):
    state = {"keeper": {"k.py": KEEPER, "bad.py": "def (:"}, "asker": {"a.py": ASKER, "notes.txt": "no code"}}
    r = registry.Registry(tables.Snapshots(spark, f"file://{tmp_path}/s"), files_of(spark, state))
    assert r.at.read("repos").count() == r.at.read("chunks").count() == 0
    keeper, asker = r.register("keeper", "https://h/keeper"), r.register("asker", "https://h/asker")
    with pytest.raises(ValueError):
        r.register("keeper", "elsewhere")
    names = lambda: {(x.repo_id, x.qualified_name) for x in r.at.read("nodes").collect()}
    assert names() == {(keeper, "k.py"), (keeper, "k.py::weigh"), (keeper, "k.py::Scale"), (keeper, "__mapping_errors__"), (asker, "a.py"), (asker, "a.py::ask"), (asker, "a.py::tell")}
    assert [(x.repo_id, x.file_path) for x in graph.mapping_errors(r.at.read("nodes")).collect()] == [(keeper, "bad.py")]
    first = {x.id for x in r.index(keeper).collect()}
    assert len(first) == 3 and {x.id for x in r.index(keeper).collect()} == first  # the file that can't be parsed has a window
    r.index(asker)
    assert r.at.read("chunks").count() == 5
    state["keeper"] = {"k.py": "def weigh(x):\n    return x\n"}
    r.sync(keeper)
    assert {n for i, n in names() if i == keeper} == {"k.py", "k.py::weigh"} and len(names()) == 5
    kept = [x for x in r.at.read("chunks").collect() if x.repo_id == keeper]
    assert len(kept) == 3 and sum(x.graph_node_id is not None for x in kept) == 1
    assert registry.by_name(r.at.read("repos"), "asker").first().id == asker
    for unknown in (lambda: r.sync("nobody"), lambda: r.index("nobody")):
        with pytest.raises(ValueError):
            unknown()


def test_links_of_repositories(spark):
    repos = spark.createDataFrame([("1", "keeper", "active"), ("2", "asker", "active"), ("3", "scribe", "active"), ("4", "gone", "inactive")], "id string, name string, status string")
    endpoints = spark.createDataFrame([("1", "get", "/stones/*", 0), ("1", "put", "/stones/*", 1), ("4", "get", "/stones/*", -1), ("3", None, "Scribe.Note", 2)], "repo_id string, method string, path string, ord int")
    calls = spark.createDataFrame([("n1", "2", "http://keeper/stones/{}"), ("n1", "2", "http://keeper/stones/7"), ("n2", "2", "http://scribe.local/notes/add"), ("n3", "1", "http://keeper/stones/1"), ("n4", "4", "http://scribe/x"), ("n5", "2", "http://nobody/x")], "source_node_id string, repo_id string, literal string")
    told = spark.createDataFrame([("keeper", "scribe", None), ("keeper", "gone", None)], "source_repo string, target_repo string, edge_type string")
    got = link.link(repos, endpoints, calls, told)
    name = {x.id: x.qualified_name for x in got["nodes"].collect()}
    assert sorted(name.values()) == ["GET /stones/*", "PUT /stones/*", "Scribe.Note", "asker::__service_root__", "keeper::__service_root__", "scribe::__service_root__"]
    edges = sorted((name.get(x.source_node_id, x.source_node_id), name[x.target_node_id], x.edge_type, x.confidence) for x in got["edges"].collect())
    assert edges == [("keeper::__service_root__", "scribe::__service_root__", "manual", "confirmed"), ("n1", "GET /stones/*", "http_call", "confirmed"), ("n2", "scribe::__service_root__", "http_call", "inferred")]
    assert {x.id for x in got["edges"].collect()} == {x.id for x in link.link(repos, endpoints, calls.repartition(3), told)["edges"].collect()}
    again = link.link(repos, endpoints, calls, told, nodes=got["nodes"])  # roots that are there stay
    assert {x.id for x in again["nodes"].collect()} == set(name)
    for few in (["2"], ["2", "4"], []):
        assert link.link(repos, endpoints, calls, told, scope=few)["edges"].count() == link.link(repos, endpoints, calls, told, scope=few)["nodes"].count() == 0


class Says:
    def __init__(self, text):
        self.text, self.asked = text, []

    def complete(self, prompt):
        self.asked.append(prompt)
        return self.text


def test_routing_matrix():
    repos = [{"id": 1, "name": "a"}, {"id": 2, "name": "b"}]
    ask = {"needs_clarification": True, "clarification_message": "Which of these do you mean: a, b?"}
    sure = {"needs_clarification": False, "clarification_message": None}
    want = [
        ("nonsense", {"question_type": "general", "repo_ids": [1, 2]} | ask),
        ('["b"]', {"question_type": "general", "repo_ids": [1, 2]} | ask),
        ('```JSON\n{"repo_names": ["b"], "confident": true, "question_type": "specific_trace"}\n```', {"question_type": "specific_trace", "repo_ids": [2]} | sure),
        ('{"repo_names": ["b", "a", "b", "zz"], "confident": true}', {"question_type": "general", "repo_ids": [2, 1, 2]} | sure),
        ('{"repo_names": ["b"]}', {"question_type": "general", "repo_ids": [2]} | ask),
        ('{"repo_names": ["b"], "confident": false, "question_type": "why_historical"}', {"question_type": "why_historical", "repo_ids": [2]} | ask),
        ('{"repo_names": ["zz"], "confident": true}', {"question_type": "general", "repo_ids": [1, 2]} | ask),
    ]
    for text, out in want:
        assert answer.route("why?", repos, Says(text)) == out
    assert answer.route("why?", repos) == {"question_type": "why_historical", "repo_ids": [1, 2]} | sure


def test_models_by_role():
    made = []
    models = answer.Models({"routing": ("p", "small"), "tracing": ("q", "large")}, {"p": lambda n: made.append(n) or Says(n), "q": lambda n: made.append(n) or Says(n)})
    assert models.of("routing") is models.of("routing") and models.of("tracing").text == "large" and made == ["small", "large"]


def test_decisions_see_the_options():
    model = Says('{"sufficient": false, "follow_target_id": "t"}')
    option = {"target_node_id": "t", "edge_type": "calls", "is_cross_repo": True, "confidence": "inferred", "via_file_level_import": False, "target_qualified_name": "f", "target_repo_name": "r", "target_file_path": "p"}
    assert graph.parse_decision(graph.ModelDecision(model).decide("q?", {"qualified_name": "g", "file_path": "h"}, "code", [option]))["follow_target_id"] == "t"
    assert "- id=t: calls [cross-repo] (inferred, lower confidence) -> f in r (p)" in model.asked[0]


def test_one_bad_file_stops_no_other(spark):
    rows = [("r", "deep.py", "x = " + "-" * 20_000 + "1\n"), ("r", "zero.py", "a\0b"), ("r", "ok.py", "def f(): pass\n"), ("r", "none.py", None)]
    got = {x.file_path: x for x in code.parse_files(spark.createDataFrame(rows, "repo_id string, file_path string, content string")).collect()}
    assert got["deep.py"].error and got["ok.py"].error is None and len(got["ok.py"].definitions) == 1 and got["none.py"].error is None


def test_five_tries_each_throttled():
    tries = []

    def call():
        tries.append(1)
        raise RuntimeError("429")

    with pytest.raises(RuntimeError):
        embed.with_retries(call, sleep=lambda s: None)
    assert len(tries) == 5


def test_scan_reads_wanted_files_only(spark, tmp_path):
    for path, text in {"a.py": "x = 1\n", "b/c.ts": "let y", "b/d.bin": "no", "node_modules/e.py": "no", "b/.git/f.py": "no"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    assert sorted(x.file_path for x in code.read_files(spark, str(tmp_path), "r").collect()) == ["a.py", "b/c.ts"]
