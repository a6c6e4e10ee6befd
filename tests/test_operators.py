"""Operators on small tables."""

import itertools

import pytest
from pyspark.sql import functions as F

from atlas.operators import chunk, embed, graph, link, search, tables
from atlas.plans import answer, catalogue


def windows(n):
    out, at = [], 0
    while n:
        out.append((at + 1, min(at + 60, n)))
        if at + 60 >= n:
            break
        at += 50
    return out


@pytest.mark.parametrize("end", ["", "\n"])
def test_windows(spark, end):
    sizes = [0, 1, 59, 60, 61, 110, 111, 120, 121]
    df = spark.createDataFrame([(n, "\n".join(f"l{i}" for i in range(n)) + (end if n else "")) for n in sizes], "n int, content string")
    found = {n: [(r.start_line, r.end_line) for r in rs] for n, rs in itertools.groupby(chunk.windows(df).orderBy("n", "start_line").collect(), key=lambda r: r.n)}
    assert found == {n: windows(n) for n in sizes if n}


def test_blank_windows_go(spark):
    assert chunk.windows(spark.createDataFrame([("\n" * 30,), (None,)], "content string")).count() == 0


def test_ranges_keep_lines_of_the_file(spark):
    text = "\n".join(f"l{i}" for i in range(1, 301))
    df = spark.createDataFrame([(1, text, 100, 230), (2, text, 5, 6)], "k int, content string, start_line int, end_line int")
    got = [(r.k, r.start_line, r.end_line) for r in chunk.ranges(df).orderBy("k", "start_line").collect()]
    assert got == [(1, 100, 159), (1, 150, 209), (1, 200, 230), (2, 5, 6)]
    strict = [r.start_line for r in chunk.ranges(df, strict=True).where("k = 1").orderBy("start_line").collect()]
    assert strict == [1, 51, 101]


def test_whole_ranges_reach_the_last_line(spark, tmp_path):
    rows = [(n, "\n".join(f"l{i}" for i in range(n))) for n in (100, 150, 151, 1200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue.queries()["chunk_whole_ranges"](spark, str(tmp_path)).where("end_line > 5").orderBy("doc_id", "start_line").collect()
    assert [(r.doc_id, r.start_line, r.end_line) for r in found] == [(n, *w) for n, _ in rows for w in ([(1, n)] if n <= 120 else windows(n))]


def test_headings(spark):
    text = "intro\n# a\nx\n```\n# b\n```\n# c\n# d"
    got = [r.content for r in chunk.headings(spark.createDataFrame([(text,)], "content string")).orderBy("section").collect()]
    assert got == ["intro", "# a\nx\n```", "# b\n```", "# c", "# d"]


def test_search_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0]), (5, [0.0, 1.0])], "id int, embedding array<float>")
    df = df.withColumn("repo_id", F.col("id") % 2)
    assert [r.id for r in search.search(df, [1.0, 0.0], 10).collect()] == [1, 4, 5, 2, 3]
    assert search.search(df, [1.0, 0.0], 0).count() == 0
    assert search.search(df, [1.0, 0.0], 5, scope=[]).count() == 0
    assert [r.id for r in search.search(df, [1.0, 0.0], 5, scope=[0]).collect()] == [4, 2]


@pytest.fixture()
def small_graph(spark):
    repos = spark.createDataFrame([("r", "repo")], "id string, name string")
    nodes = spark.createDataFrame([(x, "r", k, x, f, None, None) for x, k, f in [("f", "file", "f"), ("g", "file", "g"), ("f::a", "function", "f"), ("alone", "function", "z")]], "id string, repo_id string, node_type string, qualified_name string, file_path string, start_line int, end_line int")
    edges = spark.createDataFrame([("e1", "f", "g"), ("e2", "g", "f::a"), ("e3", "f", "f::a")], "id string, source_node_id string, target_node_id string")
    options = graph.hop_options(edges, nodes, repos)
    contents = nodes.select(F.col("id").alias("node_id"), F.col("id").alias("content"))
    return nodes, options, contents


class Says:
    def __init__(self, *answers):
        self.answers = list(answers)

    def decide(self, question, node, content, options):
        return self.answers.pop(0)


def test_hop_options_fall_back_to_the_file(small_graph):
    _, options, _ = small_graph
    got = {(r.node_id, r.target_node_id, r.via_file_level_import) for r in options.collect()}
    assert got == {("f", "g", False), ("f", "f::a", False), ("g", "f::a", False), ("f::a", "g", True)}


@pytest.mark.parametrize(
    ("policy", "start", "hops", "why", "n"),
    [
        (None, "f", 0, graph.MAX_HOPS, 0), (None, "f", 1, graph.MAX_HOPS, 1), (None, "nowhere", 5, graph.NOT_FOUND, 0), (None, "alone", 5, graph.DEAD_END, 1), (None, "g", 5, graph.CYCLE, 2),
        (Says("what"), "f", 5, graph.UNPARSEABLE, 1), (Says("[]"), "f", 5, graph.UNPARSEABLE, 1), (Says('{"sufficient": true}'), "f", 5, graph.SUFFICIENT, 1), (Says('{"follow_target_id": "x"}'), "f", 5, graph.INVALID, 1),
    ],
)
def test_trace_stops(small_graph, policy, start, hops, why, n):
    nodes, options, contents = small_graph
    steps, reason = graph.trace(options, nodes, contents, start, "how?", policy, hops)
    assert reason == why and len(steps) == n <= max(hops, 0)


def test_links(spark):
    endpoints = spark.createDataFrame([("a", "/orders/*", 1), ("b", "/orders/*", 2), ("c", "/x", 3)], "repo string, path string, ord int")
    repos = spark.createDataFrame([("a", 1), ("b", 2), ("note-svc", 3)], "repo string, ord int")
    calls = spark.createDataFrame([(1, "z", "http://h/v1/orders/{}"), (2, "a", "/orders/7"), (3, "c", "/x"), (4, "z", "http://NOTE_svc:1/none"), (5, "z", "/zzz"), (1 + 5, "z", "http://h/v1/orders/{}")], "call_id int, repo string, literal string")
    got = {(r.call_id, r.target_repo, r.confidence) for r in link.links(calls, endpoints, repos).collect()}
    assert got == {(1, "a", "confirmed"), (2, "b", "confirmed"), (4, "note-svc", "inferred"), (6, "a", "confirmed")} | {(r.call_id, r.target_repo, "inferred") for r in link.inferred(calls.where("call_id in (3, 5)"), repos).collect()}
    assert link.links(calls, endpoints, repos).where("repo = target_repo").count() == 0


def test_access(spark):
    grants = spark.createDataFrame([("r", "x")], "user_id string, repo_id string")
    assert answer.allowed_repos(grants, "r", ["x", "y"]) == ["x"]
    assert answer.allowed_repos(grants, "r", ["y"]) == []
    assert answer.allowed_repos(grants, "free", ["y", "x"]) == ["y", "x"]


def test_cascade_and_null(spark):
    repos = spark.createDataFrame([(1,), (2,)], "id int")
    nodes = spark.createDataFrame([(10, 1), (20, 2)], "n int, repo_id int")
    out = tables.delete_cascade(repos, repos.where("id = 1"), "id", {"nodes": (nodes, "repo_id")}, {"flags": (nodes, "repo_id")})
    assert [r.n for r in out["nodes"].collect()] == [20] and out["parent"].count() == 1
    assert {(r.n, r.repo_id) for r in out["flags"].collect()} == {(10, None), (20, 2)}


def test_snapshots(spark, tmp_path):
    store = tables.Snapshots(spark, f"file://{tmp_path}")
    store.write("t", spark.range(3))
    old = store.read("t")
    store.write("t", store.read("t").where("id > 0"))
    assert store.read("t").count() == 2 and old.count() == 3


def test_embedding(spark):
    df = spark.createDataFrame([("a b",), (None,)], "content string")
    got = embed.embed(df, embed.HashedTokens(8), dimension=8).collect()
    assert abs(sum(x * x for x in got[0].embedding) - 1) < 1e-6 and sum(got[1].embedding) == 0
    with pytest.raises(Exception, match="dimensions"):
        embed.embed(df, embed.HashedTokens(4), dimension=8).collect()


def test_throttle_and_retries():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    t = embed.Throttle(2, 60, lambda: now[0], sleep)
    for _ in range(5):
        t.wait()
    assert slept == [60.0, 60.0]
    tries = []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("429")
        return [1]

    assert embed.with_retries(call, sleep=slept.append) == [1] and slept[-2:] == [10.0, 20.0]
    with pytest.raises(ValueError):
        embed.with_retries(lambda: (_ for _ in ()).throw(ValueError("no")), sleep=slept.append)


def test_route_and_answer(spark):
    repos = [{"id": 1, "name": "a"}, {"id": 2, "name": "b"}]

    class M:
        def __init__(self, text):
            self.text = text

        def complete(self, prompt):
            return self.text

    assert answer.route("why?", []) == {"question_type": "general", "repo_ids": [], "needs_clarification": False, "clarification_message": None}
    assert answer.route("why?", repos[:1]) | {"x": 0} == {"question_type": "why_historical", "repo_ids": [1], "needs_clarification": False, "clarification_message": None, "x": 0}
    assert answer.route("q", repos, M("nonsense"))["repo_ids"] == [1, 2]
    assert answer.route("q", repos, M('{"repo_names": ["b", "zz"], "question_type": "general"}'))["repo_ids"] == [2]
    assert answer.route("q", repos, M('{"repo_names": ["b"], "confident": false}'))["needs_clarification"]
    hits = spark.createDataFrame([("a.py", 1, 2, "f", "text", 0.5), ("b.py", None, None, None, "more", 0.9)], "file_path string, start_line int, end_line int, qualified_name string, content string, similarity double")
    out = answer.synthesise(hits, "q")
    assert out["sources"] == ["[1] b.py", "[2] a.py:1-2 (f)"] and "[1] b.py:\nmore\n\n[2] a.py:1-2 (f):\ntext" in out["answer"]
    assert answer.synthesise(hits.where("false"), "q")["answer"] == answer.NOTHING


def test_decisions_come_in_batches():
    import pyarrow as pa

    rows = [{"trace_id": i // 2, "node_id": i // 2, "question": "q", "seen": [], "qualified_name": "n", "file_path": "f", "content": "", "option": {"target_node_id": i % 2 + 7}, "place": i} for i in range(2000)]
    batch = pa.RecordBatch.from_pylist(rows)
    told = list(graph._decide(graph.FirstOption())(iter([batch.slice(0, 1001), batch.slice(1001)])))
    assert len(told) <= 3 and [r["trace_id"] for b in told for r in b.to_pylist()] == list(range(1000))
    assert {(r["next"], r["options"], r["why"]) for b in told for r in b.to_pylist()} == {(7, 2, None)}
