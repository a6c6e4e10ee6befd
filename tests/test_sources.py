"""Parsers and scans."""

import pytest
from pyspark.sql import functions as F

from atlas.sources import code, parse_js, parse_py, specs

CASES = [
    ("U='/a'\ndef f():\n    get(U)\n", ["/a"]),
    ("def f(x):\n    if x:\n        u='/a'\n    else:\n        u='/b'\n    get(u)\n", []),
    ("def f(x):\n    if x:\n        u='/a'\n        get(u)\n    else:\n        u='/b'\n        get(u)\n", ["/a", "/b"]),
    ("u='/a'\nu='/b'\nget(u)\n", ["/b"]),
    ("u='/a'\nu=u+'/x'\nget(u)\n", ["/a/x"]),
    ("import os\nB=os.getenv('B','http://h')\nget(B+'/x/'+str(i))\n", ["http://h/x/{}"]),
    ("import os\nB=os.getenv('B')\nget(B)\n", []),
    ("request('GET', '/x')\nget('a' '/b')\nget('/')\n", []),
    ("U='/g'\ndef f():\n    U=load()\n    get(U)\n", ["/g"]),
    ("try:\n    u='/a'\nexcept E:\n    u='/b'\nget(u)\n", []),
    ("u: str = '/typed'\nget(u)\n", ["/typed"]),
]


@pytest.mark.parametrize(("source", "literals"), CASES)
def test_python_literals(source, literals):
    assert parse_py.parse(source).literals == literals


JS_CASES = [
    ("const U = '/a'\nfunction f() { get(U) }\n", ["/a"]),
    ("function f(x) { if (x) { var u = '/a' } else { var u = '/b' }\n get(u) }\n", []),
    ("function f(x) { if (x) { const u = '/a'; get(u) } else { const u = '/b'; get(u) } }\n", ["/a", "/b"]),
    ("const f = (x) => { if (x) { var u = '/a' } else if (x > 1) { var u = '/b' } else { get(u) } }\n", []),
    ("const f = x => { if (x) var u = '/a'; else var u = '/b'\n get(u) }\n", []),
    ("var u = '/a'\nvar u = '/b'\nget(u)\n", ["/b"]),
    ("var u = '/a'\nvar u = u + '/x'\nget(u)\n", ["/a/x"]),
    ("const B = process.env.B || 'http://h'\nget(B + '/x/' + i)\n", ["http://h/x/{}"]),
    ("const B = other || 'http://h'\nget(B)\nconst C = process.env.C\nget(C)\n", []),
    ("const U = '/g'\nfunction f() { const U = load(); get(U) }\n", ["/g"]),
    ("const U = '/g'\nfunction f() { const U = '/l'; get(U) }\nget(U)\n", ["/l", "/g"]),
    ("function g() { const U = '/other' }\nfunction f() { get(U) }\nget(U)\n", []),
    ("class A { m(x: number): string { const u = '/m', v = `${u}/v`; get(v); return u }\n n() { get(u) } }\n", ["/m/v"]),
    ("const o = { m() { const u = '/m'; get(u) }, k: (a: string): void => { const u = '/k'; get(u) } }\n", ["/m", "/k"]),
    ("try { var u = '/a' } catch (e) { var u = '/b' }\nget(u)\n", ["/b"]),
    ("const u: string = '/typed'\nget(u)\n", ["/typed"]),
    ("get(u)\nconst u = '/late'\n", []),
]


@pytest.mark.parametrize(("source", "literals"), JS_CASES)
def test_javascript_literals(source, literals):
    assert parse_js.parse(source).literals == literals


def test_many_assignments():
    """A thousand assignments of one name, each used, in either language, and chains of names."""
    import time

    began, n = time.time(), 1000
    assert parse_py.parse("".join(f"u = '/x{i}'\nget(u)\n" for i in range(n))).literals == [f"/x{i}" for i in range(n)]
    assert parse_js.parse("".join(f"var u = '/x{i}'\nget(u)\n" for i in range(n))).literals == [f"/x{i}" for i in range(n)]
    assert parse_py.parse("u0 = '/x'\n" + "".join(f"u{i} = u{i - 1} + u{i - 1}\n" for i in range(1, 15)) + "get(u14)\n").literals == ["/x" * 2**14]
    assert parse_js.parse("var u0 = '/x'\n" + "".join(f"var u{i} = u{i - 1} + u{i - 1}\n" for i in range(1, 15)) + "get(u14)\n").literals == ["/x" * 2**14]
    assert time.time() - began < 20


def test_python_definitions():
    source = "@d\ndef a(): pass\nclass B:\n    def m(self): pass\nasync def c(): pass\nif x:\n    def no(): pass\nfrom __future__ import annotations\nimport os\ndef z():\n    import json\n    a()\n"
    found = parse_py.parse(source)
    assert [(d[0], d[1]) for d in found.definitions] == [("function", "a"), ("class", "B"), ("function", "c"), ("function", "z")]
    assert [d[1] for d in parse_py.parse(source, strict=True).definitions] == ["B", "c", "z"]
    assert found.imports == ["import os", "import json"] and found.calls == ["a"]
    with pytest.raises(SyntaxError):
        parse_py.parse("def (:")


def test_javascript():
    source = "import x from './x'\n// function no() {}\nfunction a() { return `b ${'{'}` }\nconst b = async (y) => { get(`${H}/p/${y}`) }\nconst H = 'http://h'\nconst K = process.env.K || '/k'\nfetch(K)\nexport class C {}\n"
    found = parse_js.parse(source)
    assert [(d[0], d[1]) for d in found.definitions] == [("function", "a"), ("function", "b"), ("class", "C")]
    assert found.imports == ["import x from './x'"] and found.literals == ["/k"]
    assert [d[1] for d in parse_js.parse(source, strict=True).definitions] == ["a", "b"]
    with pytest.raises(SyntaxError):
        parse_js.parse("function a() {")


@pytest.mark.parametrize(
    ("raw", "path", "wanted"),
    [
        ("from .a.b import c", "p/q/m.py", ["p/q/a/b.py"]), ("from .. import c", "p/q/m.py", ["p/__init__.py"]), ("from ... import c", "m.py", []),
        ("from a import c", "p/m.py", ["a.py", "a/__init__.py", "p/a.py"]), ("from a.b import c", "p/m.py", ["a/b.py", "a/b/__init__.py"]), ("import a.b as c", "p/m.py", ["a/b.py"]), ("import a", "m.py", ["a.py", "a.py"]), ("import a, b", "m.py", []),
        ("import x from '../y'", "s/t/m.ts", ["s/y.ts", "s/y.tsx", "s/y.js", "s/y.jsx"]), ("import x from 'react'", "m.ts", []),
    ],
)
def test_import_candidates(raw, path, wanted):
    assert code.import_candidates(raw, path) == wanted


def test_specs():
    assert specs.operations('{"swagger": "2", "paths": {"/a": {"get": {"summary": "s"}, "x-y": 1}}}', "my-spec.json") == [("get", "/a", "s", None)]
    assert specs.operations('{"paths": {"/a": {"get": {}}}}', "my-spec.json") == []
    assert specs.operations("{", "openapi.json") == [] and specs.operations("- 1", "openapi.yaml") == []


def test_files_and_log(spark, tmp_path):
    import subprocess

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_bytes(b"A = '\xff/a'\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "y.js").write_text("")
    got = [(r.file_path, r.content) for r in code.read_files(spark, f"file://{tmp_path}", "r").collect()]
    assert got == [("a/x.py", "A = '/a'\n")]
    assert specs.list_files(str(tmp_path)) == ["a/x.py"]
    git = ["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@example.com"]
    subprocess.run([*git, "init", "-q"], check=True)
    subprocess.run([*git, "add", "a"], check=True)
    subprocess.run([*git, "commit", "-qm", "subject\n\nbody"], check=True)
    from atlas.operators import chunk

    assert [r.content for r in chunk.commits(specs.git_log(spark, {"r": str(tmp_path), "none": "/nowhere"})).collect()] == ["subject\nbody"]


def planned(query, spark, sf_dir):
    from atlas.plans import fixtures

    return getattr(fixtures, query)(spark, sf_dir)


def test_mapping_errors_parse_each_file_once(spark, sf_dir):
    found = planned("mapping_errors", spark, sf_dir)
    assert "MapInArrow" not in found._jdf.queryExecution().toString()  # what the parsers found is written before it is read
    assert found.count() > 0


def test_one_split_of_rows_is_parsed_by_many_tasks(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    assert rows.select(F.spark_partition_id()).distinct().count() == 1
    assert planned("web_literals", spark, sf_dir).select(F.spark_partition_id()).distinct().count() >= spark.sparkContext.defaultParallelism


def test_nodes_parse_each_file_once(spark, sf_dir):
    for query in ("web_nodes", "source_nodes", "nodes_with_literals", "precise_nodes"):
        assert "MapInArrow" not in planned(query, spark, sf_dir)._jdf.queryExecution().toString()


def test_a_token_costs_few_calls():
    """A file's tokens, and what stands around each, are found in bulk and not by calls for every one."""
    import sys

    source = "a = b + 1;\n" * 2000
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        parse_js.parse(source)
    finally:
        sys.setprofile(None)
    assert calls < 2 * 6 * 2000


def test_tokens_keep_kind_and_place():
    source = " /* a */ x1 ='b' // c\n+ \"d ` `e` ٣4 é => $ /* never"
    file = parse_js._File(source)
    assert [(kind, text) for kind, text, *_ in file.tokens] == [("word", "x1"), ("mark", "="), ("string", "'b'"), ("mark", "+"), ("other", '"'), ("word", "d"), ("template", "` `"), ("word", "e"), ("other", "`"), ("number", "٣4"), ("other", "é"), ("mark", "=>"), ("word", "$")]
    assert all(source[a:b] == text for _, text, a, b in file.tokens) and len(file.depth) == len(file.tokens)
