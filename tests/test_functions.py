"""Column functions on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from atlas.functions import text as X

PATHS = {
    "/v1/orders/42": "/orders/*", "/api/v1/x": "/v1/x", "/v1/api/x": "/api/x", "/orders/:id": "/orders/*", "/orders/<id>": "/orders/*", "/orders/{}": "/orders/*",
    "/orders/1?x=2": "/orders/1?x=2", "/api": "/", "/v1": "/", "": "/", "/Orders/1": "/Orders/*", "/v10/x": "/v10/x", "//a//b/": "/a//b", "{}/x": "/*/x",
}


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select(f(F.col("v")).alias("o"), "i").orderBy("i").collect()]


def test_normalize_path(spark):
    assert column(spark, list(PATHS), X.normalize_path) == list(PATHS.values())


def test_strip_host(spark):
    assert column(spark, ["http://h", "https://h/a?b=c", "/x", "http://{}/y"], X.strip_host) == ["/", "/a?b=c", "/x", "/y"]


def test_literals(spark):
    assert column(spark, ["/", "/a", "http://x", "ftp://x", "a/b"], X.is_url_literal) == [False, True, True, False, False]


def test_trim_all(spark):
    assert column(spark, ["\u00a0 a b\u2003\n", "\t", "x"], X.trim_all) == ["a b", "", "x"]


def test_question_type(spark):
    asked = ["Why is it so?", "Give an OVERVIEW of the design history", "how does it call", "what is it", "the design"]
    assert column(spark, asked, X.question_type) == ["why_historical", "why_historical", "specific_trace", "general", "architecture_overview"]


@pytest.mark.parametrize(("text", "good"), [('{"k": 1}', True), ('```json\n{"k": 1}\n```', True), ('```{"k": 1}```', True), ("so {", False), ("null", False), ("[]", False), (None, False)])
def test_safe_json(spark, text, good):
    assert (column(spark, [text], lambda c: X.safe_json(c, "k int")["k"]) == [1]) is good


def test_citation(spark):
    df = spark.createDataFrame([("a.py", 1, 3, "f", None, None, "code"), ("a.py", 0, 3, None, None, None, "code"), (None, None, None, None, "0123456789", None, "commit"), (None, None, None, None, None, 7, "pr"), (None, None, None, None, None, None, "doc")], "p string, s int, e int, q string, c string, n int, t string")
    assert [r[0] for r in df.select(X.citation(*[F.col(c) for c in "pseqcnt"])).collect()] == ["a.py:1-3 (f)", "a.py", "commit 01234567", "PR #7", "(doc)"]


def test_github(spark):
    urls = ["https://github.com/a/b", "https://github.com/a/b.git", "http://github.com/a/b/", "https://gitlab.com/a/b", "https://github.com/a/b/c"]
    assert column(spark, urls, X.github_repo) == ["b", "b", "b", None, None]


def test_upper_letters_as_in_the_sql(spark, duck):
    words = ["Erßie", "get", "ﬁn ŉ", "ᾳ ᾠδή ᾼ", "Ǆǆ", "a\n\U00010428", ""]
    assert column(spark, words, X.upper_letters) == [duck.execute("SELECT upper(?)", [w]).fetchall()[0][0] for w in words]
    assert column(spark, [None], X.upper_letters) == [None]


def test_endpoint_text_keeps_a_sharp_s_one_letter(spark):
    from atlas.operators import chunk

    assert column(spark, ["Erßie"], lambda c: chunk.endpoint_text(c, F.lit("/x"), F.lit("s"), F.lit(None).cast("string"))) == ["ERẞIE /x: s"]
