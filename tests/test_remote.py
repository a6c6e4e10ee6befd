"""Sources that executors read, and requests that tasks share."""

import subprocess

import pytest
from pyspark.sql import functions as F

from atlas.operators import embed
from atlas.sources import remote


class Answers:
    """Pages by repository; an exception in place of a page is raised."""

    def __init__(self, pages):
        self.pages = pages

    def page(self, owner, repo, number, size):
        found = self.pages[repo]
        if number > len(found):
            return []
        if found[number - 1] is None:
            raise OSError("403")
        return [{"number": n, "title": "t", "body": None, "state": "open"} for n in found[number - 1]]


@pytest.mark.parametrize("span", [1, 2, 5])
def test_pull_requests(spark, span):
    repos = spark.createDataFrame([(r, f"https://github.com/o/{r}") for r in ("whole", "broken", "none", "many", "first")] + [("local", "/clones/x"), ("other", None)], "id string, git_url string")
    pages = Answers({"whole": [[1, 2], [3]], "broken": [[1, 2], None, [5, 6]], "none": [], "many": [[i, i + 1] for i in range(1, 40, 2)], "first": [None, [3, 4]]})
    found, failed = remote.pull_requests(spark, repos, pages, most=9, size=2, span=span)
    got = {}
    for r in found.orderBy("repo_id", "pr_number").collect():
        got.setdefault(r.repo_id, []).append(r.pr_number)
    assert got == {"whole": [1, 2, 3], "broken": [1, 2], "many": list(range(1, 10))}
    assert {(r.repo_id, r.page, r.error) for r in failed.collect()} == {("broken", 2, "OSError: 403"), ("first", 1, "OSError: 403")}
    assert {r.content for r in found.where("pr_number = 1").collect()} == {"PR #1: t"}
    assert remote.pull_requests(spark, repos.where("false"), pages)[0].count() == 0


def test_clones_are_read_by_executors(spark, tmp_path):
    folders = {}
    for name in ("a", "b"):
        at = tmp_path / name
        (at / "src").mkdir(parents=True)
        (at / "src" / "x.py").write_bytes(b"A = '\xff/a'\n")
        (at / "notes.bin").write_text("not tracked")
        git = ["git", "-C", str(at), "-c", "user.name=n", "-c", "user.email=e@example.com"]
        for args in (["init", "-q"], ["add", "src"], ["commit", "-qm", f"first of {name}"]):
            subprocess.run([*git, *args], check=True)
        folders[name] = str(at)
    folders["c"] = str(tmp_path / "nowhere")
    files = remote.clones(spark, folders)
    assert sorted((r.repo_id, r.file_path, r.content) for r in files.collect()) == [(n, "src/x.py", "A = '/a'\n") for n in "ab"]
    assert files.rdd.getNumPartitions() == 3
    logs = {r.repo_id: r.log for r in remote.clones(spark, folders, "log").collect()}
    assert logs["c"] == "" and "first of b" in logs["b"]


class Stamped:
    """The time of each request as its vectors."""

    def embed(self, texts):
        import time

        now = time.time() % 100_000
        return [[now // 1000, now % 1000] for _ in texts]


def test_tasks_share_one_budget(spark):
    """Four tasks that run together never make more than 6 requests in two seconds."""
    rows = spark.range(embed.BATCH * 14).withColumn("content", F.lit("x"))
    found = embed.embed(rows, Stamped(), dimension=2, requests=6, workers=4, period=2.0)
    at = sorted({round(r.embedding[0] * 1000 + r.embedding[1], 4) for r in found.select("embedding").distinct().collect()})
    assert len(at) >= 10 and all(b - a > 1.9 for a, b in zip(at, at[6:]))
    assert [embed.share(90, 4, i) for i in range(4)] == [23, 23, 22, 22] and embed.share(2, 1, 0) == 2
