"""Python data sources: pull requests page by page, and clones of repositories, read by the executors."""

from __future__ import annotations

import json
import os
import subprocess
import urllib.request
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from atlas.functions import text as X
from atlas.operators import chunk

from .specs import COMMITS, list_files

# Pull requests that are read of a repository, those of a page, seconds that a request may take, where requests go, the token's name.
PULLS, PAGE, TIMEOUT = 100, 100, 10
API, TOKEN = "https://api.github.com/repos/{owner}/{repo}/pulls?state=all&per_page={size}&page={page}", "GITHUB_TOKEN"


class Pages(Protocol):
    """Gives a page (from 1) of a repository's pull requests: objects with number, title, body and state; an empty list after the last one. Whatever
    goes wrong is raised. It is sent to the executors."""

    def page(self, owner: str, repo: str, number: int, size: int) -> list[dict]: ...


class GitHub:
    def page(self, owner: str, repo: str, number: int, size: int) -> list[dict]:
        request = urllib.request.Request(API.format(owner=owner, repo=repo, size=size, page=number), headers={"Accept": "application/vnd.github+json"})
        if token := os.environ.get(TOKEN):
            request.add_header("Authorization", f"Bearer {token}")
        with urllib.request.urlopen(request, timeout=TIMEOUT) as answer:
            if answer.status != 200:
                raise OSError(f"status {answer.status}")
            return json.load(answer)


class Dump:
    """Pages kept as folders owner=.../repo=.../page=... of JSON lines, in any file system that Arrow can open. A folder that is missing is an empty page."""

    def __init__(self, root: str):
        self.root = root

    def page(self, owner: str, repo: str, number: int, size: int) -> list[dict]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(self.root)
        found = files.get_file_info(fs.FileSelector(f"{base}/owner={owner}/repo={repo}/page={number}", allow_not_found=True))
        out = []
        for at in sorted(x.path for x in found if x.is_file and not x.base_name.startswith(("_", "."))):
            with files.open_input_stream(at) as f:
                out += [json.loads(line) for line in f.read().decode().splitlines() if line]
        return sorted(out, key=lambda x: x["place"])


class _Page(InputPartition):
    def __init__(self, repo_id: str, owner: str, repo: str, first: int, last: int):
        self.repo_id, self.owner, self.repo, self.first, self.last = repo_id, owner, repo, first, last


def page_source(pages: Pages, span: int) -> type[DataSource]:
    """A data source of raw pages: one partition for each span pages of a repository.

    Rows: repo_id, page, place, number, title, body, state, error. A page that can't be read is one row with an error, and its partition stops there; an
    empty page is one row without a place.
    """

    class Reader(DataSourceReader):
        def __init__(self, repos: list, size: int, most: int):
            self.repos, self.size, self.most = repos, size, most

        def partitions(self):
            n = -(-self.most // self.size)
            return [_Page(*r, first, min(first + span, n + 1)) for r in self.repos for first in range(1, n + 1, span)] or [_Page("", "", "", 1, 1)]

        def read(self, part):
            for number in range(part.first, part.last):
                try:
                    found = pages.page(part.owner, part.repo, number, self.size)
                    rows = [(part.repo_id, number, i, int(x["number"]), str(x.get("title") or ""), str(x.get("body") or ""), x.get("state"), None) for i, x in enumerate(found)]
                except Exception as e:  # noqa: BLE001  whatever a page says, those before it stand
                    yield part.repo_id, number, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500]
                    return
                yield from rows or [(part.repo_id, number, None, None, None, None, None, None)]
                if not rows:
                    return

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return "pull_request_pages"

        def schema(self) -> str:
            return "repo_id string, page int, place int, number int, title string, body string, state string, error string"

        def reader(self, schema):
            return Reader(json.loads(self.options["repos"]), int(self.options["size"]), int(self.options["most"]))

    return Source


def pull_requests(spark: SparkSession, repos: DataFrame, pages: Pages | None = None, most: int = PULLS, size: int = PAGE, span: int = 1) -> tuple[DataFrame, DataFrame]:
    """Pull requests (repo_id, pr_number, state, content) of repositories (id, git_url), and the pages that failed (repo_id, page, error).

    Of a repository the first `most` count, in the order of pages of `size`. Pages are read side by side; what stands behind the first page
    that fails or is empty is left out, as if they had been read one after another. A repository with another kind of address has none. The
    list of repositories, one line each, goes through the driver.
    """
    known = repos.select(F.col("id").cast("string").alias("id"), X.github_owner(F.col("git_url")).alias("owner"), X.github_repo(F.col("git_url")).alias("repo")).where("owner is not null and repo is not null")
    listed = [list(r) for r in known.orderBy("id").collect()]
    spark.dataSource.register(page_source(pages or GitHub(), span))
    raw = spark.read.format("pull_request_pages").options(repos=json.dumps(listed), size=str(size), most=str(most)).load()
    ends = raw.where("place is null").groupBy("repo_id").agg(F.min("page").alias("_end"), F.min_by("error", "page").alias("error"))
    read = raw.where((F.col("place").isNotNull()) & ((F.col("page") - 1) * size + F.col("place") < most))
    kept = read.join(ends.select("repo_id", "_end"), "repo_id", "left").where("_end is null or page < _end")
    content = chunk.pull_request_text(F.col("number"), F.col("title"), F.col("body"))
    failed = ends.where("error is not null").select("repo_id", F.col("_end").alias("page"), "error")
    return kept.select("repo_id", F.col("number").alias("pr_number"), "state", content.alias("content")).where("content <> ''"), failed


class _Clone(InputPartition):
    def __init__(self, repo_id: str, folder: str):
        self.repo_id, self.folder = repo_id, folder


def _log(folder: str) -> Iterator[tuple]:
    done = subprocess.run(["git", "-C", folder, "log", f"-{COMMITS}", "--pretty=format:%H%x1f%s%x1f%b%x1e"], capture_output=True, text=True, errors="ignore", check=False)
    yield (done.stdout if done.returncode == 0 else "",)


def _files(folder: str) -> Iterator[tuple]:
    for path in list_files(folder):
        try:
            with open(os.path.join(folder, path), "rb") as f:
                yield path, f.read().decode("utf-8", "ignore")
        except OSError:
            continue  # a link to nowhere, or a file that went meanwhile


class Clones(DataSource):
    """Clones below a root that all executors share, one partition a repository. Option what: log (repo_id, log) or files (repo_id, file_path, content)."""

    READ = {"log": (_log, "log string"), "files": (_files, "file_path string, content string")}

    @classmethod
    def name(cls) -> str:
        return "clones"

    def schema(self) -> str:
        return "repo_id string, " + self.READ[self.options["what"]][1]

    def reader(self, schema):
        what, repos = self.READ[self.options["what"]][0], json.loads(self.options["repos"])

        class Reader(DataSourceReader):
            def partitions(self):
                return [_Clone(*r) for r in repos] or [_Clone("", "")]

            def read(self, part):
                for row in what(part.folder) if part.folder else ():
                    yield part.repo_id, *row

        return Reader()


def clones(spark: SparkSession, folders: dict[str, str], what: str = "files") -> DataFrame:
    """Files that git tracks (else all outside ignored folders), or commit logs, of clones by repository. Git runs on the executors; the driver only tells the folders."""
    spark.dataSource.register(Clones)
    return spark.read.format("clones").options(what=what, repos=json.dumps(sorted(folders.items()))).load()
