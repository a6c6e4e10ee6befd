"""From a question to an answer: routing, retrieval within what a user may see, and cited context."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlas.functions import text as X
from atlas.operators import search, tables
from atlas.operators.graph import parse_decision

# Fixed value: what an answer says when nothing was found.
NOTHING = "No relevant content was found."


class Model(Protocol):
    def complete(self, prompt: str) -> str: ...


def heuristic_type(question: str) -> str:
    """question_type() of one string, on the driver."""
    low = question.lower()
    return next((name for name, words in X.QUESTION_TYPES if any(w in low for w in words)), "general")


def route(question: str, repos: list[dict], model: Model | None = None) -> dict:
    """question_type, repo_ids, needs_clarification, clarification_message. No repository: the type general, and nothing to search; one: that one, by the
    keywords of the question; more: the model's JSON {question_type, repo_names, confident}. Where it can't be read, names no known
    repository or isn't sure, a request to be clearer comes with the repositories that it named, or with all. Without a model the keywords
    give the type, and all repositories are searched."""
    out = {"question_type": heuristic_type(question), "repo_ids": [], "needs_clarification": False, "clarification_message": None}
    if not repos:
        return out | {"question_type": "general"}
    if len(repos) == 1:
        return out | {"repo_ids": [repos[0]["id"]]}
    everything = [r["id"] for r in repos]
    if model is None:
        return out | {"repo_ids": everything}
    names = ", ".join(r["name"] for r in repos)
    unsure = {"needs_clarification": True, "clarification_message": f"Which of these do you mean: {names}?"}
    said = parse_decision(model.complete(f"Repositories: {names}\nQuestion: {question}\nAnswer as JSON: question_type, repo_names, confident."))
    if said is None:
        return out | {"question_type": "general", "repo_ids": everything} | unsure
    out["question_type"] = said.get("question_type") or "general"
    chosen = named_repos(said.get("repo_names"), repos)
    if not chosen or not said.get("confident", False):
        return out | {"repo_ids": chosen or everything} | unsure
    return out | {"repo_ids": chosen}


def named_repos(names: list[str] | None, repos: list[dict]) -> list:
    """Ids of the repositories that a model named, in its order; unknown names are dropped, repeated ones stay."""
    by_name = {r["name"]: r["id"] for r in repos}
    return [by_name[n] for n in names or [] if n in by_name]


class Models:
    """A model for each role (routing, tracing, answering): made by its provider's factory when it is first asked for, and kept."""

    def __init__(self, roles: dict[str, tuple[str, str]], factories: dict[str, Callable[[str], Model]]):
        self.roles, self.factories, self.made = roles, factories, {}

    def of(self, role: str) -> Model:
        if role not in self.made:
            provider, name = self.roles[role]
            self.made[role] = self.factories[provider](name)
        return self.made[role]


def allowed_repos(grants: DataFrame, user: str | None, repo_ids: list) -> list:
    """repo_ids that the user may see, in order; a user without grants sees all of them."""
    if user is None:
        return repo_ids
    mine = {r[0] for r in grants.where(F.col("user_id") == user).select("repo_id").distinct().collect()}  # a small dimension of one user
    return [r for r in repo_ids if r in mine] if mine else repo_ids


def retrieve(chunks: DataFrame, grants: DataFrame, user: str | None, repo_ids: list, query: list[float], k: int = 8, key: str = "id") -> DataFrame:
    """The k most similar chunks of the repositories that the user may see; none if there is no such repository."""
    return search.search(chunks, query, k, scope=allowed_repos(grants, user, repo_ids), key=key)


def synthesise(hits: DataFrame, question: str, model: Model | None = None) -> dict:
    """answer and sources from hits in order of similarity. Without a model the answer is the context itself."""
    cite = X.citation(*[F.col(c) if c in hits.columns else F.lit(None) for c in ("file_path", "start_line", "end_line", "qualified_name", "commit_sha", "pr_number", "source_type")])
    found = tables.context(hits.select(F.lit(1).alias("q"), "similarity", cite.alias("citation"), "content"), ["q"], [F.desc_nulls_last("similarity"), F.col("citation")]).collect()
    if not found:
        return {"answer": NOTHING, "sources": []}
    context, sources = found[0]["context"], found[0]["sources"].split("\n")
    body = model.complete(f"Question: {question}\n\n{context}") if model else context
    return {"answer": f"{body}\n\nSources:\n" + "\n".join(sources), "sources": sources}


def ask(question: str, repos: DataFrame, chunks: DataFrame, grants: DataFrame, embedder, user: str | None = None, model: Model | None = None) -> dict:
    """Routes a question over the active repositories, retrieves and answers it."""
    active = [r.asDict() for r in repos.where("status = 'active'").orderBy("name").select("id", "name").collect()]
    routed = route(question, active, model)
    if routed["needs_clarification"]:
        return routed | {"answer": routed["clarification_message"], "sources": []}
    hits = retrieve(chunks, grants, user, routed["repo_ids"], embedder.embed([question])[0])
    return routed | synthesise(hits, question, model)


def trace_chunks(steps: list[dict]) -> list[dict]:
    """Trace steps as hits for synthesise()."""
    return [{"file_path": s["file_path"], "qualified_name": s["qualified_name"], "content": s["content"], "similarity": 1.0 / (i + 1), "source_type": "code"} for i, s in enumerate(steps)]

