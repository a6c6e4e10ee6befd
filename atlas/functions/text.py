"""Column functions on paths, names, questions and citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Version prefixes, of which one at most is dropped, in this order; keywords of question types, in order of precedence; and the form of a repository's address.
PREFIXES = ["v1", "v2", "v3", "api"]
QUESTION_TYPES = [
    ("why_historical", ["why", "reason", "decided", "history"]),
    ("architecture_overview", ["architecture", "overview", "design"]),
    ("specific_trace", ["how does", "trace", "flow", "call"]),
]
GITHUB = r"^https?://github\.com/([^/]+)/([^/]+?)(?:\.git)?/?$"
# Small letters whose capital is one letter, though upper() makes two of it, and these capitals.
SMALL = "\u00df" + "".join(map(chr, [*range(0x1F80, 0x1F88), *range(0x1F90, 0x1F98), *range(0x1FA0, 0x1FA8), 0x1FB3, 0x1FC3, 0x1FF3]))
CAPITAL = "\u1e9e" + "".join(map(chr, [*range(0x1F88, 0x1F90), *range(0x1F98, 0x1FA0), *range(0x1FA8, 0x1FB0), 0x1FBC, 0x1FCC, 0x1FFC]))


def trim_all(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def upper_letters(text: Column) -> Column:
    """Upper case letter by letter, as DuckDB has it: a letter that has no single capital stays."""
    letters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return F.array_join(F.transform(letters, lambda c: F.when(F.length(F.upper(c)) > 1, F.translate(c, SMALL, CAPITAL)).otherwise(F.upper(c))), "")


def strip_host(url: Column) -> Column:
    """The path and query of an http address; "/" if it has none."""
    rest = F.regexp_replace(url, r"^https?://[^/]*", "")
    return F.when(rest == "", "/").otherwise(rest)


def normalize_path(path: Column) -> Column:
    """Without one version prefix and outer slashes; parameters and numbers become *."""
    bare = F.regexp_replace(path, rf"^/({'|'.join(PREFIXES)})(?=/|$)", "")
    parts = F.split(F.regexp_replace(bare, r"^/+|/+$", ""), "/", -1)
    stars = F.transform(parts, lambda s: F.when(s.rlike(r"^([{:<].*|[0-9]+)$"), "*").otherwise(s))
    return F.concat(F.lit("/"), F.array_join(stars, "/"))


def is_url_literal(text: Column) -> Column:
    """Literals that can be the target of an HTTP call."""
    return text.rlike("^https?://") | (text.startswith("/") & (F.length(text) > 1))


def name_norm(name: Column) -> Column:
    """Lower case, without hyphens and underscores."""
    return F.translate(F.lower(name), "-_", "")


def question_type(question: Column) -> Column:
    """The first type one of whose keywords is in the question."""
    out, low = None, F.lower(question)
    for name, words in QUESTION_TYPES:
        found = F.lit(False)
        for w in words:
            found = found | low.contains(w)
        out = F.when(found, name) if out is None else out.when(found, name)
    return out.otherwise("general")


def github_owner(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, GITHUB, 1), F.lit(""))


def github_repo(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, GITHUB, 2), F.lit(""))


def unfenced(text: Column) -> Column:
    """A model's answer without white space, code fences and a leading "json"."""
    bare = F.regexp_replace(trim_all(text), r"^`+|`+$", "")
    return trim_all(F.regexp_replace(bare, r"(?i)^json", ""))


def safe_json(text: Column, schema: str) -> Column:
    """The parsed object; null where the text holds no JSON object."""
    body = unfenced(text)
    return F.when(F.expr("true") & F.try_parse_json(body).isNotNull() & body.startswith("{"), F.from_json(body, schema))


def citation(file_path: Column, start: Column, end: Column, qualified: Column, commit: Column, pr: Column, source: Column) -> Column:
    """path:start-end (name), or the path, the commit, the pull request, or the kind of source. Line 0 counts as none."""
    lines = (F.coalesce(start, F.lit(0)) != 0) & (F.coalesce(end, F.lit(0)) != 0)
    there = F.coalesce(file_path, F.lit("")) != ""
    name = F.when(F.coalesce(qualified, F.lit("")) != "", F.concat(F.lit(" ("), qualified, F.lit(")"))).otherwise("")
    return (
        F.when(there & lines, F.concat(file_path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), name))
        .when(there, file_path)
        .when(F.coalesce(commit, F.lit("")) != "", F.concat(F.lit("commit "), F.substring(commit, 1, 8)))
        .when(F.coalesce(pr, F.lit(0)) != 0, F.concat(F.lit("PR #"), pr.cast("string")))
        .otherwise(F.concat(F.lit("("), source, F.lit(")")))
    )
