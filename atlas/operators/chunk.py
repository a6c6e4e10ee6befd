"""Chunkers: code ranges, line windows, heading sections, API endpoints. All stay row by row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlas.functions.text import trim_all, upper_letters

# Lines of a window, lines that neighbours share, and the longest range that stays whole.
WINDOW, OVERLAP, LONGEST = 60, 10, 120
#: What a line ends with where every kind of line break counts.
ANY_BREAK = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\u0085\\u2028\\u2029]"


def lines(text: Column, any_break: bool = False) -> Column:
    """Lines of a text; a line break at its end adds none."""
    parts = F.split(F.coalesce(text, F.lit("")), ANY_BREAK if any_break else "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def window_spans(of: Column, first: Column | int = 1) -> Column:
    """array<struct<start_line, end_line, content>> of overlapping windows; the last one reaches the end. first: number of the first line."""
    step = WINDOW - OVERLAP
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size(of) - WINDOW) / F.lit(float(step))).cast("int"), F.lit(0)))
    spans = F.transform(
        F.when(F.size(of) > 0, starts).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            (i * step + first).alias("start_line"),
            (F.least(i * step + WINDOW, F.size(of)) + first - 1).alias("end_line"),
            trim_all(F.array_join(F.slice(of, i * step + 1, WINDOW), "\n")).alias("content"),
        ),
    )
    return F.filter(spans, lambda s: s["content"] != "")


def windows(files: DataFrame, text: str = "content") -> DataFrame:
    """files with start_line, end_line and content of each window that isn't blank."""
    kept = [c for c in files.columns if c != text]
    return files.select(*kept, F.explode(window_spans(lines(F.col(text)))).alias("w")).select(*kept, "w.*")


def ranges(spans: DataFrame, text: str = "content", strict: bool = False) -> DataFrame:
    """One chunk for each row's start_line to end_line of its text; ranges of over LONGEST lines become windows.

    Windows carry lines of the file; with strict, lines of the range, as the original numbers them.
    """
    kept = [c for c in spans.columns if c not in (text, "start_line", "end_line")]
    mine = F.slice(lines(F.col(text)), F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)))
    whole = F.array(F.struct(F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), trim_all(F.array_join("ls", "\n")).alias("content")))
    first = F.lit(1) if strict else F.col("start_line").cast("int")
    parts = F.when(F.col("end_line") - F.col("start_line") + 1 > LONGEST, window_spans(F.col("ls"), first)).otherwise(F.filter(whole, lambda s: s["content"] != ""))
    return spans.withColumn("ls", mine).select(*kept, F.explode(parts).alias("w")).select(*kept, "w.*")


def headings(files: DataFrame, text: str = "content") -> DataFrame:
    """files with section (from 0) and content: sections begin at lines that begin with #; those of over WINDOW lines become windows."""
    kept = [c for c in files.columns if c != text]
    ls = lines(F.col(text), any_break=True)
    begins = F.filter(F.sequence(F.lit(1), F.size("ls")), lambda i: F.element_at(F.col("ls"), i).startswith("#") | (i == 1))
    held = files.withColumn("ls", ls).where(F.size("ls") > 0).withColumn("at", begins)
    sections = F.transform("at", lambda a, k: F.slice(F.col("ls"), a, F.coalesce(F.get("at", k + 1), F.size("ls") + 1) - a))
    pieces = F.flatten(F.transform(sections, lambda s: F.when(F.size(s) > WINDOW, F.transform(window_spans(s), lambda w: w["content"])).otherwise(F.array(trim_all(F.array_join(s, "\n"))))))
    return held.select(*kept, F.posexplode(F.filter(pieces, lambda c: c != "")).alias("section", "content"))


def endpoint_text(method: Column, path: Column, summary: Column, description: Column) -> Column:
    """METHOD path: summary, and the description on the next line."""
    return trim_all(F.concat(upper_letters(method), F.lit(" "), path, F.lit(": "), F.coalesce(summary, F.lit("")), F.lit("\n"), F.coalesce(description, F.lit(""))))


def pull_request_text(number: Column, title: Column, body: Column) -> Column:
    return trim_all(F.concat(F.lit("PR #"), number.cast("string"), F.lit(": "), F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit(""))))


def commits(logs: DataFrame, log: str = "log") -> DataFrame:
    """commit_sha and content of each record of a git log: records end with \\x1e, fields with \\x1f; records of one field and blank ones go."""
    kept = [c for c in logs.columns if c != log]
    records = F.explode(F.filter(F.transform(F.split(log, "\u001e", -1), trim_all), lambda r: r != "")).alias("r")
    fields = logs.select(*kept, records).withColumn("f", F.split("r", "\u001f", -1)).where(F.size("f") >= 2)
    content = trim_all(F.concat(F.element_at("f", 2), F.lit("\n"), F.coalesce(F.get("f", F.lit(2)), F.lit(""))))
    return fields.select(*kept, F.element_at("f", 1).alias("commit_sha"), content.alias("content")).where("content <> ''")
