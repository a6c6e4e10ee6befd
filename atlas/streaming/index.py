"""Chunks of files as they arrive. The reference indexes on request only; this is an extension on the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlas.operators import chunk
from atlas.operators.tables import node_id


def chunks(files: DataFrame, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Line windows of each file of a stream: id, repo_id, file_path, start_line, end_line, content. With a time column a file version that
    comes again within the delay counts once; what the state keeps is bounded by the watermark."""
    rows = files.withColumn("version", F.sha2(F.concat_ws("\u0001", "repo_id", "file_path", "content"), 256))
    if time:
        rows = rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(["version"])
    found = chunk.windows(rows.select("repo_id", "file_path", "version", "content"))
    return found.select(node_id(F.col("version"), F.col("start_line")).alias("id"), "repo_id", "file_path", "start_line", "end_line", "content")


def write(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Appends chunks to a Parquet folder; restarts go on where the checkpoint says."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)
