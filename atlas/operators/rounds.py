"""Steps of an iteration as written tables: lineage stays short, and a lost executor costs its running tasks only."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Rounds:
    """Tables below spark.checkpoint.dir, which driver and executors share; they go when the driver ends.

    Where the session names no such folder and runs in one process (tests), a temporary one serves; on a cluster that is an error.
    """

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="rounds-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.base, self.paths = spark, f"{base.rstrip('/')}/rounds-{uuid.uuid4().hex}", []
        atexit.register(self._end)

    def _end(self) -> None:
        try:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may be gone by then
            pass

    def table(self, df: DataFrame) -> DataFrame:
        """df, written once and read back."""
        self.paths.append(f"{self.base}/{len(self.paths):04d}")
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def joined(self, like: DataFrame, paths: list[str]) -> DataFrame:
        """Several tables of one schema as one scan."""
        return self.spark.read.schema(like.schema).parquet(*paths)
