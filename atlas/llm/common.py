"""What the operators share: a shared work folder, Arrow batches of bounded size, byte-level words."""

from __future__ import annotations

import atexit
import ctypes
import functools
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into arrays at once; one longer text stands alone.
SLICE_BYTES = 2 << 20
#: Tables that one query writes between two collections of the driver's garbage.
SETTLE = 8
#: Bytes of rows that Spark sends to a Python worker at once, where the session doesn't say: JVM and worker hold them side by side.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where the session names no such folder and runs in one process (tests) is a temporary one set; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="atlas-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/atlas-{uuid.uuid4().hex}"


def _filesystem(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _filesystem(spark, path)
    fs.delete(at, True)


class Work:
    """Tables written by one query. They are removed when the driver ends, or earlier by drop()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, shared_dir(spark), 0
        if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        atexit.register(self._end)

    def _end(self) -> None:
        try:
            remove(self.spark, self.base)
        except Exception:  # noqa: BLE001  the session may be gone by then
            pass

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df once and reads it back: lineage is cut and lost executors cost nothing."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._work_path = path
        if self.n % SETTLE == 0:  # operators of many steps would else fill the driver's heap with plans of steps that are done
            settle(self.spark)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, t._work_path)


@functools.cache
def _trim():
    """glibc's malloc_trim, or None where the C library has none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None


def give_back() -> None:
    """Returns memory that this process no longer uses: workers are kept between tasks, and an executor holds several."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def settle(spark: SparkSession) -> None:
    """Ends a step on the driver: its Python returns memory; its JVM collects the step's plans and task records, and shrinks its heap."""
    give_back()
    spark._jvm.System.gc()


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, within: str | None = None, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Cuts batches between rows so that each holds about limit bytes of the column, which is taken out of the struct column `within` if
    one is named. Null texts become empty. Few rows are copied at once, and what was copied is given back before the next batch."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            some = batch.slice(first, rows)
            text = pc.struct_field(some.column(within), column) if within else some.column(column)
            text = pc.fill_null(text.cast(pa.large_string()), "")
            at = some.schema.get_field_index(column)
            some = some.append_column(column, text) if within else some.set_column(at, column, text)
            ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            row = 0
            while row < len(text):
                to = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
                yield some.slice(row, to - row)
                row = to
        give_back()


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a large_string array, and where each row begins and the last ends."""
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def byte_table(is_word) -> np.ndarray:
    """For each byte 0 outside words, else the byte with A-Z lowered."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[[b for b in range(256) if not is_word(b)]] = 0
    return t


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lowering A-Z: digits, letters and every byte of a non-ASCII character.
ALNUM = byte_table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)

_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Words of a slice of texts: hash, byte span in the slice, and the first word of each row."""

    def __init__(self, text: pa.Array, table: np.ndarray = ALNUM):
        data, ends = text_bytes(text)
        self.bytes = table[data]
        inside = self.bytes != 0
        edge = np.zeros(len(data) + 1, bool)
        edge[ends] = True
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        if len(inside):
            before[0] = False
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        if len(inside):
            after[-1] = False
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, ends)  # word index at which each row begins; rows + 1 long
        if len(self.start):
            power = np.full(len(data), _R)
            power[0] = 1
            np.multiply.accumulate(power, out=power)
            power *= self.bytes
            sums = np.add.reduceat(power, self.start)
            del power  # eight bytes a byte of text, as the next one has
            inverse = np.full(len(data), _RINV)
            inverse[0] = 1
            np.multiply.accumulate(inverse, out=inverse)
            self.hash = mix64(sums * inverse[self.start])
        else:
            self.hash = np.zeros(0, np.uint64)

    def prefix(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of more than n bytes, and a hash of the first n bytes of each."""
        at = np.flatnonzero(self.end - self.start > n)
        out = np.full(len(at), n, np.uint64)
        for j in range(n):
            out = out * _R + self.bytes[self.start[at] + j]
        return at, mix64(out)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def joined(self, i: int, n: int) -> bytes:
        """n words from word i on, one space between them."""
        return b" ".join(self.bytes[s:e].tobytes() for s, e in zip(self.start[i : i + n], self.end[i : i + n]))


def by_hash(rows: DataFrame, column: str, n: int) -> DataFrame:
    """At most n different rows, those with the smallest hash of a column. The n-th smallest of the different hashes, which are sorted
    alone, bounds what is sent: at least n different rows have a hash up to it, so rows beyond can't be among them, however often rows repeat."""
    hashed = rows.withColumn("_hash", F.pmod(F.xxhash64(column), F.lit(1 << 40)))
    last = hashed.select("_hash").distinct().orderBy("_hash").limit(n).agg(F.max("_hash")).first()[0]
    return hashed.where(F.col("_hash") <= F.lit(-1 if last is None else last)).distinct().orderBy("_hash", column).limit(n).drop("_hash")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def environment_path(name: str) -> str:
    """Place of a public vocabulary file; the file is read where it lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def here(*parts: str) -> str:
    return os.path.join(os.path.dirname(__file__), *parts)
