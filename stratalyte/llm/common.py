"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space between words: the space and bytes 9 to 13.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    conf = spark.sparkContext.getConf()
    if not (top := conf.get("spark.checkpoint.dir", None)):
        top = getattr(spark, "_stratalyte_dir", None) or f"file://{tempfile.mkdtemp(prefix='stratalyte-')}"
        spark._stratalyte_dir = top
    return f"{top.rstrip('/')}/stratalyte"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of small Arrow batches. An executor holds a batch several times outside its heap, and a Python worker two of them; Spark's own limits are 10,000 rows and 64 MB.
SMALL_BATCH = 4 << 20


def materialise(df: DataFrame, name: str, *, small: bool = False) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back: later plans start from the files, which outlive executors. Its shuffle files go as soon as it is written. small: its Python steps get small batches."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {_CLEANUP: spark.conf.get(_CLEANUP, "false")} | ({_BATCH: spark.conf.get(_BATCH)} if small else {})
    spark.conf.set(_CLEANUP, "true")
    if small:
        spark.conf.set(_BATCH, str(SMALL_BATCH))
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._stratalyte_path = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete the files of frames that `materialise` gave, once all that is read from them has been written."""
    for df in written:
        if path := getattr(df, "_stratalyte_path", None):
            jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context.hadoopConfiguration()).delete(folder, True)


def release() -> None:
    """Give memory that is free back to the system: Python workers outlive their tasks, and keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that releases memory when its task ends."""

    @functools.wraps(of)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from of(batches)
        finally:
            release()

    return tidied


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, for functions that make many values of a row."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (0 for a null id)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n, F.lit(0))


def words(text: str | None) -> list[bytes]:
    """Words of the whole text, A-Z lower-cased; bytes.split() splits at exactly the bytes of SPACES."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length n, one after another."""
    if not len(lengths) or not (total := int(lengths.sum())):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) - np.repeat(ends - lengths, lengths)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or with underscores before it until `df` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
