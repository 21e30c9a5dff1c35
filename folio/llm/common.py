"""What several operators here share: the shared folder, size-checked broadcasts, text folding tables."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: Bytes that a broadcast table may take in each executor, by its counted rows and its columns' widths.
BROADCAST_BYTES = 48 << 20

def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's spark.checkpoint.dir. A folder of our own is only made on a local master."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark, "_folio_shared", None) or tempfile.mkdtemp(prefix="folio-")
        spark._folio_shared = base
    return f"{base.rstrip('/')}/folio/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy() -> None:
    """Gives a Python worker's freed memory back to the system. Workers outlive their tasks, and what one operator leaves in
    them would add to the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows, for jobs that run inside: whole texts make batches large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def forget(*tables: DataFrame) -> None:
    """Deletes the files of tables that written() made, once nothing will read them again."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def small(df: DataFrame, rows: int, width: int = 0) -> DataFrame:
    """df with a broadcast hint if its counted rows fit BROADCAST_BYTES, else as it is (a shuffled join). For tables that don't grow
    with the documents, or hardly. A row of a hashed relation takes about 40 bytes and its columns (texts count as 64 bytes),
    or the given width."""
    width = width or 40 + sum(64 if isinstance(f.dataType, (StringType, BinaryType)) else 16 for f in df.schema.fields)
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


def large(df: DataFrame) -> DataFrame:
    """df, to be joined by a shuffle at every size: a table that grows with the documents is never broadcast, so that a job moves
    as much of a small input as of a large one."""
    return df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_id(docs: DataFrame) -> F.Column:
    """doc_id as a long; for a row without one a number from its text, at least 2 ** 62, which is above all doc_ids."""
    return F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(docs["text"].cast("string")).bitwiseAND((1 << 61) - 1) + (1 << 62))


def remainder(col: str, of: int) -> F.Column:
    """crc32 of an id as text, modulo `of`: the fixed folds of the learned operators."""
    return F.crc32(F.col(col).cast("string")) % of


@lru_cache(1)
def letters() -> np.ndarray:
    """For every code point: its simple lower-case code point if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, a NUL after each; and where each text starts (one more entry than texts)."""
    joined = "\0".join(texts) + "\0"
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), at


def chunks(texts: list[str], chars: int = 2_000_000):
    """(start, end) ranges of consecutive texts of about so many characters in all; one long text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
