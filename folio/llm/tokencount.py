"""Token counts of flat token files, which hold 16-bit ids, an end-of-document id after each document, and no index.

Files are read as bytes and cut into blocks. Each block is searched for the separator in one vectorised comparison and
gives a summary: its length, the tokens before its first and after its last separator, the lengths in between. A prefix
scan over a file's block summaries (two running aggregates) stitches documents that cross block boundaries, whatever
number of blocks they span. Summaries are small, so the scan of a file is too.

Cases: a document without tokens has length 0; tokens after the last separator are a document with `ended` false; an empty
file has no documents; a null text is the empty text; repeated rows are repeated documents; an empty table gives no files
and an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm import bpe
from folio.llm.common import shared_dir, table

EOD = 50256
#: Tokens in a block.
BLOCK = 1 << 20
#: Documents in a file that write() makes, at most.
RECORDS = 1024
SUMMARY = "file string, block long, n long, head long, tail long, seps long, inner array<long>"


def write(docs: DataFrame, path: str, vocab: str, pattern: str, eod: int = EOD, records: int = RECORDS) -> None:
    """Flat token files of every whole text, in the order of the rows. Spark's text sink writes the ids' bytes; its line
    separator is the separator's bytes."""

    def run(batches):
        codec = bpe.load(vocab, pattern)
        for batch in batches:
            for ids in codec.encode_batch([t or "" for t in batch.column(0).to_pylist()]):
                yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(ids, "<u4").astype("<u2").tobytes()], pa.binary())], ["ids"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "ids binary").select(F.col("ids").cast("string").alias("value"))
    sep = int(eod).to_bytes(2, "little").decode("latin-1")
    rows.write.option("encoding", "ISO-8859-1").option("lineSep", sep).option("maxRecordsPerFile", records).text(path)


def summaries(data: bytes, eod: int = EOD, block: int = BLOCK):
    """(block, n, head, tail, seps, inner) of each block of a file; head is n where there is no separator."""
    ids = np.frombuffer(data, "<u2")
    for k, start in enumerate(range(0, len(ids), block)):
        part = ids[start : start + block]
        at = np.flatnonzero(part == eod)
        if len(at):
            yield k, len(part), int(at[0]), len(part) - int(at[-1]) - 1, len(at), np.diff(at) - 1
        else:
            yield k, len(part), len(part), len(part), 0, np.zeros(0, np.int64)


def scan(spark: SparkSession, path: str, eod: int = EOD, block: int = BLOCK) -> DataFrame:
    """shard, ordinal, n_tokens, ended of each document of the files under path."""

    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = list(summaries(data.as_py(), eod, block))
                cols = [pa.array([file] * len(rows), pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(5)), pa.array([r[5] for r in rows], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["file", "block", "n", "head", "tail", "seps", "inner"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    parts = files.mapInArrow(run, SUMMARY)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("block") * block
    # where the document that is open at the block's start began: just after the last separator so far
    last = F.when(F.col("seps") > 0, base + F.col("n") - F.col("tail"))
    parts = parts.withColumns({"began": F.coalesce(F.max(last).over(before), F.lit(0)), "done": F.coalesce(F.sum("seps").over(before), F.lit(0)), "next": F.lead("block").over(Window.partitionBy("file").orderBy("block"))})
    first = F.struct((base + F.col("head") - F.col("began")).alias("n_tokens"), F.lit(True).alias("ended"))
    rest = F.transform("inner", lambda x: F.struct(x.alias("n_tokens"), F.lit(True).alias("ended")))
    begun = F.when(F.col("seps") > 0, base + F.col("n") - F.col("tail")).otherwise(F.col("began"))
    open_ = F.when(F.col("next").isNull() & (base + F.col("n") > begun), F.array(F.struct((base + F.col("n") - begun).alias("n_tokens"), F.lit(False).alias("ended"))))
    none = F.array().cast("array<struct<n_tokens:bigint,ended:boolean>>")
    found = F.concat(F.when(F.col("seps") > 0, F.concat(F.array(first), rest)).otherwise(none), F.coalesce(open_, none))
    shard = F.regexp_replace(F.regexp_extract("file", r"([^/]+)$", 1), r"^part-(\d+)-.*?(c\d+)\..*$", "$1-$2")
    return parts.select(shard.alias("shard"), "done", F.posexplode(found).alias("i", "d")).select("shard", (F.col("done") + F.col("i")).alias("ordinal"), F.col("d.n_tokens").alias("n_tokens"), F.col("d.ended").alias("ended"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "tokens")
    write(table(spark, sf_dir, "documents"), path, *bpe.vocabulary())
    return scan(spark, path)
