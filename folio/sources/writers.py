"""Writers: replacing documents of an index, one report per key, run files that never overwrite, spliced blocks, harvested labels.

A table is a folder of bucket folders and a log of commits, files named by growing numbers that are created exclusively. A commit
names the folder of each bucket, so a change writes only the buckets that it touches, readers see the rows of one commit or the
next and never a mixture, and of two writers that start from one commit the second fails instead of losing the first's rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.relational import latest

BUCKETS = 64


class ConflictingCommit(RuntimeError):
    """Another writer committed to the table first."""


def _filesystem(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    where, fs = _filesystem(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def head(spark: SparkSession, base: str) -> tuple[int, dict[str, str]]:
    """The last commit's number (0 if there is none) and its bucket folders."""
    commits = [n for n in _names(spark, f"{base}/_commits") if n.isdecimal()]
    if not commits:
        return 0, {}
    return int(commits[-1]), json.loads(spark.read.text(f"{base}/_commits/{commits[-1]}", wholetext=True).first()[0])


def commit(spark: SparkSession, base: str, after: int, folders: dict[str, str]) -> None:
    """The commit that follows number `after`."""
    where, fs = _filesystem(spark, f"{base}/_commits/{after + 1:012d}")
    try:
        stream = fs.create(where, False)
    except Exception as e:
        if "exist" in str(e).lower():
            raise ConflictingCommit(f"commit {after + 1} of {base} is taken") from e
        raise
    stream.write(bytearray(json.dumps(folders, sort_keys=True).encode()))
    stream.close()


def current(spark: SparkSession, base: str) -> DataFrame | None:
    """The rows that the table at base holds, null if it has none yet."""
    _, folders = head(spark, base)
    return spark.read.option("mergeSchema", "true").parquet(*(f"{base}/{f}" for _, f in sorted(folders.items()))) if folders else None


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _changed(new: DataFrame, base: str, key: str, merged) -> None:
    """A commit in which the touched buckets hold merged(new, their old rows or null)."""
    spark = new.sparkSession
    number, folders = head(spark, base)
    touched = {str(r["b"]) for r in new.select(bucket_of(key).alias("b")).distinct().collect()}
    held = [f"{base}/{folders[b]}" for b in sorted(touched & folders.keys())]
    rows = merged(new, spark.read.option("mergeSchema", "true").parquet(*held) if held else None)
    version = f"v-{uuid.uuid4().hex}"
    rows.withColumn("_bucket", bucket_of(key)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{base}/{version}")
    made = {n.split("=")[1]: f"{version}/{n}" for n in _names(spark, f"{base}/{version}") if n.startswith("_bucket=")}
    commit(spark, base, number, {b: f for b, f in folders.items() if b not in touched} | made)


def replace_documents(new: DataFrame, base: str, key: str = "document_id") -> None:
    """All rows of new's documents replaced by new's; rows of other documents stay."""
    _changed(new, base, key, lambda n, old: n if old is None else old.join(n.select(key).distinct(), key, "left_anti").unionByName(n, allowMissingColumns=True))


def upsert(new: DataFrame, base: str, key: str, at: str) -> None:
    """One row per key: the latest by at, those of new before stored ones of the same time."""

    def merged(n: DataFrame, old: DataFrame | None) -> DataFrame:
        rows = n.withColumn("_new", F.lit(1))
        if old is not None:
            rows = rows.unionByName(old.withColumn("_new", F.lit(0)), allowMissingColumns=True)
        return latest(rows, [key], [F.desc(at), F.desc("_new")]).drop("_new")

    _changed(new, base, key, merged)


def vacuum(spark: SparkSession, base: str) -> list[str]:
    """Deletes the versions that the last commit doesn't name, and the commits before it; no reader may still be at those."""
    number, folders = head(spark, base)
    held = {f.split("/")[0] for f in folders.values()}
    gone = [n for n in _names(spark, base) if n.startswith("v-") and n not in held] + [f"_commits/{n}" for n in _names(spark, f"{base}/_commits") if n.isdecimal() and int(n) < number]
    for name in gone:
        where, fs = _filesystem(spark, f"{base}/{name}")
        fs.delete(where, True)
    return gone


def harvest(labels: DataFrame, rules: dict[str, Column], folder: str, key: str = "doc_id") -> DataFrame:
    """Writes the labels that pass every rule to a new folder of files by `status`, none that doesn't; returns key, broken (the names
    of the rules it breaks, sorted) of those left out. A rule that is unknown is broken."""
    broken = F.array_sort(F.array_compact(F.array(*(F.when(~F.coalesce(test, F.lit(False)), name) for name, test in sorted(rules.items())))))
    judged = labels.withColumn("_broken", broken)
    judged.where(F.size("_broken") == 0).drop("_broken").write.mode("errorifexists").partitionBy("status").json(folder)
    return judged.where(F.size("_broken") > 0).select(key, F.col("_broken").alias("broken"))


def write_once(spark: SparkSession, text: str, folder: str, name: str, suffix: str = ".json") -> str:
    """A small file under the first free of name, name-2, name-3 ...; an existing file is never overwritten."""
    n = 1
    while True:
        path = f"{folder}/{name}{'' if n == 1 else f'-{n}'}{suffix}"
        where, fs = _filesystem(spark, path)
        if not fs.exists(where):
            stream = fs.create(where, False)
            stream.write(bytearray(text.encode()))
            stream.close()
            return path
        n += 1


def spliced(page: str, block: str, start: str, end: str) -> str:
    """page with what stands between two markers replaced; missing, repeated or misordered markers are an error."""
    if page.count(start) != 1 or page.count(end) != 1 or page.index(start) > page.index(end):
        raise ValueError(f"{start} and {end} must each stand once, in this order")
    head, rest = page.split(start)
    return f"{head}{start}\n{block.strip()}\n{end}{rest.split(end)[1]}"


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small table as Markdown; more rows than most is an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(df.columns), line(["-"] * len(df.columns)), *map(line, rows)])
