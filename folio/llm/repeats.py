"""Substring dedup: words covered by a window of WINDOW consecutive words that also starts in a document of smaller doc_id.

Rabin-Karp hashes of every window are compared through counts in Spark, at three grains, each exact for what it settles:

- documents of one word sequence (told by its SHA-256) are one class; only its smallest doc_id posts anything, and all words of
  the others are covered if there is one window at all;
- runs: a window's mark is the smallest Rabin-Karp hash of the GRAM-word grams in it, so equal windows have equal marks. The
  consecutive windows of one mark are a run (about 17 of them), told by the hash of all its words. Marks are counted first;
  windows whose mark is in one document only are in one document only. Of equal runs only the first document's is left;
- windows: the runs that are left and share their mark with another run post the Rabin-Karp hash of each of their windows.

A window is told by its mark and its own hash together, a run by its mark and its hash: 128 bits. Covered words merge into
maximal intervals, which are cut out of the whole text.

Distribution: texts never meet each other. Per word 2 to 3 bytes of marks are shuffled, twice; windows only where different
runs meet. Counts are summed before they are shuffled, and every way back from counts to documents is a join that Spark may
split, so a passage in a third of all documents loads no single task. Texts are read three times; tables that go back to them
(areas to look at, intervals to cut) are joined by document, so texts are shuffled twice; nothing that grows with the documents
is broadcast.

Cases: null, empty and wordless texts have no words and keep the empty text; fewer than WINDOW words have no window; a window
that is repeated in its own document only stays; rows of one doc_id never remove each other's words, whether their texts are
equal (repeated rows, judged alike) or differ; rows without a doc_id come after all doc_ids (which must be under 2 ** 62), in an
order of their texts; very long words and texts are read whole; an empty table gives an empty table; only doc_id and text are
read, and `without_repeats` keeps all other columns, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import arrow_rows, forget, large, own_id, table, tidy, written
from folio.llm.jaccard import BYTES, MULT, mix, powers

WINDOW, GRAM = 50, 16
#: Bytes of text that are hashed together, and bytes of a word beyond which it has a hash of its own.
TOGETHER, WORD = 1 << 20, 4096
SPANS = "array<struct<start:int,end:int>>"
LEVEL = np.cumprod(np.full(WORD, 0xD1342543DE82EF95, np.uint64))


def normal(text: bytes | None) -> bytes:
    """The words of a text, joined by one space."""
    return b" ".join((text or b"").split())


def named(text: bytes) -> tuple[int, str]:
    """Two names of a normal text: 64 bits, and its SHA-256."""
    digest = hashlib.sha256(text)
    return int.from_bytes(digest.digest()[:8], "big", signed=True), digest.hexdigest()


def word_hashes(normals: list[bytes]) -> np.ndarray:
    """The hash of each word of normal texts, one after the other."""
    data = b" ".join(filter(None, normals)) + b" "
    if len(data) == 1:
        return np.zeros(0, np.uint64)
    out, at = [], 0
    while at < len(data):
        end = data.find(b" ", min(at + TOGETHER, len(data) - 1)) + 1
        a = np.frombuffer(data, np.uint8, end - at, at)
        ends = np.flatnonzero(a == 32)
        starts = np.concatenate(([0], ends[:-1] + 1))
        size = ends - starts
        place = np.arange(len(a)) - np.repeat(starts, size + 1)
        h = np.add.reduceat(BYTES[a] * LEVEL[place & (WORD - 1)], starts)
        for i in np.flatnonzero(size > WORD).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(a[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
        out.append(mix(h + size.astype(np.uint64) * MULT))
        at = end
    return np.concatenate(out)


def summed(words: np.ndarray) -> np.ndarray:
    """Prefix sums of the Rabin-Karp polynomial of word hashes."""
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(len(words) + 1)[0][: len(words)], out=total[1:])
    return total


def between(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The Rabin-Karp hashes of words start to end."""
    return mix((total[end] - total[start]) * powers(len(total))[1][start] + (end - start).astype(np.uint64) * MULT)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` consecutive values, by running minima to both sides of every width-th value."""
    n = len(x) - width + 1
    blocks = np.concatenate((x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(normals: list[bytes], counts: list[int], window: int) -> tuple[np.ndarray, ...]:
    """The runs of texts: text, mark, hash, first window, number of windows. counts: words of each text."""
    none = np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    if not len(ends) or ends[-1] < window:
        return none, none, none, none, none
    gram, n = min(GRAM, window), int(ends[-1])
    total = summed(word_hashes(normals))
    at = np.arange(n - gram + 1)
    mark = sliding_min(between(total, at, at + gram), window - gram + 1)
    text = np.repeat(np.arange(len(counts)), counts)[: len(mark)]
    valid = np.arange(len(mark)) + window <= ends[text]
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (mark[1:] != mark[:-1])
    lo = np.flatnonzero(first)
    if not len(lo):
        return none, none, none, none, none
    size = np.bincount(np.cumsum(first)[valid] - 1, minlength=len(lo))
    return text[lo], mark[lo].view(np.int64), between(total, lo, lo + size + window - 1).view(np.int64), lo - (ends - counts)[text[lo]], size


def together(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about TOGETHER bytes."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= TOGETHER or i + 1 == len(texts):
            yield start, i + 1
            start, size = i + 1, 0


def _lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def _scan(docs: DataFrame, window: int) -> DataFrame:
    """own, t, n_words, sha of each row, and its runs: mark, run (their hashes), lo, n (first window, windows)."""

    def run(batches):
        for batch in batches:
            texts = [normal(t) for t in batch.column(1).to_pylist()]
            counts = [t.count(b" ") + 1 if t else 0 for t in texts]
            names = [named(t) for t in texts]
            for a, b in together(texts):
                text, *columns = runs(texts[a:b], counts[a:b], window)
                at = np.searchsorted(text, np.arange(b - a + 1))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([t for t, _ in names[a:b]], pa.int64()), pa.array(counts[a:b], pa.int64()), pa.array([s for _, s in names[a:b]]), *(_lists(c, at, k) for c, k in zip(columns, kinds, strict=True))],
                    ["own", "t", "n_words", "sha", "mark", "run", "lo", "n"],
                )
        tidy()

    return docs.mapInArrow(run, "own long, t long, n_words long, sha string, mark array<long>, run array<long>, lo array<int>, n array<int>")


def _windows(asked: DataFrame, window: int) -> DataFrame:
    """own, t, mark, lo and the hashes of all windows of each run of asked (own, text, t, runs)."""

    def run(batches):
        for batch in batches:
            own, t, mark, lo, hashes = [], [], [], [], []
            for i, raw, name, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = normal(raw)
                if named(text)[0] != name:
                    continue  # another text of the same doc_id
                total = summed(word_hashes([text]))
                for r in wanted:
                    at = np.arange(r["lo"], r["lo"] + r["n"])
                    own.append(i)
                    t.append(name)
                    mark.append(r["mark"])
                    lo.append(r["lo"])
                    hashes.append(between(total, at, at + window).view(np.int64))
            at = np.concatenate(([0], np.cumsum([len(h) for h in hashes])))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(t, pa.int64()), pa.array(mark, pa.int64()), pa.array(lo, pa.int32()), _lists(np.concatenate([np.zeros(0, np.int64), *hashes]), at, pa.int64())], ["own", "t", "mark", "lo", "hashes"])
        tidy()

    return asked.mapInArrow(run, "own long, t long, mark long, lo int, hashes array<long>")


def covered(n_words: int, lo: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal intervals of words that windows lo to lo + n - 1 cover."""
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, lo, 1)
    np.add.at(step, lo + n - 1 + window, -1)
    edge = np.diff(np.concatenate(([0], (np.cumsum(step[:-1]) > 0).view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def without(text: bytes, spans: list[dict]) -> bytes:
    """A normal text without the words in spans."""
    words = text.split(b" ")
    for s in reversed(spans):
        del words[s["start"] : s["end"]]
    return b" ".join(words)


def _cut(cuts: DataFrame, window: int) -> DataFrame:
    """own, t, spans, sha of what is left, of cuts (own, text, t, windows)."""

    def run(batches):
        for batch in batches:
            rows = []
            for i, raw, name, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = normal(raw)
                if named(text)[0] == name:
                    lo, n = (np.array([w[k] for w in wanted], np.int64) for k in ("lo", "n"))
                    spans = [{"start": a, "end": b} for a, b in zip(*(x.tolist() for x in covered(text.count(b" ") + 1, lo, n, window)), strict=True)]
                    rows.append((i, name, spans, named(without(text, spans))[1]))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["own", "t", "spans", "sha"])
        tidy()

    return cuts.mapInArrow(run, f"own long, t long, spans {SPANS}, sha string")


def removals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """own (common.own_id), t (64 bits of the word sequence's SHA-256), n_words, spans (maximal intervals of removed words),
    n_removed and kept_sha256 of each row of docs. All Python runs before this returns, on small Arrow batches."""
    with arrow_rows(docs.sparkSession, 256):
        return _removals(docs.select(own_id(docs).alias("own"), F.col("text").cast("string").cast("binary").alias("text")), window)


def _removals(docs: DataFrame, window: int) -> DataFrame:
    rows = written(_scan(docs, window), "runs")
    # one class per word sequence: only its smallest doc_id posts
    long = rows.where(F.col("n_words") >= window)
    repeated = written(long.groupBy("sha").agg(F.min("own").alias("one"), F.max("own").alias("last")).where("one < last").select("sha", "one"), "classes")
    told = rows.join(large(repeated), "sha", "left")
    copied = F.coalesce(F.col("own") > F.col("one"), F.lit(False))
    zipped = lambda df: df.select("own", "t", F.explode(F.arrays_zip("mark", "run", "lo", "n")).alias("r")).select("own", "t", "r.*")
    posts = zipped(told.where(~copied))
    # marks of all documents: those of a class alone lead to runs that meet no other, and to nothing more
    marks = zipped(rows).groupBy("mark").agg(F.min("own").alias("first"), F.max("own").alias("last"), (F.min("run") < F.max("run")).alias("mixed")).where("first < last").select("mark", "mixed")
    marks = written(marks, "marks")
    met = written(posts.join(large(marks), "mark"), "met")
    # written, so that the join after it stands alone and Spark may split its hot keys
    firsts = written(met.groupBy("mark", "run").agg(F.min("own").alias("first")), "first-runs")
    judged = written(met.join(large(firsts), ["mark", "run"]).select("own", "t", "mark", "lo", "n", (F.col("own") > F.col("first")).alias("gone"), "mixed").where("gone or mixed"), "judged")
    forget(marks, met, firsts)
    # windows of runs that share their mark with other runs
    areas = written(judged.where("not gone").groupBy("own", "t").agg(F.collect_list(F.struct("mark", "lo", "n")).alias("wanted")), "areas")
    asked = docs.join(large(areas), "own").select("own", "text", "t", "wanted")
    fine = written(_windows(asked, window), "windows")
    each = fine.select("own", "t", "mark", "lo", F.posexplode("hashes").alias("i", "h"))
    firsts = written(each.groupBy("mark", "h").agg(F.min("own").alias("first"), F.max("own").alias("last")).where("first < last").select("mark", "h", "first"), "first-windows")
    single = each.join(large(firsts), ["mark", "h"]).where("own > first").select("own", "t", (F.col("lo") + F.col("i")).alias("lo"), F.lit(1).alias("n"))
    gone = judged.where("gone").select("own", "t", "lo", "n").unionAll(single)
    cuts = written(gone.groupBy("own", "t").agg(F.collect_list(F.struct("lo", "n")).alias("wanted")), "cuts")
    forget(areas, fine, judged, firsts)
    changed = written(_cut(docs.join(large(cuts), "own").select("own", "text", "t", "wanted"), window), "changed")
    forget(cuts)
    once = changed.dropDuplicates(["own", "t"]).withColumnRenamed("sha", "left_sha")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    spans = F.when(copied, whole).otherwise(F.coalesce("spans", F.array().cast(SPANS)))
    out = told.select("own", "t", "n_words", "sha", "one").join(once, ["own", "t"], "left")
    out = out.select("own", "t", "n_words", spans.alias("spans"), F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("left_sha", "sha")).alias("kept_sha256"))
    return out.withColumn("n_removed", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with their own columns; texts of which words are removed are what is left, joined by one space, others are as
    they were."""
    gone = removals(docs, window).where("n_removed > 0").select(F.col("own").alias("_own"), F.lpad(F.lower(F.hex("t")), 16, "0").alias("_t"), F.col("spans").alias("_spans")).dropDuplicates(["_own", "_t"])
    normalised = F.trim(F.regexp_replace(F.coalesce(docs["text"].cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    rows = docs.join(gone, (own_id(docs) == F.col("_own")) & (F.substring(F.sha2(normalised, 256), 1, 16) == F.col("_t")), "left")
    words = F.split(normalised, " ")
    ends = F.concat(F.array(F.lit(0)), F.transform("_spans", lambda s: s["end"]))
    starts = F.concat(F.transform("_spans", lambda s: s["start"]), F.array(F.size(words)))
    kept = F.flatten(F.zip_with(ends, starts, lambda a, b: F.slice(words, a + 1, b - a)))
    return rows.select(*(F.when(F.col("_spans").isNull(), docs["text"]).otherwise(F.array_join(kept, " ")).alias(c) if c == "text" else docs[c] for c in docs.columns))


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    first = F.when(F.col("own") < F.lit(1 << 62), F.col("own")).alias("doc_id")  # a row without a doc_id gets none
    return removals(docs).select(first, "n_words", "n_removed", "kept_sha256")


ORACLE = {
    "op12_substrings": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
k AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 49 <= len(ws) THEN md5(array_to_string(ws[i:i + 49], ' ')) END AS key FROM w),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE key IS NOT NULL GROUP BY key),
h AS (SELECT k.doc_id, k.i, k.word, coalesce(f.first < k.doc_id, false) AS hit FROM k LEFT JOIN f USING (key)),
r AS (SELECT doc_id, i, word, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM h),
a AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(a.n_removed, 0) AS n_removed, sha256(coalesce(a.kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)"""
}
