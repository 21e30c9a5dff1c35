"""Benchmark decontamination with DataFrame functions only.

Words are runs of ASCII letters and digits and of all other characters outside ASCII, ASCII letters in lower case. A window
is 13 words of an item in a row, or all of a shorter item. A document holds a window of w words only if one of its own
blocks of (w + 1) / 2 words, cut at multiples of that length, lies inside; so just the blocks' hashes are looked up in a
hash set of the items' word n-grams. The set is a bit table of LEAST to MOST words of 64 bits, BITS of them for each n-gram
(fewer beyond MOST), which goes with the tasks; what it lets through by chance costs time only. Around blocks found there,
whole windows are compared word by word with the items' windows by a join, so results are exact, and only those windows are
shuffled where the items' are too many to be broadcast. The plan is the same at every size.

Items that share a window don't multiply it: a window is joined once and names the set of its items, and the sets of a
document's windows are put together at the end.

Cases: null text has no words; a text without words is never contaminated; a word in several windows is hit once; items
repeated with one item_id count once; items without an item_id hit words, count as one item and aren't listed; repeated rows
give repeated rows; without items or documents the result has no hits or no rows; of docs doc_id and text are read,
decontaminate() keeps all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import own_id, small, table, written

WINDOW = 13
#: Bits of the hash set for an n-gram, and its least and largest size in 64-bit words (16 MB).
BITS, LEAST, MOST = 16, 64, 1 << 21
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HITS = "array<struct<at:int,end:int>>"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def gram(ws: Column, at: Column, n: int | Column) -> Column:
    return F.translate(F.array_join(F.slice(ws, at + 1, n), " "), UPPER, LOWER)


def block_hash(ws: Column, at: Column, n: int | Column, w: int | Column) -> Column:
    """Of a block of n words for windows of w. Lower case by all of Unicode here: it never parts what ASCII lower case makes
    equal."""
    return F.xxhash64(F.lower(F.array_join(F.slice(ws, at + 1, n), " ")), w)


def item_windows(bench: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """w, win, items (the name of its set of items) of every window; and items, ids (sorted, as text), anonymous of the sets."""
    items = bench.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text").cast("string")).alias("ws")).where(F.size("ws") > 0)
    items = items.withColumn("w", F.least(F.size("ws"), F.lit(window)))
    at = F.explode(F.sequence(F.lit(0), F.size("ws") - F.col("w")))
    wins = items.select("item_id", "w", "ws", at.alias("at")).select("item_id", "w", gram(F.col("ws"), F.col("at"), F.col("w")).alias("win"))
    sets = wins.groupBy("w", "win").agg(F.array_sort(F.collect_set("item_id")).alias("ids"), F.bool_or(F.col("item_id").isNull()).alias("anonymous"))
    named = written(sets.withColumn("items", F.sha1(F.to_json(F.struct("ids", "anonymous")))), "windows")
    return named.select("w", "win", "items"), named.select("items", "ids", "anonymous").dropDuplicates(["items"])


def bit_table(hashes: DataFrame) -> DataFrame:
    """One row: the hash set of column h as an array of 64-bit words. A hash sets three bits of one word."""
    n = hashes.count()
    size = min(MOST, max(LEAST, 1 << max(0, n * BITS // 64 - 1).bit_length()))
    filled = hashes.groupBy(F.pmod("h", F.lit(size)).alias("id")).agg(F.bit_or(bits_of(F.col("h"))).alias("bits"))
    dense = hashes.sparkSession.range(size).join(filled, "id", "left").select("id", F.coalesce("bits", F.lit(0)).cast("long").alias("bits"))
    return dense.agg(F.sort_array(F.collect_list(F.struct("id", "bits"))).alias("x")).select(F.col("x.bits").alias("bits"))


def bits_of(h: Column) -> Column:
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, k).bitwiseAND(63).cast("int"))
    return bit(40).bitwiseOR(bit(46)).bitwiseOR(bit(52))


def candidates(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """row, doc_id, n (words), at, w, win: the windows of each document that may be an item's; at least one row per document."""
    spans = docs.select(F.col("doc_id").cast("long"), words(F.col("text").cast("string")).alias("ws"))
    spans = spans.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("ws").alias("n"), "ws")
    # windows have at most `window` lengths
    lengths = sorted(r["w"] for r in wins.select("w").distinct().collect())
    half = lambda w: F.floor((w + 1) / 2).cast("int")
    parts = wins.select("w", F.split("win", " ").alias("ws")).select("w", "ws", F.explode(F.sequence(F.lit(0), F.col("w") - half(F.col("w")))).alias("at"))
    hashes = parts.select(block_hash(F.col("ws"), F.col("at"), half(F.col("w")), F.col("w")).alias("h")).distinct()
    ws, n = F.col("ws"), F.col("n")
    kind = "array<struct<i:int,w:int,h:bigint>>"

    def blocks(w: int) -> Column:
        b = (w + 1) // 2
        own = F.transform(F.sequence(F.lit(0), n - b, F.lit(b)), lambda i: F.struct(i.alias("i"), F.lit(w).alias("w"), block_hash(ws, i, b, F.lit(w)).alias("h")))
        return F.when(n >= w, own).otherwise(F.array().cast(kind))

    def around(x: Column) -> Column:
        """The windows that hold block x."""
        first, last = F.greatest(x["i"] - F.floor(x["w"] / 2).cast("int"), F.lit(0)), F.least(x["i"], n - x["w"])
        starts = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.struct(x["w"].alias("w"), s.alias("at")))

    every = F.concat(F.array().cast(kind), *map(blocks, lengths))
    size, table_ = F.lit(1), None
    if lengths:
        table_ = bit_table(hashes)
        size = table_.select(F.size("bits")).collect()[0][0]
    # the set is named once, so that it stays in the filter and doesn't become a column of every row
    test = lambda x: F.get("set", F.pmod(x["h"], F.lit(size)).cast("int"))
    marked = F.filter(every, lambda x: test(x).bitwiseAND(bits_of(x["h"])) == bits_of(x["h"]))
    found = spans.withColumn("set", table_.scalar()).select("row", "doc_id", "n", "ws", marked.alias("found")) if lengths else spans.select("row", "doc_id", "n", "ws", F.array().cast(kind).alias("found"))
    starts = F.array_distinct(F.flatten(F.transform("found", around)))
    near = found.select("row", "doc_id", "n", "ws", F.explode_outer(starts).alias("x"))
    return near.select("row", "doc_id", "n", F.col("x.at").alias("at"), F.col("x.w").alias("w"), F.when(F.col("x.at").isNotNull(), gram(ws, F.col("x.at"), F.col("x.w"))).alias("win"))


def union(hits: Column) -> Column:
    """Sorted spans (at, end), those that overlap or touch as one."""

    def step(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joins = (F.size(acc) > 0) & (x["at"] <= last["end"])
        merged = F.struct(last["at"].alias("at"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(hits, F.array().cast(HITS), step)


def scan(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items (sorted, comma-joined), spans (array of start, end
    of hit words), contaminated."""
    wins, sets = item_windows(bench, window)
    exact = candidates(docs, wins).join(small(wins, wins.count()), ["w", "win"], "left")
    hit = F.when(F.col("items").isNotNull(), F.struct("at", (F.col("at") + F.col("w")).alias("end")))
    grouped = written(exact.groupBy("row", "doc_id", "n").agg(F.array_sort(F.collect_set(hit)).alias("hits"), F.collect_set("items").alias("sets")), "hits")
    listed = grouped.where(F.size("sets") > 0).select("row", F.explode("sets").alias("items")).join(small(sets, sets.count()), "items")
    listed = listed.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"), F.bool_or("anonymous").cast("int").alias("anonymous"))
    out = grouped.join(listed, "row", "left").withColumn("spans", union(F.col("hits")))
    n_hit = F.aggregate("spans", F.lit(0), lambda acc, x: acc + x["end"] - x["at"])
    n_items = F.coalesce(F.size("ids") + F.col("anonymous"), F.lit(0))
    out = out.select("doc_id", F.col("n").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"), n_items.cast("long").alias("n_items"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("items"), "spans")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def decontaminate(docs: DataFrame, bench: DataFrame, mode: str = "documents") -> DataFrame:
    """docs without contaminated documents, or (mode "spans") with the words of hit windows cut out of their texts.

    A doc_id with several rows goes if one of them is contaminated; in mode "spans" doc_id must name one row, or equal ones.
    Rows without a doc_id are told apart by their texts.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(mode)
    own = own_id(docs)
    found = scan(docs.select(own.alias("doc_id"), "text"), bench).withColumnRenamed("doc_id", "_own")
    if mode == "documents":
        bad = written(found.where("contaminated").select("_own").distinct(), "contaminated")
        return docs.join(small(bad, bad.count()), own == F.col("_own"), "left_anti").select(*docs.columns)
    spans = found.where("n_hit > 0").dropDuplicates(["_own"]).select("_own", F.col("spans").alias("_hit_spans"))
    gaps, ws = F.split(docs["text"], WORD, -1), words(docs["text"])
    kept = F.transform(ws, lambda w, i: F.concat(F.get(gaps, i), F.when(F.exists("_hit_spans", lambda s: (s["at"] <= i) & (i < s["end"])), F.lit("")).otherwise(w)))
    cut = F.concat(F.array_join(kept, ""), F.get(gaps, F.size(ws)))
    text = F.when(F.col("_hit_spans").isNotNull(), cut).otherwise(docs["text"])
    return docs.join(spans, own == F.col("_own"), "left").select(*(text.alias("text") if c == "text" else docs[c] for c in docs.columns))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated")


ORACLE = {
    "op10_decontaminate": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
i AS (
  SELECT DISTINCT item_id, w, array_to_string(ws[s:s + w - 1], ' ') AS win
  FROM (SELECT item_id, ws, w, unnest(range(1, len(ws) - w + 2)) AS s FROM (SELECT *, least(len(ws), 13) AS w FROM b WHERE len(ws) > 0))),
p AS (
  SELECT doc_id, w, s, array_to_string(ws[s:s + w - 1], ' ') AS win
  FROM (SELECT doc_id, ws, w, unnest(range(1, len(ws) - w + 2)) AS s FROM d, (SELECT DISTINCT w FROM i) WHERE len(ws) >= w)),
h AS (SELECT DISTINCT p.doc_id, p.w, p.s, i.item_id FROM p JOIN i ON p.win = i.win AND p.w = i.w),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + w)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""
}
