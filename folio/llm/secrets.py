"""Secret scan with DataFrame functions only.

Base kinds are regular expressions; a kind's matches and the gaps between them (a split by the same expression) have the
lengths from which offsets follow. The `entropy` kind adds candidate strings, long runs of key characters with a digit,
whose Shannon entropy in some sliding window reaches the threshold of their character class; a window's entropy comes from
counts that each step changes in two places, for the character that comes in and the one that goes out. A threshold is near the
second percentile of random strings of 24 characters of its class, so nearly all of these are found, longer ones more surely.
Strings of the allow list, and candidates that overlap a base span, are left out.

Cases: null text is the empty text (no spans; the digest of an empty string); matches of a kind don't overlap, those of
different kinds may; order is by start, then kind; repeated rows give repeated rows; an empty table gives an empty table;
spans() only reads doc_id and text, redact() changes text (and n_chars, if there) and keeps all other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import table

# The base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{24,}"
WINDOW = 20
#: Class, its pattern (after a short prefix of letters, as access tokens have it), bits that a window must reach; the first class
#: that fits a candidate counts.
PREFIX = "^(?:[A-Za-z]{2,10}[_-])?"
CLASSES = (("hex", PREFIX + "(?:[0-9a-f]+|[0-9A-F]+)$", 3.05), ("mixed hex", PREFIX + "[0-9a-fA-F]+$", 3.2), ("base32", PREFIX + "[A-Z2-7]+=*$", 3.5), ("key", "^[A-Za-z0-9+/_=-]+$", 3.75))
#: Never secrets: UUIDs, dates and numbers, words and short numbers with marks between them, words joined without marks, runs of one
#: character.
PART = "(?:(?:[A-Z]?[a-z]++|[A-Z]++)[0-9]{0,4}+|[0-9]{1,8}+)"
ALLOWED = (
    r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$", r"^[0-9_/=+-]+$", f"^{PART}{{1,2}}(?:[/_=+-]++{PART}{{1,2}})++$", r"^(?:[A-Z][a-z]++|[a-z]{2,}+|[/_=+-]++)++[0-9]{0,4}$", r"^(.)\1+$",
)
SPAN = "array<struct<start:int,rank:int,end:int>>"


def _places(text: Column, pattern: str, rank: int, value: Column | None = None, least: int = 0) -> Column:
    """Spans of the pattern's matches; with value, an array beside the matches, only those whose value is long enough."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    data = F.arrays_zip(F.transform(F.split(text, pattern, -1), lambda g: F.length(g)).alias("gap"), F.transform(found, lambda m: F.length(m)).alias("len"), (F.transform(value, lambda v: F.length(v)) if value is not None else F.transform(found, lambda m: F.length(m))).alias("size"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["len"], F.lit(0))
        here = F.when(x["len"].isNotNull() & (x["size"] >= least), F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))).otherwise(F.array().cast(SPAN))
        return F.struct(end.alias("at"), F.concat(acc["out"], here).alias("out"))

    return F.aggregate(data, start, step, lambda acc: acc["out"])


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, in order. Cheap tests keep the expressions away from texts that can't match."""
    low = F.lower(text)
    none = F.array().cast(SPAN)
    keyed = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api_key") | low.contains("apikey")
    assign = F.when(keyed, _places(text, ASSIGN, 0, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), 8)).otherwise(none)
    access = F.when(text.contains("AKIA"), _places(text, ACCESS, 1, None, 16)).otherwise(none)
    hexes = F.when(text.rlike(HEX), _places(text, HEX, 2)).otherwise(none)
    return F.array_sort(F.concat(assign, access, hexes))


def top_entropy(s: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of a window of s. The counts of the window's characters are the code points of a
    128-character string; each step overwrites two of them, and updates the sum of n log n by the two terms that change."""
    nlogn = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))
    codes = F.transform(F.split(s, ""), lambda c: F.ascii(c) % 128)
    zero = F.struct(F.repeat(F.lit("0"), 128).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"), F.lit(0).alias("i"))
    read = lambda counts, code: F.ascii(F.substring(counts, code + 1, F.lit(1))) - ord("0")
    put = lambda counts, code, n: F.overlay(counts, F.char(n + ord("0")), code + 1, F.lit(1))

    def come(acc: Column, code: Column) -> Column:
        n = read(acc["counts"], code)
        return F.struct(put(acc["counts"], code, n + 1).alias("counts"), (acc["sum"] + nlogn(n + 1) - nlogn(n)).alias("sum"))

    def go(acc: Column, code: Column) -> Column:
        n = read(acc["counts"], code)
        return F.struct(put(acc["counts"], code, n - 1).alias("counts"), (acc["sum"] + nlogn(n - 1) - nlogn(n)).alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        # one element at a time: the character that comes, then the one that goes
        whole = F.get(F.transform(F.array(come(acc, x["come"])), lambda c: F.when(x["go"].isNotNull(), go(c, F.coalesce(x["go"], F.lit(0)))).otherwise(c)), F.lit(0))
        full = acc["i"] + 1 >= window
        return F.get(F.transform(F.array(whole), lambda c: F.struct(c["counts"].alias("counts"), c["sum"].alias("sum"), F.when(full, F.greatest(acc["best"], F.log2(F.lit(window)) - c["sum"] / window)).otherwise(acc["best"]).alias("best"), (acc["i"] + 1).alias("i"))), F.lit(0))

    late = F.concat(F.array_repeat(F.lit(None).cast("int"), window), codes)
    pairs = F.slice(F.arrays_zip(codes.alias("come"), late.alias("go")), F.lit(1), F.size(codes))
    return F.aggregate(pairs, zero, step, lambda acc: acc["best"])


def entropy_spans(text: Column, base: Column) -> Column:
    """Spans of high-entropy candidates that overlap none of the base spans."""

    def telling(s: Column) -> Column:
        allowed = F.lit(False)
        for pattern in ALLOWED:
            allowed = allowed | s.rlike(pattern)
        need = F.lit(99.0)
        for _, pattern, bits in reversed(CLASSES):
            need = F.when(s.rlike(pattern), F.lit(bits)).otherwise(need)
        return F.when(allowed, F.lit(False)).otherwise(top_entropy(s) >= need)

    spots = _places(text, CANDIDATE, 3)
    judged = F.filter(spots, lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    judged = F.filter(judged, lambda x: telling(F.substring(text, x["start"] + 1, x["end"] - x["start"])))
    return F.when(text.rlike(CANDIDATE), judged).otherwise(F.array().cast(SPAN))


def _joined(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kind, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def with_spans(docs: DataFrame, text: Column, base: str, every: str) -> DataFrame:
    """docs with the base spans and all spans in two columns of these names."""
    return docs.withColumn(base, base_spans(text)).withColumn(every, F.array_sort(F.concat(base, entropy_spans(text, F.col(base)))))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts of each kind, the digest of the base spans, all spans."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    count = lambda rank: F.size(F.filter("every", lambda x: x["rank"] == rank)).cast("long")
    return with_spans(rows, F.col("text"), "base", "every").select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("every")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span (those that overlap as one) replaced by the mark; texts without spans, and nulls, stay. Columns of any
    other names stay as they are."""
    text = F.col("text")
    base, every = (next(n for i in range(len(docs.columns) + 1) if (n := f"{name}_{i}") not in docs.columns) for name in ("_base", "_every"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(every, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    hit = F.size(every) > 0
    found = with_spans(docs, text, base, every).withColumn("text", F.when(hit, clean).otherwise(text))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"))
