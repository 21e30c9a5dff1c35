"""Spelling variants: words that differ by one inserted, deleted or replaced code point, grouped under their commonest form.

A word is a vector of letter counts. One replaced letter moves it by an L1 distance of two, one inserted or deleted letter by
one, so the near words of a word lie within that distance in the k-d trees of its own length, and of the lengths one more and
one less. A search leaves out every box (smallest and largest count of each letter under a node) that is farther away; what
the leaves yield at the exact distance is verified on the order of the letters.

Distribution: counting sums each task's words before it shuffles them. A length with more words than a task should hold is cut
into cells by the upper part of its tree, which is fitted on a bounded sample (SAMPLE words of that length, by hash) and sent
with the tasks; every word is a point of exactly one cell, and asks in every cell within its distance. Cells that still
hold more (words of the same letters can't be cut) are dealt into slices of points and of questions, and each slice of
points meets each slice of questions, so no task holds more than about CELL of either and no pair is met twice. Only the number
of near words and the best of them leave a task, never the pairs. Forms are followed to the last by pointer doubling: a form has at least
twice the count of its word, so chains are no longer than the logarithm of the largest count, and few rounds do.

Cases: null texts and texts without letters have no words; a null doc_id counts as the empty text in the checksum that decides
about dropped letters; runs of any length are words; two documents of one doc_id are two documents; repeated rows count
again; ties of count go to the word that is smaller in code-point order; an empty table gives an empty table; only doc_id and
text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import arrow_rows, forget, small, table, tidy, written

LEAST_LENGTH, LEAST_COUNT = 5, 3
RUN = re.compile("[a-zÀ-ÿ]{5,}")
#: One in so many (document, word) pairs loses a letter.
DROPS = 97
#: Points or questions of a cell, and bytes of their letters and counts; words of a length that its upper tree is fitted on.
CELL, CELL_BYTES, SAMPLE = 40_000, 1 << 25, 20_000
LEAF = 24
LETTERS = 26 + 64
#: Distinct words that a task gathers before it sends them on.
HELD = 200_000


def counted(docs: DataFrame) -> DataFrame:
    """word, n: all words of at least LEAST_LENGTH code points and LEAST_COUNT occurrences, letters dropped."""

    def run(batches):
        total: Counter[str] = Counter()
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                before = zlib.crc32(f"{'' if name is None else name}:".encode())
                for word, n in Counter(RUN.findall((raw or b"").lower().decode("utf-8", "replace"))).items():
                    h = zlib.crc32(word.encode(), before)
                    if h % DROPS == 0:
                        word = word[: h % len(word)] + word[h % len(word) + 1 :]
                        if len(word) < LEAST_LENGTH:
                            continue
                    total[word] += n
                if len(total) > HELD:
                    yield _counts(total)
                    total.clear()
        yield _counts(total)
        total.clear()
        tidy()

    found = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _counts(total: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])


def letters(words: list[str], length: int) -> np.ndarray:
    """The letters of words of one length as numbers under LETTERS, a row each."""
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)
    return np.where(codes < 0xC0, codes - 97, codes - (0xC0 - 26)).astype(np.uint8)


def counts_of(rows: np.ndarray) -> np.ndarray:
    """How often each letter is in each row, in as few bytes as do."""
    n, length = rows.shape
    flat = np.bincount((np.arange(n)[:, None] * LETTERS + rows).ravel(), minlength=n * LETTERS).reshape(n, LETTERS)
    return flat.astype(np.int8 if length < 127 else np.int32)


def split_at(x: np.ndarray) -> tuple[int, int] | None:
    """The letter whose counts vary most, and the largest count of the lower half; nothing if all rows are equal."""
    lo, hi = x.min(0), x.max(0)
    if (lo == hi).all():
        return None
    letter = int(np.where(lo == hi, -1, x.var(0, dtype=np.float32)).argmax())
    middle = int(np.sort(x[:, letter])[(len(x) - 1) // 2])
    return letter, min(middle, int(hi[letter]) - 1)


def outside(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """L1 distances of rows from a box."""
    return (np.maximum(lo - q, 0) + np.maximum(q - hi, 0)).sum(1, dtype=np.int32)


class Tree:
    """A k-d tree over letter counts: nodes hold the box of their points, leaves the points."""

    def __init__(self, x: np.ndarray, rows: np.ndarray | None = None):
        rows = np.arange(len(x)) if rows is None else rows
        own = x[rows]
        self.lo, self.hi, self.rows, self.below = own.min(0), own.max(0), rows, ()
        if len(rows) > LEAF and (cut := split_at(own)):
            left = own[:, cut[0]] <= cut[1]
            self.below = Tree(x, rows[left]), Tree(x, rows[~left])

    def search(self, x: np.ndarray, q: np.ndarray, asking: np.ndarray, radius: int):
        """Pairs (question, point) at exactly this L1 distance, leaf by leaf."""
        asking = asking[outside(q[asking], self.lo, self.hi) <= radius]
        if not len(asking):
            return
        if self.below:
            for tree in self.below:
                yield from tree.search(x, q, asking, radius)
            return
        # a leaf of equal points may be large
        step = max(1, 2_000_000 // (LETTERS * min(len(self.rows), LEAF)))
        for p in range(0, len(self.rows), LEAF):
            rows = self.rows[p : p + LEAF]
            for a in range(0, len(asking), step):
                some = asking[a : a + step]
                i, j = np.nonzero(np.abs(q[some][:, None] - x[rows][None]).sum(2, dtype=np.int32) == radius)
                yield some[i], rows[j]


class Upper:
    """The upper part of a tree, that cuts a length into cells: a split and two parts, or a cell's number."""

    def __init__(self, x: np.ndarray, share: float, cell: int, numbers: list[int] | None = None):
        """x: the sample's letter counts; share: words that a sampled word stands for."""
        numbers = [0] if numbers is None else numbers
        cut = split_at(x) if len(x) > 1 and len(x) * share > cell else None
        if cut is None:
            self.cut, self.cell = None, numbers[0]
            numbers[0] += 1
            return
        left = x[:, cut[0]] <= cut[1]
        self.cut, self.below = cut, (Upper(x[left], share, cell, numbers), Upper(x[~left], share, cell, numbers))

    def reached(self, q: np.ndarray, asking: np.ndarray, radius: int, used: dict[int, np.ndarray] | None = None):
        """(rows, cell): the cells whose half spaces are within radius; the distance along a letter counts once."""
        if self.cut is None:
            yield asking, self.cell
            return
        letter, most = self.cut
        used = used or {}
        for tree, away in ((self.below[0], q[:, letter].astype(np.int32) - most), (self.below[1], most + 1 - q[:, letter].astype(np.int32))):
            along = used | {letter: np.maximum(np.maximum(away, 0), used.get(letter, 0))}
            near = asking[sum(along.values())[asking] <= radius]
            if len(near):
                yield from tree.reached(q, near, radius, along)


def room(length: int) -> int:
    """Points that a cell may hold."""
    return max(1, min(CELL, CELL_BYTES // (length + 4 * LETTERS)))


def uppers(vocabulary: DataFrame) -> dict[int, Upper]:
    """The upper trees of the lengths that are cut."""
    sizes = vocabulary.groupBy("len").agg(F.count("*").alias("n"))
    cap = F.greatest(F.lit(1), F.least(F.lit(CELL), F.floor(F.lit(CELL_BYTES) / (F.col("len") + 4 * LETTERS))))
    large = {r["len"]: r["n"] for r in sizes.where(F.col("n") > cap).collect()}
    out = {}
    for length, n in large.items():
        every = -(-n // min(SAMPLE, CELL_BYTES // length + 1))
        words = [r["word"] for r in vocabulary.where((F.col("len") == length) & (F.pmod(F.xxhash64("word"), F.lit(every)) == 0)).select("word").collect()]
        if len(words) > 1:
            out[length] = Upper(counts_of(letters(words, length)), n / len(words), room(length))
    return out


def placed(vocabulary: DataFrame, trees: dict[int, Upper]) -> DataFrame:
    """word, n, len and cell of a tree, asks: each word as a point of one cell, and as a question in all cells within reach."""
    held = vocabulary.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for batch in batches:
            words, n, size = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for length in np.unique(size).tolist():
                rows = np.flatnonzero(size == length)
                around = [t for t in (length - 1, length, length + 1) if t >= LEAST_LENGTH]
                q = counts_of(letters(words[rows].tolist(), length)) if any(t in held.value for t in around) else None
                out = []
                for t, radius, asks in [(length, 0, False), *((t, 2 if t == length else 1, True) for t in around)]:
                    cells = held.value[t].reached(q, np.arange(len(rows)), radius) if t in held.value else [(np.arange(len(rows)), 0)]
                    out += [(rows[at], t, cell, asks) for at, cell in cells]
                at = np.concatenate([o[0] for o in out])
                many = [len(o[0]) for o in out]
                of = lambda k, kind: pa.array(np.repeat([o[k] for o in out], many), kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(words[at].tolist(), pa.string()), pa.array(n[at], pa.int64()), of(1, pa.int32()), of(2, pa.int32()), of(3, pa.bool_())], ["word", "n", "len", "cell", "asks"])
        tidy()

    return vocabulary.select("word", "n", "len").mapInArrow(run, "word string, n long, len int, cell int, asks boolean")


def sliced(rows: DataFrame) -> DataFrame:
    """rows with the slice of points and that of questions where they meet; points go to all slices of questions, questions to
    all slices of points."""
    cap = F.greatest(F.lit(1), F.least(F.lit(CELL), F.floor(F.lit(CELL_BYTES) / (F.col("len") + 4 * LETTERS)))) * 2
    sizes = rows.groupBy("len", "cell").agg(F.count_if(~F.col("asks")).alias("p"), F.count_if("asks").alias("q"))
    parts = lambda c: F.ceil(F.col(c) / cap).cast("int").alias(f"{c}s")
    sizes = written(sizes.where("p > 0 and q > 0").select("len", "cell", parts("p"), parts("q")), "cells")
    own = lambda c: F.pmod(F.xxhash64("word"), F.col(c)).cast("int")
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    met = rows.join(small(sizes, sizes.count()), ["len", "cell"])
    met = met.withColumn("ps", F.when(F.col("asks"), every("ps")).otherwise(F.array(own("ps")))).withColumn("qs", F.when(F.col("asks"), F.array(own("qs"))).otherwise(every("qs")))
    return met.withColumn("ps", F.explode("ps")).withColumn("qs", F.explode("qs"))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters a differ from rows b by one replaced letter, or by one letter that b has more."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    if a.shape[1] > b.shape[1]:
        a, b = b, a
    same = np.ones((len(a), 1), bool)
    front = np.logical_and.accumulate(np.hstack([same, a == b[:, :-1]]), 1)
    back = np.logical_and.accumulate(np.hstack([(a == b[:, 1:]), same])[:, ::-1], 1)[:, ::-1]
    return (front & back).any(1)


def searched(group: pa.Table) -> pa.Table:
    """word, near, best_n, best of the questions of a cell that have near words among its points."""
    length = group.column("len")[0].as_py()
    asks = group.column("asks").to_numpy()
    words, n = np.array(group.column("word").to_pylist(), object), group.column("n").to_numpy()
    points, found = np.flatnonzero(~asks), []
    if len(points) and asks.any():
        own = letters(words[points].tolist(), length)
        x = counts_of(own)
        tree = Tree(x)
        rank = np.empty(len(points), np.int64)
        rank[sorted(range(len(points)), key=lambda i: words[points[i]])] = np.arange(len(points))
        sizes = np.array([len(w) for w in words])
        for size in (length - 1, length, length + 1):
            asking = np.flatnonzero(asks & (sizes == size))
            for a in range(0, len(asking), 8192):
                some = asking[a : a + 8192]
                theirs = letters(words[some].tolist(), size)
                q = counts_of(theirs).astype(x.dtype)
                i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for s, p in tree.search(x, q, np.arange(len(some)), 2 if size == length else 1):
                    good = one_edit(theirs[s], own[p])
                    i.append(s[good])
                    j.append(p[good])
                i, j = np.concatenate(i), np.concatenate(j)
                if len(i):
                    order = np.lexsort((rank[j], -n[points[j]], i))
                    first = order[np.concatenate(([True], np.diff(i[order]) > 0))]
                    near = np.bincount(i, minlength=len(some))
                    found.append((words[some[i[first]]], near[i[first]], n[points[j[first]]], words[points[j[first]]]))
    column = lambda k, kind: pa.array(np.concatenate([f[k] for f in found]).tolist() if found else [], kind)
    return pa.table({"word": column(0, pa.string()), "near": column(1, pa.int64()), "best_n": column(2, pa.int64()), "best": column(3, pa.string())})


def variants(vocabulary: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of a vocabulary (word, n), whose words are distinct runs of a-z and U+00C0 to U+00FF
    of any length from LEAST_LENGTH on. All Python runs before this returns."""
    with arrow_rows(vocabulary.sparkSession, 10_000):
        vocabulary = written(vocabulary.withColumn("len", F.char_length("word")), "vocabulary")
        rows = written(placed(vocabulary, uppers(vocabulary)), "placed")
        near = written(sliced(rows).groupBy("len", "cell", "ps", "qs").applyInArrow(searched, "word string, near long, best_n long, best string"), "near")
    best = near.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b"))
    close = F.coalesce(-F.col("b.n") >= 2 * F.col("n"), F.lit(False))
    all_words = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(close, F.col("b.word")).alias("form"), F.when(close, -F.col("b.n")).alias("form_n"))
    all_words = written(all_words, "forms")
    forget(rows, near)
    hops = written(all_words.where("form is not null").select("word", F.col("form").alias("to")), "hops")
    count, most = hops.count(), all_words.agg(F.max("n")).collect()[0][0] or 1
    for _ in range(max(1, most.bit_length()).bit_length()):  # a chain has fewer steps than its largest count has bits
        before, on = hops, hops.select(F.col("word").alias("to"), F.col("to").alias("next"))
        hops = written(before.join(small(on, count), "to", "left").select("word", F.coalesce("next", "to").alias("to")), "hops")
        forget(before)
    return all_words.join(small(hops, count), "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    with arrow_rows(spark, 256):
        words = written(counted(table(spark, sf_dir, "documents")), "words")
    return variants(words)


ORACLE = {
    "op11_spelling": r"""
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
r AS (
  SELECT doc_id, w, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{5,}')) AS w FROM documents)
  GROUP BY doc_id, w),
b AS (
  SELECT doc_id, w, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), CAST(128 + (unicode(c) & 63) AS BIGINT)] END)) AS bytes FROM r),
h AS (SELECT w, n, xor(list_reduce(list_concat([4294967295], bytes), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, t),
v AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word, n FROM h)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
d AS (SELECT word, n, i, substr(word, 1, CAST(i AS INT) - 1) || substr(word, CAST(i AS INT) + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (
  SELECT x.word, y.word AS near, y.n FROM d x JOIN d y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.rest = v.word
  UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word),
k AS (SELECT word, count(*) AS n_near, min(struct_pack(n := -n, near := near)) AS best FROM p GROUP BY word),
f AS (
  SELECT v.word, v.n, coalesce(k.n_near, 0) AS n_near, CASE WHEN -k.best.n >= 2 * v.n THEN k.best.near END AS form, CASE WHEN -k.best.n >= 2 * v.n THEN -k.best.n END AS form_n
  FROM v LEFT JOIN k USING (word)),
c AS (SELECT word, word AS seen, 0 AS step FROM f UNION ALL SELECT c.word, f.form, c.step + 1 FROM c JOIN f ON f.word = c.seen WHERE f.form IS NOT NULL)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT word, arg_max(seen, step) AS root FROM c GROUP BY word) l USING (word)"""
}
