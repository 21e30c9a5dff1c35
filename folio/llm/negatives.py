"""Hard-negative mining by angular triangle filtering.

Components are floored to integers, floor(256 * x), and scores are integer inner products. Every row stores its norm and its
angles to up to REFS reference directions (rows of a bounded sample, farthest first). For an anchor and a row, the angles to
each reference bound the angle between the two from below (their difference) and from above (their sum, or the rest of the
circle); the tightest of these give an interval of cosines, and times the two norms an interval of scores, widened by more
than all rounding. Only rows whose interval meets the window of scores that is still wanted are scored, in integers (in
double precision where all sums stay under 2 ** 53, else in 64 bits or more), so results are exact.

Two searches share this: an anchor's positives want scores at or above its fifth best so far among its own label; a positive's
negatives want scores of 30 to 90 percent of the positive's, at or above the tenth best so far. Rows of a block are sorted
by label, nearest reference and angle, and cut into tiles of TILE rows; a tile has its own intervals of angles and norms, so
most tiles are left out before any of their rows is looked at. The tiles of highest bounds are scored first.

Distribution: rows stay where they are read, in blocks of PART_BYTES; anchors go to all tasks in sheets of at most ANCHORS rows and
SHEET_BYTES, one sheet after the other, and only the best few of an anchor (or positive) in a task leave it. Where there are
many tasks, every SHARE-th of them is searched first, which bounds what is wanted of the rest. A common label, vector or
direction is spread over tasks as its rows are. A stated query set meets all rows, so work grows with anchors times rows, all
of it but the tiles' bounds left to what the filter lets through.

Cases: rows without a vec_id or a label, and vectors that are null or empty or hold null or non-finite components (or ones
that don't fit 62 bits) take no part; vectors of different dimension are never compared; a vector of zeros scores 0; where
several rows have one vec_id, that of the smallest label and then vector stands for all, so repeated rows count once; ties go to
the smaller vec_id; fewer positives or negatives than wanted give fewer rows, a negative positive score none; an empty table
gives an empty table; only vec_id, label and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import arrow_rows, small, table, tidy, written

REFS, SAMPLE = 16, 2_000
#: Rows of a tile; bytes of a task's block of rows (in double precision); anchors of a sheet and their bytes.
TILE, PART_BYTES, ANCHORS, SHEET_BYTES = 64, 32 << 20, 1 << 15, 32 << 20
#: Tiles that are scored before the bound is drawn.
AHEAD = 4
#: With more tasks than this, every SHARE-th task is searched first.
SHARE = 16
POSITIVES, NEGATIVES = 5, 10
#: More than the error of two stored angles (an arc cosine of a rounded product, rounded to 32 bits), and of a cosine.
ANGLE_SLACK, COSINE_SLACK = 1e-5, 1e-9
#: The window of a negative's score, in percent of its positive's.
LEAST, MOST = 30, 90
STORED = "vec_id long, label long, dim int, q binary, norm double, cell int, angles binary"


def quantised(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their integer components) of usable vectors, by dimension."""
    sizes = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.concatenate(([0], np.cumsum(sizes)))
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(256 * flat)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == dim)
        v = flat[at[rows][:, None] + np.arange(dim)]
        good = (np.abs(v) < 2.0**62).all(1)  # false for NaN
        if good.any():
            yield rows[good], v[good].astype(np.int64)


def packed(q: np.ndarray) -> list[bytes]:
    """Rows of integers, each in as few bytes as hold all rows."""
    most = int(np.abs(q).max(initial=0))
    kind = next(k for k, top in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 63)) if most < top)
    return [r.tobytes() for r in q.astype(kind)]


def unpacked(rows: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(rows), dim), np.int64)
    width = np.array([len(r) // dim for r in rows])
    for w in np.unique(width).tolist():
        some = np.flatnonzero(width == w)
        out[some] = np.frombuffer(b"".join(rows[i] for i in some), f"<i{w}").reshape(-1, dim)
    return out


def angles(q: np.ndarray, norm: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Angles of rows to reference directions (unit vectors); a right angle for zero rows, whose scores don't need one."""
    cosine = (q @ refs.T) / np.where(norm > 0, norm, 1)[:, None]
    return np.arccos(np.clip(cosine, -1, 1)).astype(np.float32)


def references(sample: list[tuple[int, bytes]]) -> dict[int, np.ndarray]:
    """Up to REFS unit vectors of each dimension of a sample (dim, q), each the farthest from those before it."""
    out = {}
    for dim in sorted({d for d, _ in sample}):
        q = unpacked([bytes(v) for d, v in sample if d == dim], dim).astype(np.float64)
        norm = np.sqrt((q * q).sum(1))
        u = q[norm > 0] / norm[norm > 0, None]
        if not len(u):
            continue
        picked, nearest = [0], u @ u[0]
        while len(picked) < REFS and nearest.min() < 1 - 1e-6:
            picked.append(int(nearest.argmin()))
            nearest = np.maximum(nearest, u @ u[picked[-1]])
        out[dim] = u[picked]
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim, q of usable rows of vectors (vec_id, label, embedding); one row for each vec_id."""

    def run(batches):
        for batch in batches:
            ids, labels = batch.column(0), batch.column(1)
            for rows, q in quantised(batch.column(2)):
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([ids.take(take), labels.take(take), pa.array(np.full(len(rows), q.shape[1], np.int32)), pa.array(packed(q), pa.binary())], ["vec_id", "label", "dim", "q"])

    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    known = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast(kind)).where("vec_id is not null and label is not null")
    rows = written(known.mapInArrow(run, "vec_id long, label long, dim int, q binary"), "quantised")
    again = written(rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "repeated")
    count = again.count()
    if not count:
        return rows
    again = small(again, count)
    first = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "q", "dim")).alias("r")).select("vec_id", "r.label", "r.dim", "r.q")
    return rows.join(again, "vec_id", "left_anti").unionByName(first)


def stored(rows: DataFrame, refs: dict[int, np.ndarray]) -> DataFrame:
    """STORED of rows (vec_id, label, dim, q)."""
    held = rows.sparkSession.sparkContext.broadcast(refs)

    def run(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                some = batch.take(pa.array(np.flatnonzero(dims == dim)))
                q = unpacked(some.column(3).to_pylist(), dim).astype(np.float64)
                norm = np.sqrt((q * q).sum(1))
                own = angles(q, norm, held.value.get(dim, np.zeros((0, dim))))
                cell = own.argmin(1) if own.shape[1] else np.zeros(len(own), np.int64)
                yield pa.RecordBatch.from_arrays([*(some.column(i) for i in range(4)), pa.array(norm), pa.array(cell, pa.int32()), pa.array([r.tobytes() for r in own], pa.binary())], ["vec_id", "label", "dim", "q", "norm", "cell", "angles"])
        tidy()

    return written(rows.mapInArrow(run, STORED), "stored")


@dataclass
class Rows:
    """Rows of one dimension: ids, labels, integers, norms, angles."""

    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray
    norm: np.ndarray
    angles: np.ndarray

    def at(self, rows: np.ndarray) -> Rows:
        return Rows(self.ids[rows], self.labels[rows], self.q[rows], self.norm[rows], self.angles[rows])


def rows_of(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, Rows]]:
    """Rows of each dimension of STORED."""
    column = lambda name: batch.column(batch.schema.names.index(name))
    dims = column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        some = batch.take(pa.array(np.flatnonzero(dims == dim)))
        ids, labels, q, norm, own = (some.column(some.schema.names.index(n)) for n in ("vec_id", "label", "q", "norm", "angles"))
        own = np.frombuffer(b"".join(own.to_pylist()), np.float32).reshape(len(ids), -1)
        yield dim, Rows(ids.to_numpy(), labels.to_numpy(), unpacked(q.to_pylist(), dim), norm.to_numpy(), own)


def cosines(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest cosine to an anchor (angles a) of rows or tiles whose angles are lo to hi."""
    if not len(a):
        return np.full(len(lo), -1.0), np.ones(len(lo))
    a = a.astype(np.float64)
    apart = np.maximum(np.maximum(a - hi, lo - a), 0).max(1) - ANGLE_SLACK
    together = np.minimum(np.minimum(a + hi, 2 * np.pi - a - lo), np.pi).min(1) + ANGLE_SLACK
    return np.cos(np.minimum(together, np.pi)) - COSINE_SLACK, np.cos(np.maximum(apart, 0)) + COSINE_SLACK


def bounds(a: np.ndarray, norm: float, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers that no score of an anchor with rows or tiles (angles lo to hi, norms least to most) is under or over."""
    down, up = cosines(a, lo, hi)
    low = norm * np.where(down > 0, down * least, down * most)
    high = norm * np.where(up > 0, up * most, up * least)
    return np.floor(low) - 1, np.ceil(high) + 1


class Block:
    """Rows of one dimension, sorted and cut into tiles of one label."""

    def __init__(self, rows: Rows):
        near = rows.angles.argmin(1) if rows.angles.shape[1] else np.zeros(len(rows.ids), np.int64)
        depth = rows.angles[np.arange(len(near)), near] if rows.angles.shape[1] else near
        self.rows = rows = rows.at(np.lexsort((depth, near, rows.labels)))
        n = np.arange(len(rows.ids))
        first = np.concatenate(([True], rows.labels[1:] != rows.labels[:-1]))
        of_label = n - n[first][np.cumsum(first) - 1]
        self.start = np.flatnonzero(of_label % TILE == 0)
        self.end = np.concatenate((self.start[1:], [len(n)]))
        self.label = rows.labels[self.start]
        cut = lambda f, x: f.reduceat(x, self.start) if x.size else np.zeros((len(self.start), *x.shape[1:]), x.dtype)
        self.lo, self.hi = cut(np.minimum, rows.angles), cut(np.maximum, rows.angles)
        self.least, self.most = cut(np.minimum, rows.norm), cut(np.maximum, rows.norm)
        self.largest = int(np.abs(rows.q).max())
        self.real = rows.q.astype(np.float64) if self.largest < 1 << 53 else None

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact inner products, as 64-bit integers (held at their limits beyond)."""
        limit = self.largest * int(np.abs(q).max()) * len(q)
        if limit < 1 << 53:
            return (self.real[rows] @ q.astype(np.float64)).astype(np.int64)
        if limit < 1 << 63:
            return self.rows.q[rows] @ q
        return np.clip(self.rows.q[rows].astype(object) @ q.astype(object), -(2**63), 2**63 - 1).astype(np.int64)

    def tiles(self, a: Rows, i: int) -> tuple[np.ndarray, np.ndarray]:
        return bounds(a.angles[i], a.norm[i], self.lo, self.hi, self.least, self.most)

    def members(self, tiles: np.ndarray) -> np.ndarray:
        size = self.end[tiles] - self.start[tiles]
        return np.repeat(self.start[tiles] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())

    def within(self, a: Rows, i: int, tiles: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of these tiles' rows whose bounds meet low to high, without the anchor's own vec_id."""
        rows = self.members(tiles)
        own = self.rows.angles[rows]
        norm = self.rows.norm[rows]
        least, most = bounds(a.angles[i], a.norm[i], own, own, norm, norm)
        rows = rows[(most >= low) & (least <= high) & (self.rows.ids[rows] != a.ids[i])]
        return rows, self.scores(rows, a.q[i])


Best = tuple[np.ndarray, np.ndarray]
NONE: Best = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def best(held: Best, ids: np.ndarray, scores: np.ndarray, k: int) -> Best:
    """The k best of two lists: higher scores first, ties to smaller ids."""
    ids, scores = np.concatenate((held[0], ids)), np.concatenate((held[1], scores))
    if len(ids) > 4 * k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, ~scores))[:k]
    return ids[order], scores[order]


def wanted(held: list[Best], least: list[int], k: int) -> float:
    """The lowest score that can still enter one of these lists."""
    return min(max(low, int(h[1][-1]) if len(h[0]) == k else low) for h, low in zip(held, least, strict=True))


def mined(block: Block, a: Rows, i: int, same: bool, held: list[Best], windows: list[tuple[int, int]], k: int) -> None:
    """Brings the lists up to date with the block's rows of anchor i's label (or of all others), one list for each window."""
    low, high = block.tiles(a, i)
    most, least = max(w[1] for w in windows), [w[0] for w in windows]
    tiles = np.flatnonzero(((block.label == a.labels[i]) == same) & (low <= most) & (high >= wanted(held, least, k)))
    tiles = tiles[np.argsort(-high[tiles], kind="stable")]
    for first, last in ((0, AHEAD), (AHEAD, len(tiles))):
        bound = wanted(held, least, k)
        some = tiles[first:last]
        some = some[high[some] >= bound]
        if not len(some):
            continue
        rows, scores = block.within(a, i, some, bound, most)
        for j, (down, up) in enumerate(windows):
            good = (scores >= down) & (scores <= up)
            held[j] = best(held[j], block.rows.ids[rows[good]], scores[good], k)


def _search(rows: DataFrame, sheet: dict[int, tuple[Rows, list[list[tuple[int, int, int]]]]], same: bool, k: int, every: int) -> DataFrame:
    """anchor_id, key, vec_id, score: the best k for each window (low, high, key) of each anchor of a sheet, in every
    `every`-th task."""
    held = rows.sparkSession.sparkContext.broadcast(sheet)

    def run(batches):
        from pyspark import TaskContext

        if TaskContext.get().partitionId() % every:
            return
        lists: dict[int, list[list[Best]]] = {d: [[NONE] * len(w) for w in windows] for d, (_, windows) in held.value.items()}
        gathered: dict[int, list[Rows]] = {}

        def flush(dim: int) -> None:
            parts = gathered.pop(dim)
            block = Block(Rows(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("ids", "labels", "q", "norm", "angles"))))
            anchors, windows = held.value[dim]
            for i, w in enumerate(windows):
                if w:
                    mined(block, anchors, i, same, lists[dim][i], [(low, high) for low, high, _ in w], k)

        for batch in batches:
            for dim, part in rows_of(batch):
                if dim in held.value:
                    gathered.setdefault(dim, []).append(part)
                    if sum(p.q.nbytes for p in gathered[dim]) >= PART_BYTES:
                        flush(dim)
        for dim in list(gathered):
            flush(dim)
        for dim, found in lists.items():
            anchors, windows = held.value[dim]
            flat = [(anchors.ids[i], w[2], *x) for i, own in enumerate(found) for w, x in zip(windows[i], own, strict=True) if len(x[0])]
            for at in range(0, len(flat), 10_000):
                some = flat[at : at + 10_000]
                n = [len(x[2]) for x in some]
                arrays = [np.repeat([x[0] for x in some], n), np.repeat([x[1] for x in some], n), np.concatenate([x[2] for x in some]), np.concatenate([x[3] for x in some])]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], ["anchor_id", "key", "vec_id", "score"])
        tidy()

    return rows.mapInArrow(run, "anchor_id long, key long, vec_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def searched(rows: DataFrame, anchors: dict[int, Rows], windows: dict[int, list[list[tuple[int, int, int]]]], same: bool, k: int) -> DataFrame:
    """anchor_id, key, vec_id, score, rank of a sheet's windows."""
    sheet = {d: (a, windows[d]) for d, a in anchors.items()}
    if rows.rdd.getNumPartitions() > SHARE:
        floors = {(r["anchor_id"], r["key"]): r["score"] for r in ranked(_search(rows, sheet, same, k, SHARE), k).where(F.col("rank") == k).collect()}
        raised = lambda i, w: (max(w[0], floors.get((int(i), w[2]), w[0])), w[1], w[2])
        sheet = {d: (a, [[raised(i, w) for w in own] for i, own in zip(a.ids, ws, strict=True)]) for d, (a, ws) in sheet.items()}
    return ranked(_search(rows, sheet, same, k, 1), k)


def negatives(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, k: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors (vec_id, label, embedding); anchors
    are the rows whose vec_id is divisible by `every`. All Python runs before this returns."""
    with arrow_rows(vectors.sparkSession, 4_000):
        return _negatives(vectors, every, positives, k)


def _negatives(vectors: DataFrame, every: int, positives: int, k: int) -> DataFrame:
    spark = vectors.sparkSession
    rows = usable(vectors)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("dim", "q").collect()
    rows = stored(rows, references([(r["dim"], r["q"]) for r in sample]))
    asking = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    size = asking.agg(F.count("*"), F.sum(F.length("angles") + 8 * F.col("dim") + 64)).collect()[0]
    sheets = max(1, -(-size[0] // ANCHORS), -(-(size[1] or 0) // SHEET_BYTES))
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    ends = 2**63 - 1
    for sheet in range(sheets if size[0] else 0):
        anchors = dict(rows_of(asking.where(F.pmod(F.xxhash64("vec_id"), F.lit(sheets)) == sheet).toArrow()))
        first = searched(rows, anchors, {d: [[(-ends, ends, 0)]] * len(a.ids) for d, a in anchors.items()}, True, positives).collect()
        known: dict[int, list[tuple[int, int]]] = {}
        for r in first:
            known.setdefault(r["anchor_id"], []).append((r["vec_id"], r["score"]))
        # 30 * positive <= 100 * negative <= 90 * positive
        window = lambda p: (-(-LEAST * p[1] // 100), MOST * p[1] // 100, p[0])
        windows = {d: [[window(p) for p in known.get(int(i), []) if p[1] >= 0] for i in a.ids] for d, a in anchors.items()}
        scored = spark.createDataFrame([(i, p, s) for i, ps in known.items() for p, s in ps], "anchor_id long, key long, positive_score long")
        found = searched(rows, anchors, windows, False, k).join(F.broadcast(scored), ["anchor_id", "key"])  # at most `positives` rows an anchor of the sheet
        out = out.unionByName(written(found.select("anchor_id", F.col("key").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


ORACLE = {
    "op13_hard_negatives": r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""
}
