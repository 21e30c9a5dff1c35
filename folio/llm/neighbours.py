"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation turns vectors by three rounds of random signs and a fast Hadamard transform, and the nearest signed axis is
one digit of a vector's bucket; a table's bucket has AXES digits, each from its own rotation. A query probes, in each of
TABLES tables, the buckets whose axes are nearest to it (best sums of two turned coordinates first); every vector of a probed
bucket is a candidate, each candidate is ranked once by its exact inner product in double precision, and no bucket is capped.

Distribution: rows stay where they are read. A task takes its rows in blocks of PART vectors, builds the tables of a block in
memory and searches them for a bounded block of QUERIES query vectors, which is broadcast; only the best k vec_ids of a query
in a task leave it. Query blocks run one after the other, so memory is bounded for any number of rows and queries. Where there are
many tasks, a first pass over every SHARE-th of them bounds each query's k-th score from below, and the pass over all rows
lets only scores at or above that bound out; the result is the same with and without it. A bucket of any size, a third of all
rows included, is spread over tasks as its rows are.

Probes are measured, not assumed: SEEN queries (those of smallest hash) are answered exactly in one pass over all rows, which
also notes from how many probes a table on each of their neighbours would have been a candidate; the fewest probes that
find AIM of these neighbours are taken. How many that is depends on the rows' number, dimension, lengths and structure (a few on
clustered vectors, hundreds on structureless ones). Where no number up to MOST does, as on structureless vectors of many
dimensions, hashing can't help: every row is a candidate, and the search is exact. The pass costs SEEN products a row.

Vectors of unequal length get one more component, sqrt(max norm^2 - norm^2) (0 for queries), so that the nearest by angle
are those of largest inner product. Vectors of different dimension are never compared.

Cases: vectors that are null, empty, zero, or hold null or non-finite components take no part; ties go to the smaller
vec_id; a query's own vec_id is never its result, also if several rows have it; a vec_id counts once, with its best row,
however often it is repeated; rows of one query vec_id that differ are one query with its best scores; fewer candidates than
k give fewer rows; an empty table gives an empty table; only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.common import table

TABLES = 32
AXES = 2
#: Most probes of a table; queries whose neighbours are measured, and the share of these that must be found.
MOST, SEEN, AIM = 1024, 64, 0.94
#: Vectors in a block of a task; queries in a broadcast block, and their bytes.
PART, QUERIES, QUERY_BYTES = 1 << 17, 1 << 17, 64 << 20
#: With more tasks than this, every SHARE-th task is searched first for a bound.
SHARE = 16
#: Buckets of a table are folded to this many.
BUCKETS = 1 << 18
K = 20
FOUND = "query_id long, vec_id long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the (unnormalised) Hadamard matrix; the row length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x


@lru_cache(512)
def rotation(width: int, seed: int) -> np.ndarray:
    """The matrix of a pseudo-rotation, got by turning the unit vectors; blocks of rows are turned by one product with it."""
    x = np.eye(width)
    for signs in np.random.default_rng(seed).choice([-1.0, 1.0], (3, width)):
        x = hadamard(x * signs) / np.sqrt(width)
    return x.astype(np.float32)


def padded(v: np.ndarray) -> np.ndarray:
    width = 1 << max(1, (v.shape[1] - 1).bit_length())
    x = np.zeros((len(v), width), np.float32)
    x[:, : v.shape[1]] = v
    return x


def buckets(x: np.ndarray, t: int) -> np.ndarray:
    """Table t's bucket of each padded row."""
    code = np.zeros(len(x), np.int64)
    for axis in range(AXES):
        y = x @ rotation(x.shape[1], t * AXES + axis)
        near = np.abs(y).argmax(1)
        code = code * (2 * x.shape[1]) + near * 2 + (y[np.arange(len(y)), near] > 0)
    return code % BUCKETS


@lru_cache(16)
def corners(probes: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks (i, j) of two digits that can be among the `probes` best sums of two descending lists."""
    i, j = np.divmod(np.arange(digits * digits), digits)
    keep = (i + 1) * (j + 1) <= probes
    return i[keep], j[keep]


def probed(x: np.ndarray, t: int, probes: int) -> np.ndarray:
    """Table t's buckets nearest to each padded row, in no order."""
    m = min(2 * x.shape[1], max(2, probes), 32)
    near, code = None, None
    for axis in range(AXES):
        y = x @ rotation(x.shape[1], t * AXES + axis)
        both = np.stack([-y, y], 2).reshape(len(y), -1)
        top = np.argpartition(-both, m - 1, 1)[:, :m] if m < both.shape[1] else np.broadcast_to(np.arange(m), both.shape)
        w = np.take_along_axis(both, top, 1)
        order = np.argsort(-w, 1, kind="stable")
        top, w = np.take_along_axis(top, order, 1), np.take_along_axis(w, order, 1)
        if near is None:
            near, code = w, top.astype(np.int64)
            continue
        i, j = corners(probes, m) if near.shape[1] == m else np.divmod(np.arange(near.shape[1] * m), m)
        near, code = near[:, i] + w[:, j], code[:, i] * (2 * x.shape[1]) + top[:, j]
        if near.shape[1] > probes:
            best = np.argpartition(-near, probes - 1, 1)[:, :probes]
            near, code = np.take_along_axis(near, best, 1), np.take_along_axis(code, best, 1)
    return code % BUCKETS


class Block:
    """The tables of one block of vectors in memory: for each table the rows in bucket order, and where each bucket starts."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, extra: np.ndarray | None, tables: int):
        self.ids, self.v = ids, v
        if not tables:
            return
        x = padded(v if extra is None else np.column_stack([v, extra]))
        folded = min(BUCKETS, (2 * x.shape[1]) ** AXES)
        self.order, self.at = np.empty((tables, len(v)), np.int32), np.zeros((tables, folded + 1), np.int32)
        for t in range(tables):
            code = buckets(x, t)
            self.order[t] = np.argsort(code, kind="stable")
            np.cumsum(np.bincount(code, minlength=folded), out=self.at[t, 1:])

    def candidates(self, codes: np.ndarray) -> np.ndarray:
        """Rows in the buckets codes[table, probe], each once."""
        t = np.arange(len(codes))[:, None]
        start = self.at[t, codes]
        n = (self.at[t, codes + 1] - start).ravel()
        start = (start + t * self.order.shape[1]).ravel()
        start, n = start[n > 0], n[n > 0]
        mark = np.zeros(len(self.ids), bool)
        if len(n):
            ends = np.cumsum(n)
            mark[self.order.ravel()[np.arange(ends[-1]) + np.repeat(start - ends + n, n)]] = True
        return np.flatnonzero(mark)


def best(q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """The k ids of largest inner product (of an id's best row) with q and their scores, ties to smaller ids, none under floor."""
    rough = v @ q
    slack = 1e-9 * max(1.0, float(np.abs(rough).max(initial=0.0)))
    keep = rough >= floor - slack
    ids, v, rough = ids[keep], v[keep], rough[keep]
    # repeated rows of an id must not fill the cut
    repeats = len(ids) - len(np.unique(ids)) if len(ids) > k else 0
    if len(ids) > k + repeats:
        keep = rough >= np.partition(rough, len(rough) - k - repeats)[len(rough) - k - repeats] - slack
        ids, v = ids[keep], v[keep]
    scores = (v * q).sum(1)  # the same sum for equal rows, wherever they lie
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    first = np.sort(np.unique(ids, return_index=True)[1])[:k]
    first = first[scores[first] >= floor]
    return ids[first], scores[first]


def vectors_of(batches, dtype) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, vectors) of the usable rows of Arrow batches (vec_id, embedding)."""
    for batch in batches:
        ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        sizes = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype)
        at = np.concatenate(([0], np.cumsum(sizes)))
        known = ~pc.is_null(batch.column(0)).to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero((sizes == dim) & known)
            v = flat.reshape(-1, dim)[at[rows] // dim] if len(flat) == len(sizes) * dim else flat[at[rows][:, None] + np.arange(dim)]
            good = np.isfinite(v).all(1) & (v != 0).any(1)
            if good.any():
                yield dim, ids[rows[good]].astype(np.int64), v[good]


def blocks(batches, dtype, part: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """vectors_of, gathered to at most `part` rows; a row that repeats another of its block is dropped."""
    held: dict[int, list] = {}

    def made(dim: int):
        ids, v = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
        if len(np.unique(ids)) < len(ids):
            rows = np.ascontiguousarray(np.column_stack([ids.astype(np.int64).view(np.float64), v.astype(np.float64)]))
            once = np.sort(np.unique(rows.view(f"V{rows.shape[1] * 8}").ravel(), return_index=True)[1])
            ids, v = ids[once], v[once]
        return dim, ids, v

    for dim, ids, v in vectors_of(batches, dtype):
        for a in range(0, len(ids), part):
            x = (ids[a : a + part], v[a : a + part])
            if dim in held and sum(len(i) for i, _ in held[dim]) + len(x[0]) > part:
                yield made(dim)
            held.setdefault(dim, []).append(x)
    for dim in list(held):
        yield made(dim)


def _scan(rows: DataFrame, asked: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], longest: float | None, k: int, tables: int, probes: int | None, part: int, dtype, every: int = 1) -> DataFrame:
    """FOUND of every query of asked (dimension to ids, vectors, least scores) in the rows of every `every`-th task. Without
    probes every row is a candidate."""
    held = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches):
        from pyspark import TaskContext

        if TaskContext.get().partitionId() % every:
            return
        known: dict[int, tuple] = {}
        for dim, ids, v in blocks(batches, dtype, part):
            if dim not in held.value:
                continue
            q_ids, q, floor = held.value[dim]
            extra = None if longest is None else np.sqrt(np.maximum(longest**2 - (v.astype(np.float64) ** 2).sum(1), 0))
            block = Block(ids, v, extra, 0 if probes is None else tables)
            for a in range(0, len(q), 512):
                some = q[a : a + 512]
                x = padded(some if longest is None else np.column_stack([some, np.zeros(len(some))]))
                codes = None if probes is None else np.stack([probed(x, t, probes) for t in range(tables)])
                for i in range(len(some)):
                    at = np.arange(len(ids)) if codes is None else block.candidates(codes[:, i])
                    at = at[ids[at] != q_ids[a + i]]
                    own, scores = best(some[i], ids[at], v[at].astype(np.float64), k, floor[a + i])
                    if dim in known and a + i in known[dim]:
                        own, scores = merged(known[dim][a + i], (own, scores), k)
                    known.setdefault(dim, {})[a + i] = (own, scores)
        for dim, found in known.items():
            q_ids = held.value[dim][0]
            for a in range(0, len(found), 4096):
                some = [(q_ids[i], *x) for i, x in list(found.items())[a : a + 4096]]
                n = [len(x[1]) for x in some]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in some], n), pa.int64()), pa.array(np.concatenate([x[1] for x in some]), pa.int64()), pa.array(np.concatenate([x[2] for x in some]), pa.float64())], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, FOUND)


def merged(a: tuple, b: tuple, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best distinct ids of two lists."""
    ids, scores = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
    order = np.lexsort((ids, -scores))
    first = np.sort(np.unique(ids[order], return_index=True)[1])[:k]
    return ids[order][first], scores[order][first]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of FOUND; one shuffle, by query."""
    once = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def measured(rows: DataFrame, dtype) -> tuple[int, float, float, int]:
    """Usable rows, the largest and the smallest norm, the largest dimension."""

    def run(batches):
        for dim, ids, v in vectors_of(batches, dtype):
            norm = np.sqrt((v.astype(np.float64) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64()), pa.array([norm.max()]), pa.array([norm.min()]), pa.array([dim], pa.int32())], ["n", "hi", "lo", "dim"])

    r = rows.mapInArrow(run, "n long, hi double, lo double, dim int").agg(F.sum("n"), F.max("hi"), F.min("lo"), F.max("dim")).collect()[0]
    return r[0] or 0, r[1] or 0.0, r[2] or 0.0, r[3] or 1


def ladder(most: int = MOST) -> list[int]:
    """Numbers of probes that are tried, each about 1.5 times the one before."""
    out = [4]
    while out[-1] < most:
        out.append(min(most, out[-1] * 3 // 2))
    return out


def needed(rows: DataFrame, asking: DataFrame, longest: float | None, k: int, tables: int, part: int, dtype, aim: float = AIM) -> int | None:
    """The fewest probes of the ladder that find `aim` of the true neighbours of SEEN queries; nothing if none do."""
    some = gathered(asking.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEEN), dtype)
    held, steps = rows.sparkSession.sparkContext.broadcast(some), ladder()

    def run(batches):
        for dim, ids, v in blocks(batches, dtype, part):
            if dim not in held.value:
                continue
            q_ids, q, floor = held.value[dim]
            extra = None if longest is None else np.sqrt(np.maximum(longest**2 - (v.astype(np.float64) ** 2).sum(1), 0))
            block = Block(ids, v, extra, tables)
            x = padded(q if longest is None else np.column_stack([q, np.zeros(len(q))]))
            codes = [np.stack([probed(x, t, p) for t in range(tables)]) for p in steps]
            for i in range(len(q)):
                level = np.full(len(ids), len(steps), np.int32)
                for n in reversed(range(len(steps))):  # more probes reach all that fewer do
                    level[block.candidates(codes[n][:, i])] = n
                at = np.flatnonzero(ids != q_ids[i])
                own, scores = best(q[i], ids[at], v[at].astype(np.float64), k, floor[i])
                of = {int(j): int(x) for j, x in zip(ids[at], level[at], strict=True)} if len(np.unique(ids)) == len(ids) else {}
                for j, x in zip(ids[at], level[at], strict=True) if not of else ():
                    of[int(j)] = min(int(x), of.get(int(j), len(steps)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), q_ids[i])), pa.array(own, pa.int64()), pa.array(scores, pa.float64()), pa.array([of[int(j)] for j in own], pa.int32())], ["query_id", "vec_id", "score", "level"])

    found = rows.mapInArrow(run, f"{FOUND}, level int").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.min("level").alias("level"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    levels = np.array([r["level"] for r in found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("level").collect()])
    return next((p for n, p in enumerate(steps) if not len(levels) or (levels <= n).mean() >= aim), None)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, tables: int = TABLES, probes: int | None = None, part: int = PART, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query. probes: of a table; measured if not given."""
    dtype = np.float32 if dict(vectors.dtypes).get("embedding") == "array<float>" else np.float64
    kind = "array<float>" if dtype == np.float32 else "array<double>"
    rows, asking = (x.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind).alias("embedding")) for x in (vectors, queries))
    n, hi, lo, dim = measured(rows, dtype)
    longest = hi if hi - lo > 1e-3 * hi else None
    own = needed(rows, asking, longest, k, tables, part, dtype) if probes is None else probes
    tasks = rows.rdd.getNumPartitions()
    sheets = max(1, -(-asking.count() // max(1, min(block, QUERY_BYTES // (8 * dim)))))
    out = None
    for sheet in range(sheets):
        some = asking if sheets == 1 else asking.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(sheets)) == sheet)
        asked = gathered(some, dtype)
        scan = lambda every=1: _scan(rows, asked, longest, k, tables, own, part, dtype, every)  # noqa: B023, E731
        if tasks > SHARE:
            least = {r["query_id"]: r["score"] for r in ranked(scan(SHARE), k).where(F.col("rank") == k).select("query_id", "score").collect()}
            asked = {d: (i, q, np.array([least.get(int(x), -np.inf) for x in i])) for d, (i, q, _) in asked.items()}
        found = scan()
        out = found if out is None else out.unionAll(found)
    return ranked(out, k)


def gathered(queries: DataFrame, dtype) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """One bounded block of queries, by dimension: ids, vectors in double precision, least scores (none yet)."""
    held: dict[int, list] = {}
    for dim, ids, v in vectors_of(queries.toArrow().to_batches(), dtype):
        held.setdefault(dim, []).append((ids, v.astype(np.float64)))
    out = {}
    for dim, parts in held.items():
        ids, v = (np.concatenate(x) for x in zip(*parts, strict=True))
        once = np.sort(np.unique(np.column_stack([ids.view(np.float64), v]).view(f"V{(dim + 1) * 8}").ravel(), return_index=True)[1])
        out[dim] = (ids[once], v[once], np.full(len(once), -np.inf))
    return out


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
