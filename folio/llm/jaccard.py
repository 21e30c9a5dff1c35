"""N-gram Jaccard join: documents whose sets of word n-grams have a Jaccard similarity of a given percentage, as components.

Size-aware: a set of at most `boundary` shingles posts a signature for each of its fixed-size subsets (two such sets are
linked only if they share a subset of the size that their sizes ask for); a larger set posts its rarest shingles, those of
the prefix that a linked set must meet, and their inverted lists are scanned (the prefix's leading part meets sets that aren't
smaller; the rest of it only the leading parts of smaller ones). The boundary minimises the cost by the measured
sizes and list lengths. Rarity comes from a count sketch of fixed size over all shingles of all documents; it only orders
shingles, so its collisions cost time and never links. Every candidate pair is verified on the whole sets.

Skew: equal sets are one class before anything is paired. Lists that hold the same sets are one list. A list of at most
LIGHT sets gives its pairs. A longer list is never paired: its sets are verified against PIVOTS of them; sets that end up in
the first pivot's component need nothing more, since all their links are inside it; each of the others is compared with
the whole list, block by block within tasks, and only links that join components come out. So no link between components
is lost, and work beyond the pivots is proportional to those others. Components are found by alternating large-star and
small-star steps on written tables, each deleted once it is replaced.

Shingles are told apart by 64-bit hashes. Sets are named by 64 bits of a 128-bit hash; where the other 64 bits show that
one name stands for several sets, these sets get further names, so strangers are never merged. When two sets are compared, their
shingles are told apart by 48 bits (two sets of 300 shingles agree in one by chance once in three thousand million
comparisons, which matters only to a pair right at the limit).

Cases: null or wordless text has no shingles, n_shingles 0 and its own id as component_id; fewer words than an n-gram has are
one shingle; equal sets are linked; the component's name is its smallest doc_id; a row without a doc_id takes part and links
others, and gets its component's name, null if no row of it has a doc_id; one doc_id with several texts stands for each of
them; repeated rows give repeated rows; an empty table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import arrow_rows, chunks, forget, large, own_id, table, tidy, written

#: Counters of the sketch, parts in which it is summed, and how many tasks' parts one task adds up at a time.
SKETCH, PARTS, FAN = 1 << 22, 16, 64
LIGHT = 64
PIVOTS = 4
BLOCK = 1000
#: Sets of more shingles never enumerate subsets.
SMALLEST = 20

MULT = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD1342543DE82EF95
_powers: list[np.ndarray] = []


@dataclass(frozen=True)
class Rule:
    """Shingles of so many words; sets are linked if 100 * intersection >= percent * union."""

    words: int
    percent: int

    def linked(self, shared, a, b):
        return 100 * shared >= self.percent * (a + b - shared)

    def needed(self, s: int, t: int) -> int:
        """Shingles that linked sets of these sizes share, at least."""
        return -(-self.percent * (s + t) // (100 + self.percent))

    def partners(self, s: int) -> range:
        """Sizes of sets that a set of s can be linked with."""
        return range(-(-self.percent * s // 100), 100 * s // self.percent + 1)

    def prefix(self, s: int) -> int:
        return s - -(-self.percent * s // 100) + 1

    def subset_sizes(self, s: int, boundary: int) -> list[int]:
        return sorted({self.needed(s, t) for t in self.partners(s) if t <= boundary})

    def subsets(self, s: int, boundary: int) -> int:
        """How many subsets a set of s shingles posts."""
        return sum(comb(s, c) for c in self.subset_sizes(s, boundary)) if s <= boundary else 0

    def leading(self, s: int) -> int:
        """Length of the prefix in which a set meets the sets linked with it that aren't smaller."""
        return s - -(-2 * self.percent * s // (100 + self.percent)) + 1

    def scanned(self, s: int, boundary: int) -> int:
        """How many prefix shingles a set of s shingles posts."""
        return self.prefix(s) if max(self.partners(s)) > boundary else 0


#: The rule of the join's query, and that of near-duplicate stages.
JOIN, NEAR = Rule(4, 85), Rule(5, 80)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n or more."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(19, n.bit_length())
        both = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[:] = both
    return _powers[0], _powers[1]


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * MULT)
STEPS = mix(np.arange(11, 43, dtype=np.uint64) * MULT) | np.uint64(1)


def shingle_sets(texts: list[str], words: int):
    """The sorted distinct shingle hashes of each text."""
    for start, end in chunks(texts, 300_000):
        raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts[start:end]]
        ends = np.cumsum([len(r) + 1 for r in raw])
        a = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        inside = ~((a == 32) | ((a >= 9) & (a <= 13)))
        edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = powers(len(a) + 1)
        total = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(BYTES[a] * up[: len(a)], out=total[1:])
        word = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * MULT)
        n = len(word)
        grams = np.zeros(max(n - words + 1, 0), np.uint64)
        for i in range(words):
            grams += word[i : i + len(grams)] * STEPS[i]
        grams = mix(grams)
        at = 0
        for stop in np.searchsorted(s, ends).tolist():
            k = stop - at
            if k >= words:
                yield np.unique(grams[at : stop - words + 1])
            elif k:
                with np.errstate(over="ignore"):
                    yield mix(np.array([(word[at:stop] * STEPS[:k]).sum() + np.uint64(k)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
            at = stop


def choose_boundary(histogram: dict[int, int], rule: Rule, length: float = 1.0) -> int:
    """The size up to which sets enumerate subsets, by the cost over the measured sizes. A posted subset costs one step (its
    list seldom holds another set); a posted shingle costs one, and its list's measured length to scan."""
    cost = lambda b: sum(n * (rule.subsets(s, b) + rule.scanned(s, b) * (1 + length)) for s, n in histogram.items())
    return min(range(SMALLEST + 1), key=lambda b: (cost(b), b))


def list_length(counts: np.ndarray, rule: Rule) -> float:
    """The mean length of the lists of prefix shingles: that of the rarest share of all occurrences that prefixes take."""
    n = np.zeros((1 << 16) + 1, np.int64)
    for part in np.array_split(counts, max(1, len(counts) >> 18)):  # in parts, for the driver's memory
        n += np.bincount(np.minimum(part.astype(np.int64), 1 << 16), minlength=len(n))
    occurrences = n * np.arange(len(n))
    share = occurrences.sum() * (100 - rule.percent) / 100
    rare = np.cumsum(occurrences) <= max(share, occurrences[:2].sum())
    return float((occurrences * np.arange(len(n)))[rare].sum() / max(1, occurrences[rare].sum()))


def postings(elements: np.ndarray, counts: np.ndarray, boundary: int, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """What a set posts: subset signatures and the leading shingles of its prefix; and the rest of its prefix, in which it only
    meets smaller sets' leading shingles."""
    n, lead, trail = len(elements), [], elements[:0]
    if n <= boundary:
        own = mix(elements ^ MULT)
        with np.errstate(over="ignore"):
            for c in rule.subset_sizes(n, boundary):
                whole = own.sum()
                sums = [whole - own[list(gone)].sum() for gone in combinations(range(n), n - c)]
                lead.append(mix(np.array(sums, np.uint64) + np.uint64(c) * MULT))
    if n and max(rule.partners(n)) > boundary:
        rare = np.argsort(counts[elements & np.uint64(len(counts) - 1)], kind="stable")[: rule.prefix(n)]
        lead.append(elements[rare[: rule.leading(n)]])
        trail = elements[rare[rule.leading(n) :]]
    return (np.unique(np.concatenate(lead)) if lead else elements[:0]), np.setdiff1d(trail, np.concatenate(lead)) if len(trail) else trail


def _texts(batch) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.names.index("text")).to_pylist()]


def sketch(docs: DataFrame, rule: Rule) -> tuple[np.ndarray, dict[int, int]]:
    """Counts of all shingles by their low bits, and how many sets are of each size up to SMALLEST (twice that for
    partners). Each task sends its counters once, in 8 bits (a task's larger counts stay at their limit: enough to come
    last in the order); they are summed in PARTS parts, FAN tasks at a time, so no task holds more than FAN counters of a
    part, however many tasks there are."""
    size = SKETCH // PARTS

    def count(batches):
        total, sizes, one = np.zeros(SKETCH, np.uint32), np.zeros(2 * SMALLEST, np.int64), np.uint32(1)
        for batch in batches:
            for s in shingle_sets(_texts(batch), rule.words):
                if len(s) < 2 * SMALLEST:
                    sizes[len(s)] += 1
                np.add.at(total, (s & np.uint64(SKETCH - 1)).astype(np.intp), one)
        parts = [np.minimum(p, 0xFF).astype("<u1").tobytes() for p in total.reshape(PARTS, size)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS + 1), pa.int32()), pa.array([1] * PARTS + [8], pa.int32()), pa.array([*parts, sizes.astype("<u8").tobytes()], pa.binary())], ["part", "width", "n"])
        _powers.clear()
        tidy()

    def add(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        total = np.zeros(size if part < PARTS else 2 * SMALLEST, np.uint64)
        for width, x in zip(group.column("width"), group.column("n"), strict=True):
            total += np.frombuffer(x.as_py(), f"<u{width.as_py()}")
        width = 4 if part < PARTS else 8
        return pa.table({"group": pa.array([group.column("group")[0].as_py() // FAN], pa.int64()), "part": pa.array([part], pa.int32()), "width": pa.array([width], pa.int32()), "n": pa.array([np.minimum(total, (1 << 8 * width) - 1).astype(f"<u{width}").tobytes()], pa.binary())})

    texts = docs.select(F.col("text").cast("string"))
    tasks = texts.rdd.getNumPartitions()
    sums = texts.mapInArrow(count, "part int, width int, n binary").select(F.floor(F.spark_partition_id() / FAN).alias("group"), "part", "width", "n")
    while True:
        sums = sums.groupBy("group", "part").applyInArrow(add, "group long, part int, width int, n binary")
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            break
    # what orders shingles needs no counts beyond 16 bits, and the driver and all tasks hold these
    counts, sizes = np.zeros(SKETCH, np.uint16), np.zeros(2 * SMALLEST, np.uint64)
    for r in sums.collect():
        part = np.frombuffer(r["n"], f"<u{r['width']}")
        if r["part"] < PARTS:
            counts[r["part"] * size : (r["part"] + 1) * size] = np.minimum(part, 0xFFFF)
        else:
            sizes = part
    return counts, {i: int(sizes[i]) for i in range(1, 2 * SMALLEST) if sizes[i]}


def identity(elements: np.ndarray) -> tuple[int, int]:
    """Two halves of a set's 128-bit hash."""
    digest = hashlib.blake2b(elements.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def posted(docs: DataFrame, held: Broadcast, boundary: int, rule: Rule) -> DataFrame:
    """doc_id, n, rid, chk (halves of the set's hash, null if empty), posts, trail of each document. held: the sketch's counts."""

    def run(batches):
        for batch in batches:
            n, rid, chk, posts, trail = [], [], [], [], []
            for s in shingle_sets(_texts(batch), rule.words):
                n.append(len(s))
                a, b = identity(s) if len(s) else (None, None)
                rid.append(a)
                chk.append(b)
                lead, rest = postings(s, held.value, boundary, rule)
                posts.append(lead.view(np.int64))
                trail.append(rest.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, rid, chk)), *(pa.array(x, pa.list_(pa.int64())) for x in (posts, trail))], ["doc_id", "n", "rid", "chk", "posts", "trail"])
        _powers.clear()
        tidy()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, rid long, chk long, posts array<long>, trail array<long>")


def packed(elements: np.ndarray) -> bytes:
    """The upper 48 bits of each hash, 6 bytes each."""
    return np.ascontiguousarray((elements >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def named_apart(rid: int, chk: int) -> int:
    """A further name for one of several sets that share the name rid."""
    return int.from_bytes(hashlib.blake2b(f"{rid} {chk}".encode(), digest_size=8).digest(), "little", signed=True)


def sets_of(docs: DataFrame, rule: Rule, clashes: frozenset[int] = frozenset()) -> DataFrame:
    """rid, elements (packed hashes) of documents, each set once a task."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            rids, sets = [], []
            for s in shingle_sets(_texts(batch), rule.words):
                if len(s):
                    rid, chk = identity(s)
                    rid = named_apart(rid, chk) if rid in clashes else rid
                    if rid not in seen:
                        seen.add(rid)
                        rids.append(rid)
                        sets.append(packed(s))
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(sets, pa.binary())], ["rid", "elements"])
        _powers.clear()
        tidy()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "rid long, elements binary")


def verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs a, b whose sets are linked."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            for x, y, ex, ey in zip(*(batch.column(i) for i in range(4)), strict=True):
                p, q = unpacked(ex.as_py()), unpacked(ey.as_py())
                both = np.sort(np.concatenate((p, q)))
                if rule.linked(int((both[1:] == both[:-1]).sum()), len(p), len(q)):
                    a.append(x.as_py())
                    b.append(y.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        _powers.clear()
        tidy()

    side = lambda name, e: sets.select(F.col("rid").alias(name), F.col("elements").alias(e))
    return large(pairs).join(side("a", "ea"), "a").join(side("b", "eb"), "b").select("a", "b", "ea", "eb").mapInArrow(run, "a long, b long")


def joining(group: pa.Table, rule: Rule) -> pa.Table:
    """Links of a block that join components: each of the block's `asking` sets against all its sets. Columns asking, rid,
    comp, elements."""
    rid, comp, asking = (group.column(c).to_numpy() for c in ("rid", "comp", "asking"))
    sets = [unpacked(x.as_py()) for x in group.column("elements")]
    lens = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    at = np.concatenate(([0], np.cumsum(lens)))
    flags = np.zeros(int(codes.max()) + 1, np.int32)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    a, b = [], []
    for i in np.flatnonzero(asking == 1):
        own = codes[at[i] : at[i + 1]]
        flags[own] = 1
        shared = np.add.reduceat(flags[codes], at[:-1])
        flags[own] = 0
        for j in np.flatnonzero(rule.linked(shared, lens, lens[i])).tolist():
            x, y = root(int(comp[i])), root(int(comp[j]))
            if x != y:
                parent[x] = y
                a.append(int(rid[i]))
                b.append(int(rid[j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) of undirected edges a, b; nodes without an edge are left out.

    Large-star and small-star steps in turn, each on a written table, until they change nothing.
    """
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    edges = written(edges.where("a <> b").select(lo.alias("v"), hi.alias("u")).distinct(), "edges")
    mark = None
    for _ in range(most):
        both = edges.unionAll(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        # large star: a node's larger neighbours are linked to the smallest of it and its neighbours
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("v"), F.col("v").alias("u")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours are linked to the smallest of these
        before, large = edges, written(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(low, "u")
        edges = rest.select(F.col("m").alias("v"), F.col("v").alias("u")).unionAll(rest.select(F.col("m").alias("v"), "u")).where("u <> v").distinct()
        edges = written(edges, "edges")
        forget(before, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now
    raise RuntimeError("components did not settle")


def join(docs: DataFrame, rule: Rule = JOIN) -> DataFrame:
    """doc_id, n_shingles, component_id of each document. All Python runs before this returns, on small Arrow batches."""
    with arrow_rows(docs.sparkSession, 1000):
        return _join(docs, rule)


def _join(docs: DataFrame, rule: Rule) -> DataFrame:
    tidy()  # what earlier stages have left in the driver
    counts, histogram = sketch(docs, rule)
    boundary, held = choose_boundary(histogram, rule, list_length(counts, rule)), docs.sparkSession.sparkContext.broadcast(counts)
    del counts
    first = written(posted(docs, held, boundary, rule), "posted")
    held.destroy()  # written tables don't need it again
    tidy()
    # names that stand for several sets: fewer than one is expected in a thousand million sets
    clashes = frozenset(r["rid"] for r in first.where("n > 0").groupBy("rid").agg(F.min("chk").alias("lo"), F.max("chk").alias("hi")).where("lo <> hi").select("rid").collect())
    rows = first
    if clashes:
        again = docs.sparkSession.createDataFrame([(r["rid"], r["chk"], named_apart(r["rid"], r["chk"])) for r in first.where(F.col("rid").isin(list(clashes))).select("rid", "chk").distinct().collect()], "rid long, chk long, other long")
        rows = first.join(F.broadcast(again), ["rid", "chk"], "left").withColumn("rid", F.coalesce("other", "rid"))
    all_docs = written(rows.select("doc_id", "n", "rid"), "documents")
    classes = written(all_docs.where("n > 0").groupBy("rid").agg(F.min("doc_id").alias("doc_id")), "classes")
    # one document posts for each class of equal sets; the others' postings are left out by a join on their ids alone
    copies = written(all_docs.where("n > 0").join(classes.withColumnRenamed("doc_id", "one"), "rid").where("not doc_id <=> one").select(F.col("doc_id").alias("d"), F.col("rid").alias("r")).distinct(), "copies")
    unique = rows.where("n > 0").join(large(copies), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("rid") == F.col("r")), "left_anti")
    tagged = lambda c, lead: F.transform(c, lambda e: F.struct(e.alias("e"), F.lit(lead).alias("lead")))
    posts = unique.select(F.explode(F.concat(tagged("posts", True), tagged("trail", False))).alias("x"), "rid", "n").select("x.e", "x.lead", "rid", "n")
    # a list in which no set leads holds no pair
    lists = written(posts.groupBy("e").agg(F.count("*").alias("size"), F.max("lead").alias("led")).where("size > 1 and led").drop("led"), "lists")
    members = written(posts.join(large(lists), "e"), "members")
    forget(first, copies, lists)
    pair = lambda x, y: F.struct(F.least(x["rid"], y["rid"]).alias("a"), F.greatest(x["rid"], y["rid"]).alias("b"))
    close = lambda x, y: F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * rule.percent
    # linked sets share a shingle that leads in the smaller of them, in both if they are of one size
    fits = lambda x, y: close(x, y) & (x["lead"] | (x["n"] > y["n"])) & (y["lead"] | (y["n"] > x["n"]))
    light = members.where(F.col("size") <= LIGHT).groupBy("e").agg(F.array_sort(F.collect_set(F.struct("rid", "n", "lead"))).alias("own")).select("own").distinct()
    inner = lambda x, i: F.transform(F.filter(F.slice("own", i + 2, LIGHT), lambda y: fits(x, y)), lambda y: pair(x, y))
    light = light.select(F.explode(F.flatten(F.transform("own", inner))).alias("p")).select("p.a", "p.b")
    heavy = members.where(F.col("size") > LIGHT).select("e", "rid").distinct()
    same = heavy.groupBy("e").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("rid")).alias("x"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("y"), *(F.min_by("rid", F.xxhash64("rid", F.lit(i + 2))).alias(f"pivot{i}") for i in range(PIVOTS)))
    pivots = [f"pivot{i}" for i in range(PIVOTS)]
    same = same.groupBy("size", "x", "y").agg(F.min("e").alias("e"), *(F.min(p).alias(p) for p in pivots)).select("e", "size", *pivots)
    heavy = written(heavy.join(same, "e"), "heavy")
    star = heavy.select(F.explode(F.array(*pivots)).alias("p"), "rid").where("p <> rid").select(F.least("p", "rid").alias("a"), F.greatest("p", "rid").alias("b"))
    pairs = written(light.unionAll(star).distinct(), "pairs")
    # whole sets, only of those that are compared; a class without any doc_id is found among all rows without one
    wanted = pairs.select(F.col("a").alias("rid")).unionAll(pairs.select("b")).unionAll(heavy.select("rid")).distinct()
    ids = written(classes.join(wanted, "rid", "left_semi").select(F.col("doc_id").alias("id")).distinct(), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(large(ids), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sets = written(sets_of(texts, rule, clashes), "sets")
    told = sets.agg(F.count("*").alias("n"), F.count_distinct("rid").alias("own")).collect()[0]
    once = sets if told["n"] == told["own"] else sets.dropDuplicates(["rid"])
    edges = written(verified(pairs, once, rule), "links")
    roots = components(edges)
    if heavy.limit(1).count():
        root = F.coalesce("root", "rid")
        placed = heavy.join(roots.withColumnRenamed("node", "rid"), "rid", "left").select("e", "rid", "size", "pivot0", root.alias("comp"))
        main = placed.where("rid = pivot0").select("e", F.col("comp").alias("main"))
        placed = written(placed.join(main, "e").withColumn("asking", (F.col("comp") != F.col("main")).cast("int")), "placed")
        asked = placed.where("asking = 1").groupBy("e").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("sheets"))
        both = placed.join(asked, "e").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        slot = lambda n: F.pmod(F.xxhash64("rid"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        asking = both.where("asking = 1").select("e", "rid", "comp", "asking", slot("sheets").alias("sheet"), every("blocks").alias("block"))
        others = both.select("e", "rid", "comp", F.lit(0).alias("asking"), every("sheets").alias("sheet"), slot("blocks").alias("block"))
        cells = written(asking.unionByName(others), "cells")
        more = large(cells).join(once, "rid").groupBy("e", "sheet", "block").applyInArrow(lambda group: joining(group, rule), "a long, b long")
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(more))
        forget(placed, cells)
    forget(members, heavy, pairs, ids, sets, edges)
    named = classes.select("rid", "doc_id").join(roots.withColumnRenamed("node", "rid"), "rid", "left").select("rid", F.coalesce("root", "rid").alias("root"), "doc_id")
    names = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(names, "root").select("rid", "component_id")
    return all_docs.select("doc_id", "n", "rid").join(named, "rid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, rule: Rule = NEAR) -> DataFrame:
    """docs, with their own columns, without documents whose component has a smaller doc_id. Rows of one doc_id are one
    document: they stay or go together. So are rows without a doc_id whose texts are equal; they come after all doc_ids (which
    must be less than 2 ** 62), so they go if a document with a doc_id is in their component."""
    own = own_id(docs)
    gone = written(join(docs.select(own.alias("doc_id"), "text"), rule).where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(large(gone), own == F.col("_gone"), "left_anti").select(*docs.columns)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


ORACLE = {
    "op3_jaccard": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
                               WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM (SELECT doc_id FROM d) d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id"""
}
