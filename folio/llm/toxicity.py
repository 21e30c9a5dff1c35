"""Toxicity by a learned lexicon, matched up to a misspelling.

The lexicon holds whole words and word stems (prefixes of any length) that labelled toxic texts have and clean ones don't. It is
learned from at most SAMPLE_TOXIC and SAMPLE_CLEAN labelled documents (smallest hash of the id) and holds no other limit. A
feature counts once for a group of copies (texts whose smallest word hash is the same), and must tell toxic texts from clean
ones in both halves of the groups, each judged on its own, so words that only a few copies or one half have are left out; a greedy
cover then takes features while each adds enough texts (at most 4 / GAIN of them can). Its whole words form a trie; the
Levenshtein automaton of one edit (for words of FUZZY letters or more) is intersected with that trie, and the result, together
with the stems, becomes one deterministic table of states by letters. Texts run through that table word by word, all words of a
batch side by side, and only words that are accepted are looked at again: a hit inside quotation marks, or with a reporting cue
within WINDOW words before it, counts by a learned factor instead of in full.

Words are runs of letters. Digits and signs that stand for letters count as these inside a word or at its start (1d10t), and
single letters with one mark between them are also read as one word (s.c.u.m).

Score: sigmoid(prior + sum over distinct terms of weight * context factor). Weights are smoothed log-odds of a term being
hit once, twice, or OFTEN times and more. Those of misspelled hits are log-odds too, of one-edit forms of the term in toxic and
clean training texts, with SLIPS of the term's toxic texts as the expectation before any are seen.

Cases: null or empty text has no hits and gets the prior's score; ties in the lexicon's choice go to whole words, shorter words and longer stems, then the
alphabetically first feature; a word near several terms counts for the nearest, then the first; repeated rows give repeated
rows; of several labels of one id the larger counts, of several texts the one of smallest hash; rows without an id are never
learned from; no labelled row: an empty lexicon and score 0; an empty table gives an empty table; only doc_id and text are scored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import chunks, code_points, letters, remainder, table, tidy

SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 3000
#: Groups of toxic texts that hold a feature, at least; share of the toxic texts that a further term must add.
LEAST, GAIN = 4, 0.01
#: How many times more often toxic texts hold it: over all, and in each half.
RATIO, HALF_RATIO = 10.0, 4.0
#: Words of so many letters or more may be misspelled by one edit.
FUZZY = 5
SHORTEST_STEM = 3
#: Hits of a term in a text are told apart up to this many.
OFTEN = 3
SLIPS = 0.05
WINDOW = 6
#: Reporting cues that mark a quotation, in the languages of the documents.
CUES = frozenset("said says wrote called quoted quote quotes reported dit disait écrit cité selon dijo dice escribió citó según sagte sagt schrieb zitiert laut".split())
QUOTES = np.array([ord(c) for c in '"«»“”„'], np.uint32)
#: Signs that stand for letters, and marks between spelled-out letters.
SIGNS = dict(zip("013457@$", "oieastas", strict=True))
MARKS = np.array([ord(c) for c in ".-_*·"], np.uint32)
CUT = 0.7


def words_of(cps: np.ndarray):
    """Start and end of every word in the lower-cased letters, the letters, and where the word stands in the text."""
    low = letters()[cps]
    hard = low > 0
    sign = np.isin(cps, [ord(c) for c in SIGNS])
    if sign.any():
        pad = lambda x, k: np.concatenate((np.zeros(max(-k, 0), bool), x[max(k, 0) : len(x) + min(k, 0)], np.zeros(max(k, 0), bool)))
        long = (pad(sign, -1) & pad(sign, -2)) | (pad(sign, -1) & pad(sign, 1)) | (pad(sign, 1) & pad(sign, 2))
        stands = sign & ~long & (pad(hard, 1) | (pad(sign, 1) & pad(hard, 2)))
        low = low.copy()
        for c, letter in SIGNS.items():
            low[stands & (cps == ord(c))] = ord(letter)
    edge = np.diff(np.concatenate(([0], (low > 0).astype(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # single letters with one mark between them
    single = end - start == 1
    joint = single[:-1] & single[1:] & (start[1:] - end[:-1] == 1) if len(start) > 2 else np.zeros(0, bool)
    if joint.any():
        joint[joint] = np.isin(cps[end[:-1][joint]], MARKS)
    if not (joint[:-1] & joint[1:]).any():
        return start, end, low, start, end
    runs = np.diff(np.concatenate(([0], joint.astype(np.int8), [0])))
    first, last = np.flatnonzero(runs == 1), np.flatnonzero(runs == -1)
    spelled = [(int(a), int(b)) for a, b in zip(first, last, strict=True) if b - a >= 2]
    more = [low[start[a : b + 1]] for a, b in spelled]
    ends = len(low) + np.cumsum([len(x) for x in more])
    begins = ends - [len(x) for x in more]
    at, to = np.concatenate((start, [start[a] for a, _ in spelled])), np.concatenate((end, [end[b] for _, b in spelled]))
    order = np.argsort(at, kind="stable")
    return np.concatenate((start, begins))[order], np.concatenate((end, ends))[order], np.concatenate((low, *more)), at[order], to[order]


class Automaton:
    """Union of the one-edit automaton of the words (exact for short ones) over their trie, and of the stems.

    table: state x letter class; classes: sorted code points, class 0 is any other letter; accept: state to
    term * 2 + (1 if misspelled), or -1; state 0 is dead.
    """

    def __init__(self, words: list[str], stems: list[str]):
        self.terms = [*words, *stems]
        kids: list[dict[int, int]] = []
        ends: list[int] = []

        def insert(root: int, word: str, term: int) -> None:
            for ch in word:
                if ord(ch) not in kids[root]:
                    kids[root][ord(ch)] = new()
                root = kids[root][ord(ch)]
            ends[root] = term

        def new() -> int:
            kids.append({})
            ends.append(-1)
            return len(kids) - 1

        exact, fuzzy, stem = new(), new(), new()
        for i, w in enumerate(words):
            insert(fuzzy if len(w) >= FUZZY else exact, w, i)
        for i, w in enumerate(stems):
            insert(stem, w, len(words) + i)
        self.reach = max((len(w) + 1 for w in words), default=0)
        self.reach = max(self.reach, max(map(len, stems), default=0))
        alphabet = sorted({c for k in kids for c in k})
        # NFA state: (node, edits, kind); kind 0 exact, 1 fuzzy, 2 stem, 3 a stem was read (whatever follows)
        def close(states: set) -> frozenset:
            out = set(states)
            for node, e, kind in states:
                if kind == 1 and e == 0:
                    out.update((k, 1, 1) for k in kids[node].values())
            best: dict[tuple, int] = {}
            for node, e, kind in out:
                best[node, kind] = min(e, best.get((node, kind), 9))
            return frozenset((node, e, kind) for (node, kind), e in best.items())

        def step(states: frozenset, c: int | None) -> frozenset:
            out = set()
            for node, e, kind in states:
                if kind == 3:
                    out.add((node, e, 3))
                    continue
                if c in kids[node]:
                    k = kids[node][c]
                    out.add((k, e, 3 if kind == 2 and ends[k] >= 0 else kind))
                if kind == 1 and e == 0:
                    out.add((node, 1, 1))
                    out.update((k, 1, 1) for x, k in kids[node].items() if x != c)
            return close(out)

        def accepted(states: frozenset) -> int:
            found = [(e, ends[node]) for node, e, kind in states if kind != 2 and ends[node] >= 0]
            if not found:
                return -1
            e, term = min(found)
            return term * 2 + e

        start = close({(exact, 0, 0), (fuzzy, 0, 1), (stem, 0, 2)})
        index, todo, rows, accept = {frozenset(): 0, start: 1}, [start], [[0] * (len(alphabet) + 1), None], [-1, accepted(start)]
        while todo:
            s = todo.pop()
            row = []
            for c in (None, *alphabet):
                t = step(s, c)
                if t not in index:
                    index[t] = len(rows)
                    rows.append(None)
                    accept.append(accepted(t))
                    todo.append(t)
                row.append(index[t])
            rows[index[s]] = row
        self.alphabet = np.array(alphabet, np.uint32)
        self.table = np.array(rows, np.int32)
        self.accept = np.array(accept, np.int32)

    def run(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each word term * 2 + misspelled, or -1."""
        out = np.full(len(start), -1, np.int32)
        if not self.terms:
            return out
        cls = np.zeros(0x110000, np.int16)
        cls[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        who, state, length = np.arange(len(start)), np.ones(len(start), np.int32), end - start
        for j in range(self.reach + 1):
            done = length[who] == j
            if done.any():
                out[who[done]] = self.accept[state[done]]
                who, state = who[~done], state[~done]
            if j == self.reach or not len(who):
                break
            state = self.table[state, cls[low[start[who] + j]]]
            live = state > 0
            who, state = who[live], state[live]
        # longer words than any term: only a stem that has been read accepts them
        stem = self.accept[state] if len(who) else np.zeros(0, np.int32)
        absorbed = len(who) and (self.table[state] == state[:, None]).all(1)
        if len(who):
            out[who] = np.where(absorbed, stem, -1)
        return out


class ToxicityModel:
    def __init__(self, automaton: Automaton, prior: float, exact: np.ndarray, fuzzy: np.ndarray, quoted: float):
        self.automaton, self.prior, self.exact, self.fuzzy, self.quoted = automaton, prior, exact, fuzzy, quoted

    def hits(self, texts: list[str]):
        """For each text: (term, misspelled, start, end, quoted) of each hit, offsets in code points."""
        for a, b in chunks(texts, 1_000_000):
            cps, at = code_points(texts[a:b])
            start, end, low, left, right = words_of(cps)
            found = self.automaton.run(low, start, end)
            hit = np.flatnonzero(found >= 0)
            owner = np.searchsorted(at, left[hit], "right") - 1
            marks = np.cumsum(np.isin(cps, QUOTES)) if len(hit) else cps
            rows: list[list[tuple]] = [[] for _ in range(b - a)]
            for i, doc in zip(hit.tolist(), owner.tolist(), strict=True):
                base = int(at[doc])
                before = int(marks[left[i]] - (marks[base - 1] if base else 0))
                after = int(marks[at[doc + 1] - 1] - marks[right[i] - 1])
                said = any("".join(map(chr, low[start[w] : end[w]].tolist())) in CUES for w in range(max(i - WINDOW, 0), i) if left[w] >= base)
                rows[doc].append((int(found[i]) >> 1, int(found[i]) & 1, int(left[i]) - base, int(right[i]) - base, bool(before % 2 and after) or said))
            yield from rows

    def score(self, hits: list[tuple]) -> float:
        found: dict[tuple[int, int], list[bool]] = {}
        for term, misspelled, _, _, quoted in hits:
            found.setdefault((term, misspelled), []).append(quoted)
        best: dict[int, float] = {}
        for (term, misspelled), quoted in found.items():
            w = self.fuzzy[term] if misspelled else self.exact[term, min(len(quoted), OFTEN)]
            best[term] = max(best.get(term, 0.0), float(w) * (self.quoted if all(quoted) else 1.0))
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, self.prior + sum(best[t] for t in sorted(best))))))


def features(text: str) -> tuple[set[str], int]:
    """Whole words, and stems of longer words: marked by a star, and by two if two words or more of the text have it. And the
    text's group of copies."""
    cps = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    start, end, low, _, _ = words_of(cps)
    joined = low.tobytes().decode("utf-32-le", "replace")
    words = Counter(joined[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True) if 3 <= e - s)
    stems: Counter = Counter()
    for w, n in words.items():
        for k in range(SHORTEST_STEM, len(w)):
            stems[w[:k]] += n
    group = min((zlib.crc32(w.encode("utf-8", "replace")) for w in words), default=0)
    return set(words) | {w + "*" for w in stems} | {w + "**" for w, n in stems.items() if n > 1}, group


def telling(toxic: np.ndarray, clean: np.ndarray, n_toxic: np.ndarray, n_clean: np.ndarray) -> bool:
    """Whether a feature's counts in both halves tell toxic texts from clean ones."""
    rate = lambda x, n: (x + 0.5) / (n + 1)
    return bool(rate(toxic.sum(), n_toxic.sum()) >= RATIO * rate(clean.sum(), n_clean.sum()) and (toxic > 0).all() and (rate(toxic, n_toxic) >= HALF_RATIO * rate(clean, n_clean)).all())


def fit(docs: DataFrame, labels: DataFrame, n_toxic: int = SAMPLE_TOXIC, n_clean: int = SAMPLE_CLEAN) -> ToxicityModel:
    """docs, labels: the rows to learn from. Features are counted on the executors; the driver gets those of the bounded sample."""
    spark = docs.sparkSession
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("_y"))
    base = known.agg(F.coalesce(F.avg("_y"), F.lit(0.0)).alias("m")).collect()[0]["m"]
    pick = lambda y, n: known.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    ids = pick(1, n_toxic).unionAll(pick(0, n_clean))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "_y").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("x")).select(F.col("x.text").alias("text"), F.col("_y").alias("y"))

    def of_toxic(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                fs, group = features(text)
                yield pa.RecordBatch.from_arrays([pa.array(sorted(fs), pa.string()), pa.array([group] * len(fs), pa.int64())], ["f", "g"])

    half = lambda k: F.count_if(F.pmod("g", F.lit(2)) == k)
    often = rows.where("y = 1").select("text").mapInArrow(of_toxic, "f string, g long").distinct().groupBy("f").agg(half(0).alias("a"), half(1).alias("b")).where(f"a > 0 and b > 0 and a + b >= {LEAST}").collect()
    toxic = {r["f"]: np.array([r["a"], r["b"]]) for r in often}
    wanted = spark.sparkContext.broadcast(frozenset(toxic))

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, group = features(text)
                seen[f"= {y} {group}", group % 2] += 1
                if y == 0:
                    seen.update((f, group % 2) for f in fs & wanted.value)
        both = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in both], pa.string()), pa.array([k[1] for k in both], pa.int64()), pa.array([seen[k] for k in both], pa.int64())], ["f", "half", "n"])

    clean: dict[str, np.ndarray] = {}
    texts, groups = np.zeros((2, 2)), np.zeros((2, 2))
    for r in rows.mapInArrow(count, "f string, half long, n long").groupBy("f", "half").agg(F.sum("n").alias("n")).collect():
        if r["f"].startswith("= "):
            texts[int(r["f"][2]), r["half"]] += r["n"]
            groups[int(r["f"][2]), r["half"]] += 1
        else:
            clean.setdefault(r["f"], np.zeros(2))[r["half"]] = r["n"]
    n1, n0 = texts[1].sum(), texts[0].sum()
    none = np.zeros(2)
    stats = {f: (int(t.sum()), int(clean.get(f, none).sum())) for f, t in toxic.items() if telling(t, clean.get(f, none), groups[1], texts[0])}
    good = spark.sparkContext.broadcast(frozenset(stats))

    def incidence(batches):
        for batch in batches:
            out = [sorted(features(t)[0] & good.value) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], ["fs"])

    has = [set(r["fs"]) for r in rows.where("y = 1").select("text").mapInArrow(incidence, "fs array<string>").collect()] if stats else []
    chosen = cover(has, stats, n1 / max(n0, 1))
    words, stems = sorted(f for f in chosen if not f.endswith("*")), sorted(f.rstrip("*") for f in chosen if f.endswith("*"))
    automaton = Automaton(words, stems)
    probe = ToxicityModel(automaton, 0.0, np.zeros((len(automaton.terms), OFTEN + 1)), np.zeros(len(automaton.terms)), 1.0)
    held = spark.sparkContext.broadcast(probe)

    def observe(batches):
        tally: Counter = Counter()
        for batch in batches:
            for hits, y in zip(held.value.hits(batch.column(0).to_pylist()), batch.column(1).to_pylist(), strict=True):
                for (term, miss), n in Counter((h[0], h[1]) for h in hits).items():
                    tally[term, miss, min(n, OFTEN), y] += 1
                if hits and all(h[4] for h in hits):
                    tally[-2, 0, 0, y] += 1
        out = [(*k, n) for k, n in sorted(tally.items())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], ["term", "miss", "times", "y", "n"])

    told = rows.mapInArrow(observe, "term long, miss long, times long, y long, n long").groupBy("term", "miss", "times", "y").agg(F.sum("n").alias("n")).collect()
    seen = {(r["term"], r["miss"], r["times"], r["y"]): r["n"] for r in told}
    k = len(automaton.terms)
    exact, fuzzy = np.zeros((k, OFTEN + 1)), np.zeros(k)
    odds = lambda a, b: math.log(a / (n1 + 1)) - math.log(b / (n0 + 1))
    for t in range(k):
        for times in range(1, OFTEN + 1):
            w = odds(seen.get((t, 0, times, 1), 0) + 0.5, seen.get((t, 0, times, 0), 0) + 0.5)
            exact[t, times] = min(6.0, max(exact[t, times - 1], w))
        total = lambda miss, y: sum(seen.get((t, miss, times, y), 0) for times in range(1, OFTEN + 1))  # noqa: B023, E731
        fuzzy[t] = min(exact[t, 1], max(0.0, odds(total(1, 1) + SLIPS * total(0, 1) + 0.5, total(1, 0) + 0.5)))
    quoted = (seen.get((-2, 0, 0, 1), 0) + 1) / (seen.get((-2, 0, 0, 1), 0) + seen.get((-2, 0, 0, 0), 0) + 2)
    prior = math.log(max(base, 1e-3) / max(1 - base, 1e-3)) if n1 else -30.0
    return ToxicityModel(automaton, prior, exact, fuzzy, quoted)


def cover(has: list[set[str]], stats: dict[str, tuple[int, int]], rate: float, times: int = 4) -> list[str]:
    """Features chosen greedily until every text holds `times` of them, or no feature adds enough texts.

    A feature gains a text for each that it is in and that is covered fewer than `times` times, and loses four for each
    that its rate in clean texts makes likely. Of one family (a word, its stems) only one is chosen.
    """
    where: dict[str, list[int]] = {f: [] for f in stats}
    for i, fs in enumerate(has):
        for f in fs:
            where[f].append(i)
    left, chosen = [times] * len(has), []
    least = max(3, GAIN * len(has))
    while True:
        best, best_key = None, None
        for f, docs in where.items():
            gain = sum(1 for d in docs if left[d] > 0) - 4 * rate * stats[f][1]
            key = (-gain, f.count("*"), -len(f) if "*" in f else len(f), f)
            if gain >= least and (best_key is None or key < best_key):
                best, best_key = f, key
        if best is None:
            return chosen
        chosen.append(best)
        for d in where[best]:
            left[d] -= 1
        stem = best.rstrip("*")
        family = lambda f: f.rstrip("*").startswith(stem) or (stem.startswith(f.rstrip("*")) and f.endswith("*"))  # noqa: B023, E731
        where = {f: docs for f, docs in where.items() if not family(f)}


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, n_hits, spans (term:start:end, comma-joined) of each whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            m = held.value
            out = [(m.score(h), len(h), ",".join(f"{m.automaton.terms[x[0]]}:{x[2]}:{x[3]}" for x in h)) for h in m.hits([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in out], t) for i, t in enumerate((pa.float64(), pa.int64(), pa.string())))], ["doc_id", "score", "n_hits", "spans"])
        tidy()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, n_hits long, spans string")


def learn_from(df: DataFrame) -> DataFrame:
    """The rows that models may learn from."""
    return df.where(remainder("doc_id", 3) != 1)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(learn_from(docs), learn_from(table(spark, sf_dir, "labels"))))
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "n_hits", "spans")
