"""Operators 11 to 13 against brute force: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import negatives, repeats, spelling

DOC = "doc_id long, text string, lang string, n_words long, own long, t string, spans string"


def documents(spark, texts):
    """Rows with extra columns whose names clash with those of results and steps."""
    return spark.createDataFrame([(i, t, "en", -1, -1, "x", "y") for i, t in texts], DOC)


# -- substrings


def by_force(texts, window):
    """(n_words, kept words) of each text; texts: (doc_id, text), all with a doc_id."""
    first = {}
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in texts]
    for (i, _), w in zip(texts, words, strict=True):
        for a in range(len(w) - window + 1):
            key = tuple(w[a : a + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(texts, words, strict=True):
        gone = set()
        for a in range(len(w) - window + 1):
            if first[tuple(w[a : a + window])] < i:
                gone.update(range(a, a + window))
        out.append((len(w), [x for j, x in enumerate(w) if j not in gone]))
    return out


def corpus(seed, n):
    """Random texts that share passages, copies, near copies, loops of one word, and passages repeated inside."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(1, 7)))
    shared = [[word() for _ in range(rng.integers(30, 200))] for _ in range(6)]
    texts = []
    for i in range(n):
        words = [word() for _ in range(rng.integers(0, 120))]
        for _ in range(rng.integers(0, 3)):
            p = shared[rng.integers(len(shared))]
            a, b = sorted(rng.integers(0, len(p) + 1, 2))
            at = rng.integers(0, len(words) + 1)
            words[at:at] = p[a:b]
        if i % 5 == 4:
            words = re.findall(r"\S+", texts[rng.integers(len(texts))][1] or "")
            if i % 2 and words:
                words[rng.integers(len(words))] = "edited"
        sep = [" ", "\n", "\t ", "  "]
        texts.append((i + 10, "".join(w + sep[rng.integers(4)] for w in words)))
    texts += [(500, None), (501, ""), (502, " \n\t"), (503, "x " * 300), (504, "x " * 200 + "y"), (505, "x " * 49), (3, "z" * 9000 + " " + texts[0][1]), (506, texts[0][1] + " " + "z" * 9000)]
    inner = " ".join(shared[0][:60])
    return [*texts, (507, f"{inner} between {inner}"), (508, "new " + inner), (508, "new " + inner), (508, "other text of one id " + inner)]


@pytest.mark.parametrize("window", [50, 3])
def test_substrings(spark, window):
    texts = corpus(7 + window, 60)
    want = Counter((i, n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()) for (i, _), (n, kept) in zip(texts, by_force(texts, window), strict=True))
    docs = documents(spark, texts)
    assert any(n for _, _, n, _ in want)
    got = repeats.removals(docs, window)
    assert Counter((r["own"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()) == want
    kept = repeats.without_repeats(docs, window)
    assert kept.columns == docs.columns
    for r, n in Counter((r["doc_id"], r["text"]) for r in kept.collect()).items():
        options = [(t, k) for (i, t), k in zip(texts, by_force(texts, window), strict=True) if i == r[0]]
        assert n == sum(r[1] == (t if len(k[1]) == k[0] else " ".join(k[1])) for t, k in options)


def test_substrings_without_ids_and_empty(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    got = {(r["own"] < 1 << 62, r["n_removed"]) for r in repeats.removals(documents(spark, [(None, "a " + passage), (9, passage), (None, None)])).collect()}
    assert got == {(True, 0), (False, 60), (False, 0)}  # rows without a doc_id come last
    assert repeats.removals(documents(spark, [])).count() == 0
    assert repeats.without_repeats(documents(spark, [])).columns == documents(spark, []).columns


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    for width in (1, 2, 7, 35, 200):
        assert repeats.sliding_min(x, width).tolist() == [min(x[i : i + width]) for i in range(200 - width + 1)]


# -- spelling


def counted_by_force(texts):
    total = Counter()
    for i, t in texts:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def edits(w):
    every = sorted(set("abcdefghijklmnopqrstuvwxyz") | {chr(c) for c in range(0xC0, 0x100)})
    near = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in every} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in every}
    return near - {w}


def grouped_by_force(words):
    form, near = {}, {}
    for w, n in words.items():
        own = [x for x in edits(w) if x in words]
        near[w] = len(own)
        top = min(own, key=lambda x: (-words[x], x), default=None)
        form[w] = top if top and words[top] >= 2 * n else None
    rows = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, near[w], words[form[w]] if form[w] else None))
    return rows


def misspelled(seed, n):
    rng = np.random.default_rng(seed)
    letter = lambda: str(rng.choice(list("abcdeéÀz")))
    words = ["".join(letter() for _ in range(rng.integers(4, 9))) for _ in range(40)]
    for _ in range(n):
        w = words[rng.integers(len(words))]
        i = int(rng.integers(len(w)))
        words.append([w[:i] + w[i + 1 :], w[:i] + letter() + w[i:], w[:i] + letter() + w[i + 1 :], w[:i] + w[i:][::-1]][rng.integers(4)])
    return words


@pytest.mark.parametrize("cell", [40_000, 12])
def test_spelling(spark, cell, monkeypatch):
    monkeypatch.setattr(spelling, "CELL", cell)  # small cells: cut by upper trees, then dealt into slices
    rng = np.random.default_rng(5)
    words = misspelled(3, 250) + ["aabba", "ababa", "baaba"]
    texts = [(int(i), " ".join(str(w).capitalize() if k % 3 else str(w) for k, w in enumerate(rng.choice(words, 60)))) for i in range(400)]
    texts += [(7, "ab-cd 12, Äußerung äußerung ÄUßERUNG"), (8, None), (9, ""), (None, "Hello hello hello, hellos hellos hellos hellos hellos hellos"), (10, "w" * 3000 + " " + "w" * 3000 + " " + "w" * 3000 + "; " + ("w" * 2999 + " ") * 6), (10, "twice twice"), (10, "twice twice")]
    want = grouped_by_force(counted_by_force(texts))
    got = spelling.variants(spelling.counted(documents(spark, texts)))
    rows = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert any(r[2] != r[1] and r[1] for r in want), "chains are wanted"
    assert spelling.variants(spelling.counted(documents(spark, []))).count() == 0


def test_tree_finds_all_within_distance():
    rng = np.random.default_rng(2)
    for length, other, radius in ((6, 6, 2), (6, 7, 1), (7, 6, 1)):
        words = lambda n, size: ["".join(rng.choice(list("abcdef"), size)) for _ in range(n)]
        points, asking = spelling.letters(words(500, length), length), spelling.letters(words(200, other), other)
        x, q = spelling.counts_of(points), spelling.counts_of(asking)
        got = {(a, b) for s, p in spelling.Tree(x).search(x, q, np.arange(len(q)), radius) for a, b in zip(s.tolist(), p.tolist(), strict=True)}
        assert got == set(zip(*(v.tolist() for v in np.nonzero(np.abs(q[:, None].astype(int) - x[None]).sum(2) == radius)), strict=True))
        upper = spelling.Upper(x, 1.0, 40)
        of = {int(r): c for rows, c in upper.reached(x, np.arange(len(x)), 0) for r in rows}
        assert len(of) == len(x) and len(set(of.values())) > 3
        reached = {(int(r), c) for rows, c in upper.reached(q, np.arange(len(q)), radius) for r in rows}
        assert all((a, of[b]) in reached for a, b in got)


# -- hard negatives


def mined_by_force(rows, every=100):
    """rows: (vec_id, label, list) of distinct usable vec_ids."""
    q = {i: (lab, [int(np.floor(256 * float(x))) for x in v]) for i, lab, v in rows}
    out = set()
    for a, (label, own) in q.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(own, v, strict=True)), i, lab) for i, (lab, v) in q.items() if i != a and len(v) == len(own))
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            good = [(i, -n) for n, i, lab in scored if lab != label and 30 * -s <= 100 * -n <= 90 * -s]
            out |= {(a, p, r + 1, i, -s, n) for r, (i, n) in enumerate(good[:10])}
    return out


def vectors(seed, n, dim, kind):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    if kind == "clustered":
        v = v[rng.integers(0, 12, n)] + 0.3 * v
    if kind == "uneven":
        v *= rng.lognormal(0, 1.5, (n, 1))
    if kind == "large":
        v = np.abs(v) * 1e6
    if kind == "common":
        v[::3] = v[0]
    return [(i * 10, int(rng.integers(0, 4)), [float(x) for x in r]) for i, r in enumerate(v)]


COLUMNS = "vec_id long, label int, embedding array<double>, score double, norm string, q string"


def embedded(spark, rows):
    return spark.createDataFrame([(*r, 0.0, "x", "y") for r in rows], COLUMNS)


def got_of(df):
    return [tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect()]


@pytest.mark.parametrize("kind", ["random", "clustered", "uneven", "large", "common"])
def test_hard_negatives(spark, kind, monkeypatch):
    rows = vectors(4, 400, 12, kind)
    want = mined_by_force(rows)
    df = embedded(spark, rows)
    got = got_of(negatives.negatives(df))
    assert want and len(got) == len(want) and set(got) == want
    if kind == "clustered":
        monkeypatch.setattr(negatives, "ANCHORS", 7)  # several sheets
        monkeypatch.setattr(negatives, "SHARE", 3)  # and a first search of some tasks
        assert set(got_of(negatives.negatives(df.repartition(8)))) == want


def test_hard_negatives_corners(spark):
    rows = vectors(9, 150, 6, "random")
    odd = [(2000, None, [1.0] * 6), (2010, 1, None), (2020, 1, []), (2030, 1, [float("nan")] * 6), (2040, 1, [None] * 6), (2050, 1, [float("inf")] * 6), (None, 1, [1.0] * 6), (2060, 1, [1e300] * 6)]
    fits = [(2100, 2, [0.0] * 6), (3000, 2, [0.001] * 6), (3100, 1, [1.0, 2.0]), (3110, 1, [2.0, 3.0]), (3120, 2, [0.5, 1.5]), (3200, 1, [-1.0] * 6), (3300, 1, [1e12] * 6)]
    want = mined_by_force(rows + fits)
    got = got_of(negatives.negatives(embedded(spark, rows + odd + fits + rows[:20] * 2)))
    top = 2**63 - 1
    assert len(got) == len(want) and set(got) == {(*r[:4], min(r[4], top), min(r[5], top)) for r in want}
    assert negatives.negatives(embedded(spark, [])).count() == 0
    assert negatives.negatives(embedded(spark, rows[1:5])).count() == 0  # no anchor
    assert negatives.negatives(embedded(spark, rows[:1])).count() == 0  # nothing else


def test_bounds_hold_every_score():
    rng = np.random.default_rng(3)
    for scale in (0.01, 1.0, 1000.0):
        v = np.floor(256 * scale * np.concatenate([rng.normal(size=(300, 16)), np.eye(16), -np.eye(16), np.zeros((2, 16))])).astype(np.int64)
        norm = np.sqrt((v.astype(float) ** 2).sum(1))
        refs = negatives.references([(16, r) for r in negatives.packed(v)])[16]
        own = negatives.angles(v.astype(float), norm, refs)
        block = negatives.Block(negatives.Rows(np.arange(len(v)), rng.integers(0, 3, len(v)), v, norm, own))
        for i in range(0, len(v), 7):
            scores = v @ v[i]
            low, high = negatives.bounds(own[i], norm[i], own, own, norm, norm)
            assert (low <= scores).all() and (scores <= high).all()
            low, high = negatives.bounds(own[i], norm[i], block.lo, block.hi, block.least, block.most)
            for t, (a, b) in enumerate(zip(block.start, block.end, strict=True)):
                inside = scores[block.rows.ids[a:b]]
                assert low[t] <= inside.min() and inside.max() <= high[t] and (block.rows.labels[a:b] == block.label[t]).all()


def test_pruning_leaves_most_rows_out():
    """On clustered vectors few rows are scored."""
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(40, 32))
    v = np.floor(256 * (centre[rng.integers(0, 40, 4000)] + 0.05 * rng.normal(size=(4000, 32)))).astype(np.int64)
    norm = np.sqrt((v.astype(float) ** 2).sum(1))
    refs = negatives.references([(32, r) for r in negatives.packed(v[:500])])[32]
    rows = negatives.Rows(np.arange(len(v)), np.zeros(len(v), np.int64), v, norm, negatives.angles(v.astype(float), norm, refs))
    block, seen = negatives.Block(rows), []
    block.scores = lambda at, q, f=block.scores: seen.append(len(at)) or f(at, q)
    for i in range(0, 4000, 100):
        held = [negatives.NONE]
        negatives.mined(block, rows, i, True, held, [(-(2**62), 2**62)], 5)
        s = np.delete(v @ v[i], i)
        assert held[0][1].tolist() == sorted(s.tolist(), reverse=True)[:5]
    assert sum(seen) < 0.35 * 40 * 4000


def test_queries_of_the_round(spark):
    from folio.llm.queries import ORACLE, QUERIES

    for name in ("op11_spelling", "op12_substrings", "op13_hard_negatives"):
        assert name in ORACLE
        assert QUERIES[name](spark, "/root/testdata/sf0.001").where(F.lit(True)).count() > 0
