"""Lexer, lexical search, the grid of retrieval runs, and intake of answers, against plain Python."""

import json
import math
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.functions import lexer as L
from folio.functions import text as T
from folio.operators import grid as G
from folio.operators import intake as I
from folio.operators import search as S

#: Words and stems of the stemmer's published sample, and others of its definition.
SAMPLE = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist
consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol
consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort consorted consort
consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir
conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag
knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt
knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob
knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot asheville ashevill baseball basebal purchased purchas
purchases purchas ashevill ashevil purchas purcha skies sky dying die generate generat generously generous communism communism hopping hop hoping hope fizzed fizz sized size
agreed agre feed feed ties tie cries cri gas gas this this kiwis kiwi happy happi say say by by cry cri proceed proceed herrings herring relational relat rational ration
able abl university univers yes yes youth youth stores store controlled control rolling roll adoption adopt analogies analog vitalities vital hopefulness hope national nation
electrical electr sky sky news news at at""".split()


def test_stems(spark):
    pairs = list(zip(SAMPLE[::2], SAMPLE[1::2], strict=True))
    got = spark.createDataFrame(pairs, "w string, s string").withColumn("g", L.stem(F.col("w"))).collect()
    assert [(r["w"], r["g"]) for r in got] == pairs


def test_lexemes(spark):
    texts = [(1, "Where did I buy the Stores, 425.58 and B2B's purchases?"), (2, None), (3, "the and of"), (4, "Éclairs naïve ÉTÉ")]
    got = {r["id"]: [tuple(x) for x in r["l"]] for r in spark.createDataFrame(texts, "id int, t string").select("id", L.lexemes(F.col("t")).alias("l")).collect()}
    assert got[1] == [(4, "buy"), (6, "store"), (7, "425.58"), (9, "b2b"), (11, "purchas")]
    assert got[2] == got[3] == [] and [w for _, w in got[4]] == ["éclair", "naïv", "été"]


def covers(postings, need):
    """Cover density by trying every interval."""
    whole = [(a, b) for a in range(len(postings)) for b in range(a, len(postings)) if len({w for _, w in postings[a : b + 1]}) >= need]
    least = [(a, b) for a, b in whole if not any((c, d) != (a, b) and a <= c and d <= b for c, d in whole)]
    total = 0.0
    for a, b in least:
        noise = (postings[b][0] - postings[a][0]) - (b - a)
        total += 0.1 / (1 + (noise if noise >= 0 else (b - a) / 2))
    return total


def test_cover_density_equals_all_intervals(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(120):
        at = sorted(rng.choice(40, int(rng.integers(0, 12)), replace=False).tolist())
        rows.append((i, int(rng.integers(1, 4)), [(int(p), str(rng.choice(list("abc")))) for p in at]))
    df = spark.createDataFrame(rows, "i int, need int, p array<struct<pos:int,lexeme:string>>")
    got = {r["i"]: r["c"] for r in df.select("i", L.cover_density(F.col("p"), F.col("need")).alias("c")).collect()}
    for i, need, p in rows:
        assert got[i] == pytest.approx(covers(p, need), abs=1e-12)
    one = df.limit(1).select(L.cover_density(F.expr("array(struct(3 AS pos, 'a' AS lexeme))"), 1, F.lit(7)).alias("c")).first()["c"]
    assert one == pytest.approx(0.1 / (1 + math.log(7)))


CHUNKS = [
    (1, "Thistlewood Garden Center\n9 Meadow Rd, Asheville, NC\nPurchased: 2025-11-13"), (2, "Ridgeline Sports\nBaseball Cap  1  $14.00"), (3, "Cobblestone Bakery\nHerbal Tea Sampler  1  $8.05"),
    (4, "Lindenplatz Bakery\nTotal: 27,82 EUR"), (5, "Northgate Office Outfitters\nTotal: $1,234.56"), (6, None), (7, ""), (8, "store stores stored the store"), (9, "tea tea tea"),
]
ASKED = [(1, "purchases made in Asheville"), (2, "baseball"), (3, "27.82 euros"), (4, "1,234.56"), (5, "the and of"), (6, "storing"), (7, "herbal teas from a bakery"), (8, None), (9, "carolina")]


def lexical(spark, chunks, queries, scoring):
    """(id, score) lists by query, in plain Python over the lexemes of each text."""
    from folio.functions import normalize as N

    said = lambda df, c: {r["id"]: [tuple(x) for x in r["l"]] for r in df.select("id", L.lexemes(c).alias("l")).collect()}
    own = said(chunks, F.concat_ws(" ", "text", N.search_aliases(F.col("text"))))
    asked = said(queries.withColumnRenamed("query_id", "id"), N.normalized_query(F.col("text")))
    df = defaultdict(int)
    for ls in own.values():
        for w in {w for _, w in ls}:
            df[w] += 1
    idf = {w: math.log((len(own) - n + 0.5) / (n + 0.5) + 1) for w, n in df.items()}
    out = {}
    for q, terms in asked.items():
        terms, rows = {w for _, w in terms}, []
        for i, ls in own.items():
            hits = [(p, w) for p, w in ls if w in terms]
            if hits:
                cover = round(covers(hits, 1) / (1 + math.log(len(ls))), 9)
                weight = round(sum(idf[w] for w in sorted({w for _, w in hits})), 9)
                rows.append((-(weight if scoring == "idf" else cover), -cover, i))
        out[q] = [(i, -s) for s, _, i in sorted(rows)]
    return out


@pytest.mark.parametrize("scoring", ["idf", "cover"])
def test_scored_words(spark, scoring):
    chunks, queries = spark.createDataFrame(CHUNKS, "id long, text string"), spark.createDataFrame(ASKED, "query_id long, text string")
    got = defaultdict(list)
    for r in sorted(S.scored_words(chunks, queries, 3, scoring).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["id"], r["score"]))
    want = lexical(spark, chunks, queries, scoring)
    for q, rows in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in rows[:3]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in rows[:3]], abs=1e-8)
    assert {q: got[q][0][0] for q in (1, 2, 3, 4, 6, 9)} == {1: 1, 2: 2, 3: 4, 4: 5, 6: 8, 9: 1} and not got[5] and not got[8]
    assert S.scored_words(chunks.limit(0), queries, 3, scoring).count() == 0
    with pytest.raises(ValueError):
        S.scored_words(chunks, queries, 3, "best")


def metrics(ranked, relevant):
    hit = [d in relevant for d in ranked]
    ideal = sum(1 / math.log2(i + 2) for i in range(min(10, len(relevant))))
    return {**{f"recall_{k}": sum(hit[:k]) / len(relevant) for k in (1, 3, 5, 10)}, "mrr": next((1 / (i + 1) for i, h in enumerate(hit) if h), 0.0), "ndcg": sum(h / math.log2(i + 2) for i, h in enumerate(hit[:10])) / ideal}


def test_grid_equals_plain_python(spark):
    pages = [(d, p, "\n".join(f"{w} number {d * 7 % 5} {'store' if (d + i) % 3 else 'bakery'} total {d}.{i:02d}" for i, w in enumerate(["acme corp", "cap sports", "tea sampler", "garden"]))) for d in range(1, 9) for p in (1, 2)]
    pages += [(20, 1, None), (21, 1, "Asheville baseball cap, purchased twice")]
    pages_df = spark.createDataFrame(pages, "doc_id long, page int, text string")
    asked = [(1, "stores with acme 3.00"), (2, "baseball purchases"), (3, "the of"), (4, "bakery sampler total 5.02"), (5, "nobody asks")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    truth = {1: {3, 4}, 2: {21}, 3: {5}, 4: {5, 6, 7}}
    relevant = spark.createDataFrame([(q, d) for q, ds in truth.items() for d in ds], "query_id long, doc_id long")
    types = spark.createDataFrame([(q, "odd" if q % 2 else "even") for q, _ in asked], "query_id long, type string")
    found = G.hits(pages_df, queries, [(0, 0), (60, 20)], scorings=("idf", "cover"), model=64)
    per_query = G.scored(found, relevant)
    got = {(r["most"], r["mode"], r["scoring"], r["query_id"]): r for r in per_query.collect()}
    assert len(got) == 2 * 5 * 4
    for most, overlap in ((0, 0), (60, 20)):
        chunks = G.indexed(pages_df, most, overlap, 64).persist()
        rows = {r["id"]: r for r in chunks.collect()}
        v = {i: np.array(r["embedding"]) for i, r in rows.items()}
        dense = {}
        for q, text in asked:
            e = T.embed(text, 64)
            near = sorted((-round(float(e @ x), 9), i) for i, x in v.items())
            dense[q] = [i for s, i in near if s < 0][:50]
        for mode, scoring in (("dense", ""), ("lexical", "idf"), ("lexical", "cover"), ("hybrid", "idf"), ("hybrid", "cover")):
            words = {q: [i for i, _ in x][:50] for q, x in lexical(spark, chunks.select("id", "text"), queries, scoring).items()} if scoring else {}
            for q, _ in asked:
                if q not in truth:
                    continue
                order = dense[q] if mode == "dense" else words[q]
                if mode == "hybrid":
                    score, first = defaultdict(float), {}
                    for n, side in enumerate((dense[q], words[q])):
                        for r, i in enumerate(side, 1):
                            score[i] += 1 / (60 + r)
                            first.setdefault(i, (n, r))
                    order = sorted(score, key=lambda i: (-round(score[i], 12), first[i]))[:50]
                docs = list(dict.fromkeys(rows[i]["doc_id"] for i in order))
                row = got[most, mode, scoring, q]
                assert row["ranked"] == docs[:10], (most, mode, scoring, q)
                for name, value in metrics(docs, truth[q]).items():
                    assert row[name] == pytest.approx(value, abs=1e-12)
    summary = {(r["most"], r["mode"], r["scoring"], r["type"]): r for r in G.summary(found, per_query, types).collect()}
    for (most, mode, scoring, kind), r in summary.items():
        own = [x for (m, o, s, q), x in got.items() if (m, o, s) == (most, mode, scoring) and kind in (None, "odd" if q % 2 else "even")]
        assert r["n"] == len(own) and r["mrr"] == pytest.approx(sum(x["mrr"] for x in own) / len(own)) and r["integrity"] == 1.0
    worst = G.hardest(per_query, 2).where("most = 0 and mode = 'dense'").orderBy("place").collect()
    assert [(r["mrr"], r["query_id"]) for r in worst] == sorted((x["mrr"], x["query_id"]) for (m, o, _, _), x in got.items() if (m, o) == (0, "dense"))[:2]


# -- intake of answers

SCHEMA = {"vendor": None, "total": None, "payment_card_last4": None, "payment_method": None, "line_items": ("quantity", "total")}
ANSWERS = [
    None, "", "nope", "[]", "7", "{}", json.dumps({"vendor": {"value": 1, "confidence": 1}}),
    json.dumps({"vendor": "Acme", "total": {"value": None, "confidence": 0.2}, "payment_method": {"confidence": 1}, "line_items": {"value": [1, None, {"quantity": {"value": 2, "confidence": "0.5"}, "total": 3}, {}], "confidence": True}}),
    json.dumps({"vendor": {"value": "x", "confidence": " 1_0 ", "evidence": {"page": 3, "quote": " a "}}, "total": {"value": [], "confidence": "inf"}, "payment_card_last4": {"value": "4111 1111 1111 1234", "confidence": 7}, "payment_method": {"value": "VISA 4111 1111 1111 1111", "confidence": -1, "evidence": {"page": None, "quote": "card 4111 1111 1111 1111"}}, "line_items": {"value": "none", "confidence": 0}}),
    '{"vendor": {"value": "big", "confidence": 1e400}, "total": {"value": {"a": 1}, "confidence": "x", "evidence": 5}, "line_items": {"value": [], "confidence": null}}',
    json.dumps({"vendor": {"value": "q\"uo\nte é", "confidence": False, "evidence": {"page": True, "quote": "x"}}, "total": {"value": 5, "confidence": 1, "evidence": {"quote": "no page"}}, "payment_card_last4": {"value": 12, "confidence": 1}, "line_items": {"value": [{"quantity": {"value": "x" * 300, "confidence": 0.1, "evidence": {"page": 1, "quote": "y" * 201}}, "total": {"value": 1.5, "confidence": 1, "evidence": {"page": 2, "quote": "z"}}}] * 9, "confidence": 1}}),
]


def bad(leaf):
    if not isinstance(leaf, dict) or "value" not in leaf:
        return True
    try:
        return not math.isfinite(float(leaf.get("confidence")))
    except (TypeError, ValueError, OverflowError):
        return True


def parsed(text):
    try:
        v = json.loads(text)
    except (TypeError, ValueError):
        return {}
    return v if isinstance(v, dict) else {}


def test_violations_and_fields(spark):
    rows = spark.createDataFrame(list(enumerate(ANSWERS)), "id int, answer string")
    got = {r["id"]: (r["v"], r["s"]) for r in rows.select("id", I.violations(F.col("answer"), SCHEMA).alias("v"), I.listed(I.violations(F.col("answer"), SCHEMA), 4).alias("s")).collect()}
    stored = {(r["id"], r["field_name"]): r for r in I.fields(rows, "id", SCHEMA, 0.5).collect()}
    assert len(stored) == len(ANSWERS) * len(SCHEMA)
    for i, text in enumerate(ANSWERS):
        doc, want = parsed(text), []
        for name, cells in SCHEMA.items():
            leaf = doc.get(name)
            sure = 0.0 if bad(leaf) else min(1.0, max(0.0, float(leaf["confidence"])))
            row = stored[i, name]
            assert row["confidence"] == sure and row["needs_review"] == (sure < 0.5) and row["review_reason"] == ("confidence" if sure < 0.5 else None)
            value = json.loads(row["value"])
            items = leaf["value"] if cells and not bad(leaf) and isinstance(leaf["value"], list) else []
            if bad(leaf):
                want.append(name)
                assert value == ([] if cells else {"value": None, "confidence": 0.0, "evidence": None})
            elif cells:
                assert len(value) == len(items) and all(list(r) == list(cells) for r in value)
                for r, x in zip(value, items, strict=True):
                    for c in cells:
                        y = x.get(c) if isinstance(x, dict) else None
                        assert r[c]["value"] == (None if bad(y) else y["value"])
            elif name in ("vendor", "total"):
                assert value["value"] == leaf["value"]
            for k, x in enumerate(items):
                want += [f"{name}.value[{k}].{c}" for c in cells if bad(x.get(c) if isinstance(x, dict) else None)]
        assert got[i][0] == want
        lines = [f"- {w}" for w in want[:4]] + ([f"- … ({len(want) - 4} more)"] if len(want) > 4 else [])
        assert got[i][1] == "\n".join(lines)
    leaf = lambda i, name: json.loads(stored[i, name]["value"])
    assert leaf(8, "vendor")["evidence"] == {"page": 3, "quote": "a"} and leaf(10, "vendor")["evidence"] is None and leaf(10, "total")["evidence"] is None
    assert leaf(8, "payment_card_last4")["value"] == "1234" and leaf(10, "payment_card_last4")["value"] is None
    assert leaf(8, "payment_method") == {"value": "VISA ****1111", "confidence": 0.0, "evidence": {"page": None, "quote": "card ****1111"}}
    assert leaf(10, "line_items")[0]["quantity"]["evidence"] is None and leaf(10, "line_items")[8]["total"]["evidence"] == {"page": 2, "quote": "z"}


def test_pages_of_evidence(spark):
    leaf = json.dumps({"value": 1, "confidence": 1, "evidence": {"page": 3, "quote": "q"}})
    rows = spark.createDataFrame([(leaf, 5), (leaf, 2), (leaf, None)], "t string, pages int")
    got = [tuple(r["e"]) for r in rows.select(I.evidence_of(F.parse_json("t"), F.col("pages")).alias("e")).collect()]
    assert got == [(3, "q"), (None, "q"), (1, "q")]


def test_quotes_are_placed(spark):
    rng = np.random.default_rng(8)
    pages, quotes = [], []
    for d in range(6):
        own = [[str(rng.choice(list("abcdef"))) for _ in range(25)] for _ in range(4)]
        pages += [(d, p + 1, "\n ".join(ws)) for p, ws in enumerate(own)]
        for _ in range(12):
            ws = own[rng.integers(4)]
            a = int(rng.integers(0, 20))
            quotes.append((d, int(rng.integers(1, 6)), "  ".join(ws[a : a + int(rng.integers(1, 5))])))
        quotes += [(d, 2, "a zebra"), (d, None, "a"), (d, 1, None), (d, 1, "")]
    pages.append((9, 1, None))
    quotes.append((9, 1, "a"))
    got = sorted(map(repr, (tuple(r) for r in I.placed(spark.createDataFrame(quotes, "document_id int, page int, quote string"), spark.createDataFrame(pages, "document_id int, page int, text string")).select("document_id", "page", "quote").collect())))

    def true_page(d, page, quote):
        words = re.split(r"\s+", (quote or "").strip())
        on = [p for e, p, t in pages if e == d and quote is not None and t is not None and f" {' '.join(words)} " in f" {' '.join(t.split())} "]
        return page if page in on else min(on, default=None)

    want = [(d, true_page(d, p, q), q) for d, p, q in quotes if q]
    assert [x for x in got if "None)" not in x and "'')" not in x] == sorted(map(repr, want))




def test_scored_words_keep_counts_only(spark):
    chunks = spark.createDataFrame([(1, "tea " * 3000 + "shop"), (2, "tea shop"), (3, "coffee")], "id long, text string")
    found = S.scored_words(chunks, spark.createDataFrame([(1, "teas of a shop")], "query_id long, text string"), 5, "cover")
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()  # places are counted, not listed
    assert {r["id"]: r["score"] for r in found.collect()} == {1: round(300.1 / (1 + math.log(3001)), 9), 2: round(0.2 / (1 + math.log(2)), 9)}


def test_kept_chunks_are_cut_once(spark):
    pages = spark.createDataFrame([(1, 1, "Acme Corp\nTea total 3.00\n" * 12), (2, 1, None)], "doc_id long, page int, text string")
    kept, plain = (G.indexed(pages, 60, 20, 16, kept=k) for k in (True, False))
    assert "aggregate" not in kept._jdf.queryExecution().optimizedPlan().toString()  # no fold is left to be repeated
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, plain.collect())) and kept.count() > 1


def test_grid_counts_words_once_for_all_scorings(spark, monkeypatch):
    calls, counted = [], S.counted
    monkeypatch.setattr(S, "counted", lambda *a: calls.append(a) or counted(*a))
    chunks, queries = spark.createDataFrame(CHUNKS, "id long, text string"), spark.createDataFrame(ASKED, "query_id long, text string")
    found = G.rankings(chunks, queries, ("lexical",), ("idf", "cover"), 3)
    assert len(calls) == 1 and {r["scoring"] for r in found.select("scoring").distinct().collect()} == {"idf", "cover"}


def test_answers_are_parsed_once_for_fields_and_once_for_rows(spark):
    rows = spark.createDataFrame(list(enumerate(ANSWERS)), "id int, answer string")
    plan = I.fields(rows, "id", SCHEMA, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 2  # a third pass kept no row
    flat = I.fields(rows, "id", {"vendor": None, "total": None}, 0.5)
    assert flat.count() == 2 * len(ANSWERS)


def test_confidences_read_once_and_as_before(spark):
    said = ["1", "0.5", "-2", "1e400", "true", "false", "null", "[1]", "{}", '"1e-2"', '" 1_0 "', '"\\t7\\n"', '"NaN"', '"inf"', '"true"', "12345678901234567890123", "1e-5", '""']
    df = spark.createDataFrame([(i, f'{{"value": 1, "confidence": {x}}}') for i, x in enumerate(said)], "i int, t string")
    found = df.select("i", I.confidence_of(F.parse_json("t")).alias("c"))
    got = [r["c"] for r in sorted(found.collect(), key=lambda r: r["i"])]
    assert got == [1, 0.5, -2, None, 1, 0, None, None, None, 0.01, 10, 7, None, None, None, 12345678901234567890123.0, 1e-5, None]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("$.confidence") == 1  # four before
def test_counts_of_wanted_words_are_kept_by_chunk(spark):
    chunks = spark.createDataFrame([(7, "Teas and tea, shops of 27,82 EUR"), (8, "coffee"), (9, None)], "id long, text string")
    got = S.counted(chunks, spark.createDataFrame([("tea",), ("euro",), ("no",)], "lexeme string")).collect()
    assert [(r["id"], r["size"], dict(zip(r["lexemes"], r["places"], strict=True))) for r in got] == [(7, 8, {"tea": 2, "euro": 1})]


def test_tasks_pass_on_the_best_only(spark, monkeypatch):
    passed, settled = [], S.settled
    monkeypatch.setattr(S, "settled", lambda df: passed.append(settled(df)) or passed[-1])
    chunks = spark.createDataFrame([(i, "tea " * (i % 3 + 1)) for i in range(400)], "id long, text string").coalesce(1)
    best = S.scored_words(chunks, spark.createDataFrame([(1, "tea"), (2, "teas")], "query_id long, text string"), 5, "cover")
    assert passed[-1].where("scoring = 'cover'").count() <= 2 * 5 * S.written(chunks).rdd.getNumPartitions()  # all 800 pairs were shuffled
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in best.collect()) == [(q, i + 1, x) for q in (1, 2) for i, x in enumerate((2, 5, 8, 11, 14))]
    vectors = chunks.select("id", S.F.array(S.F.lit(1.0), S.F.lit(0.5)).alias("embedding"), S.F.lit("m").alias("model")).coalesce(1)
    near = S.cosine_topk(vectors.unionAll(vectors.where("id < 0")), vectors.where("id < 3"), 4).collect()
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in near) == [(q, i + 1, x) for q in range(3) for i, x in enumerate([x for x in range(5) if x != q])]


def test_stored_chunks_hold_neither_pages_nor_vectors(spark, monkeypatch):
    stored, written = [], G.written
    monkeypatch.setattr(G, "written", lambda df: stored.append(df.columns) or written(df))
    pages = spark.createDataFrame([(1, 1, "Acme Corp\nTea total 3.00\n" * 12), (2, 1, None)], "doc_id long, page int, text string")
    G.hits(pages, spark.createDataFrame([(1, "tea total")], "query_id long, text string"), [(0, 0), (60, 20)], modes=("dense",), model=16)
    assert len(stored) == 2 and not any({"text", "embedding"} & set(columns) for columns in stored)


def test_titles_of_first_pages(spark):
    from folio.functions import text as T

    pages = spark.createDataFrame([(1, 2, "Later"), (1, 1, "\n Acme \nTea"), (2, 3, " "), (2, 4, "Shop"), (3, 1, None)], "doc_id long, page int, text string")
    got = {(r["doc_id"], r["page"]): r["header"] for r in T.titled(pages, "doc_id", "page").collect()}
    assert got == {(1, 1): "Acme (page 1 of 2)", (1, 2): "Acme (page 2 of 2)", (2, 3): "(page 3 of 4)", (2, 4): "(page 4 of 4)", (3, 1): "(page 1 of 1)"}


def test_plain_patterns_spare_no_amount_and_no_currency(spark):
    from folio.functions import normalize as N

    rows = [("27,82", "27.82", ""), ("1,234 usd", "1234", "dollar"), ("5.00", "", ""), ("uſd", "", "dollar"), ("Euros£", "", "euro pound"), ("xEURx", "", ""), (None, None, "")]
    df = spark.createDataFrame([(r[0],) for r in rows], "text string")
    amounts = S.F.array_join(S.F.concat(N.eu_amounts(S.F.col("text")), N.us_amounts(S.F.col("text"))), " ")
    got = df.select("text", amounts, S.F.array_join(N.currency_words(S.F.col("text")), " ")).collect()
    assert [tuple(r) for r in got] == rows
    plan = df.select(amounts)._jdf.queryExecution().optimizedPlan().toString()
    assert N.COMMA_AMOUNT in plan
