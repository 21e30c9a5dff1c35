import json

from pyspark.sql import functions as F

from folio import tools
from folio.operators import corrections as C
from folio.operators import evaluation as E
from folio.operators import search as S
from folio.sources import readers

CASES = [
    ("total", "12.5", "USD", '"12.50"', None), ("total", '" 1000 "', "JPY", '"1000"', None), ("total", '"45.255"', "USD", None, "too many decimal places"), ("total", '"$5"', "USD", None, "not a plain number"), ("total", "null", "USD", "null", None),
    ("currency", '" eur "', None, '"EUR"', None), ("currency", '"euro"', None, None, "not a three-letter currency code"), ("payment_card_last4", '"4242"', None, '"4242"', None), ("payment_card_last4", "4242", None, None, "not the last four digits of a card"),
    ("payment_method", '"VISA"', None, '"VISA"', None), ("payment_method", '"VISA 41111"', None, None, "not a text, or a card or account number in it"), ("vendor", '"x"', None, '"x"', None), ("line_items", "{}", "USD", None, "must be a list, or null"),
    ("line_items", '[{"description":"a","quantity":"2","unit_price":1.5,"total":null}]', "USD", '[{"description":"a","quantity":"2","unit_price":"1.50","total":null}]', None),
    ("line_items", '[{"description":"a","quantity":"2"}]', "USD", None, "row 1 has other cells than description, quantity, unit_price, total"), ("tax_lines", '[{"label":"v","rate":"101","base":"1","amount":"1"}]', "USD", None, "row 1 rate: not a rate between 0 and 100"),
]


def test_corrections(spark):
    rows = spark.createDataFrame([(i, n, v, c) for i, (n, v, c, _, _) in enumerate(CASES)], "document_id int, field_name string, value string, currency string")
    got = {r["document_id"]: (r["stored"] and json.loads(r["stored"]), r["problem"]) for r in C.validated(rows).collect()}
    for i, (_, _, _, stored, problem) in enumerate(CASES):
        assert got[i] == (stored and json.loads(stored), problem), CASES[i]


def test_masked_leaf(spark):
    rows = spark.createDataFrame([("payment_method", "VISA 12345", "4111 1111 1111 1111"), ("total", "12345", "order 12345 card 4111 1111 1111 1111")], "f string, v string, q string")
    v, q = C.masked_leaf(F.col("f"), F.col("v"), F.col("q"))
    once = rows.select("f", v.alias("v"), q.alias("q"))
    assert [tuple(r) for r in once.collect()] == [("payment_method", "VISA ****2345", "****1111"), ("total", "12345", "order 12345 card ****1111")]
    assert once.select("f", v.alias("v"), q.alias("q")).collect() == once.collect()


def test_tool_arguments():
    box = tools.Tools({})
    for arguments, said in (({"total_min": "abc"}, "total_min"), ({"total_max": "1e3"}, "total_max"), ({"date_from": "yesterday"}, "date_from"), ({"date_to": "2026-02-30"}, "date_to"), ({"vendor": 5}, "vendor"), ({"color": "red"}, "color")):
        assert said in box.call("query_extractions", arguments).error
    assert "page_number" in box.call("get_page", {"document_id": "d"}).error and box.call("nothing", {}).error


def test_tools(spark):
    pages = spark.createDataFrame([("d", 1, "a\n 4111 1111 1111 1111 \n"), ("d", 2, "b")], "document_id string, page_number int, text string")
    box = tools.Tools({"pages": pages})
    assert [tuple(r) for r in box.call("get_page", {"document_id": "d", "page_number": 1}).rows.collect()] == [("d", 1, 0, 1, "a"), ("d", 1, 3, 11, "****1111")]
    wrong = [("nothing", {}), ("get_page", {"x": 1}), ("get_page", {"document_id": "d", "page_number": "1"}), ("get_page", {"document_id": "d", "page_number": 3}), ("get_page", {"document_id": "e", "page_number": 1})]
    assert all(box.call(n, a).error for n, a in wrong)
    handlers = tools.Handlers({"index": lambda job: job["id"]})
    assert handlers("index", {"id": 3}) == 3
    try:
        handlers("other", {})
        raise AssertionError
    except tools.UnknownKind:
        pass


def test_sql_functions(spark):
    spark.createDataFrame([("a", "2024-01-02", 1.5), ("b", "2024-01-02", 2.0), ("a", "2023-01-01", 9.0)], "organization_id string, at string, cost double").selectExpr("organization_id", "cast(at as timestamp) at", "cast(cost as decimal(10,6)) cost").createOrReplaceTempView("costs")
    tools.sql_functions(spark, "costs")
    spark.sql("SET VAR organization = 'a'")
    row = spark.sql("SELECT current_organization() o, spend_since(TIMESTAMP '2024-01-01') s, all_spend_since(TIMESTAMP '2024-01-01') t").first()
    assert row["o"] == "a" and float(row["s"]) == 1.5 and float(row["t"]) == 3.5


def test_search(spark):
    chunks = spark.createDataFrame([(1, "d1", "total 27,82 EUR", [1.0, 0.0], "m"), (2, "d2", "lamps other chunk", [0.6, 0.8], "m"), (3, "d3", "nothing", [0.0, 1.0], "n"), (4, "d4", "lamp", None, "m")], "id long, document_id string, text string, embedding array<double>, model string")
    queries = spark.createDataFrame([(9, "27.82 euros", [1.0, 0.1], "m"), (8, "the lamp", [0.0, 1.0], "m"), (7, "the and of", [0.0, 0.0], "m")], "query_id long, text string, embedding array<double>, model string")
    got = {m: {q: [r["id"] for r in sorted(S.search(chunks, queries, m, 3).collect(), key=lambda r: r["position"]) if r["query_id"] == q] for q in (8, 9)} for m in ("dense", "lexical", "hybrid")}
    assert got["dense"] == {9: [1, 2], 8: [2]} and got["lexical"] == {9: [1], 8: [4, 2]} and got["hybrid"][9] == [1, 2] and set(got["hybrid"][8]) == {2, 4}
    assert S.search(chunks, queries, "hybrid", 3).where("query_id = 7").count() == 0  # stop words alone find nothing
    assert S.search(chunks, queries, "hybrid", 3, scope=[]).count() == 0
    hit = S.search(chunks, queries, "hybrid", 1, scope=["d1", "d2"]).where("query_id = 9").first()
    assert (hit["dense_rank"], hit["lexical_rank"], hit["document_id"]) == (1, 1, "d1")


def test_bar_and_readers(spark, tmp_path):
    runs = spark.createDataFrame([("before", "d", "f", True, True, True, 0, False), ("after", "d", "f", True, False, True, 0, False)], "run string, doc_id string, field_name string, core boolean, correct boolean, has_quote boolean, violations int, stopped boolean")
    assert {r["term"]: r["passed"] for r in E.core_bar(runs).collect()} == {"core accuracy": True, "evidence coverage": True, "schema violations": True, "stops": True}
    lines = spark.createDataFrame([("api| 12.5% | 1.5GiB / 2GiB",), ("x",), ("y|z|1B / 2B",)], "value string")
    assert [tuple(r) for r in readers.container_stats(lines).collect()] == [("api", 12.5, 1.5 * 2**30, 2.0 * 2**30)]
    (tmp_path / "q.json").write_text(json.dumps({"questions": [{"id": "a", "question": "?", "doc_ids": ["x"]}]}))
    known = spark.createDataFrame([("x",)], "doc_id string")
    asked = readers.questions(spark, str(tmp_path / "q.json"), known)
    assert asked.count() == 1
    (tmp_path / "c.json").write_text(json.dumps({"items": [{"id": "1", "question_id": "zz", "answer": "x"}]}))
    for bad in (lambda: readers.questions(spark, str(tmp_path / "q.json"), known.limit(0)), lambda: readers.calibration(spark, str(tmp_path / "c.json"), asked)):
        try:
            bad()
            raise AssertionError
        except readers.BadInput:
            pass
