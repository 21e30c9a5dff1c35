"""Readers that refuse or leave out what isn't theirs, refreshed routing, and the leaves of merged pages."""

import json

import pytest
from pyspark.sql import functions as F

from folio.operators import corrections, merge
from folio.operators.reconcile import reports
from folio.sources import readers


def test_page_texts_of_known_documents(spark, tmp_path):
    (tmp_path / "a b.txt").write_text("one\ntwo")
    (tmp_path / "c.txt").write_text("three")
    (tmp_path / "d.md").write_text("no text file")
    known = spark.createDataFrame([("a b",), ("d",), ("zz",)], "doc_id string")
    assert [tuple(r) for r in readers.page_texts(spark, str(tmp_path), known).collect()] == [("a b", 1, "one\ntwo")]


def test_runs_are_sorted_and_bad_ones_left_out(spark, tmp_path):
    run = {"model": "m", "started_at_utc": "20260102T000000Z", "summary": {}}
    for name, text in {
        "late.json": json.dumps(run), "early.json": json.dumps(run | {"started_at_utc": "20260101T000000Z"}), "torn.json": '{"model": "m", ', "bare.json": json.dumps({"model": "m", "started_at_utc": "x"}),
        "stand-in.json": json.dumps(run | {"model": readers.STAND_IN}), "nameless.json": json.dumps({k: v for k, v in run.items() if k != "model"}),
    }.items():
        (tmp_path / name).write_text(text)
    found = readers.runs(spark, str(tmp_path))
    assert [r["file"].rsplit("/", 1)[1] for r in found.collect()] == ["early.json", "late.json"]
    assert readers.newest(found.select("model", "file", "started_at_utc"), ["model"]).first()["started_at_utc"] == "20260102T000000Z"
    suite = readers.suite_runs(spark, str(tmp_path), "summary struct<n: int>", ["summary"])
    assert {r["file"].rsplit("/", 1)[1] for r in suite.collect()} == {"early.json", "late.json", "stand-in.json", "nameless.json"}


def test_query_set_is_refused_if_wrong(spark, tmp_path):
    good = [{"id": "q1", "type": "item", "query": "tea", "relevant": {"item": "Tea"}}, {"id": "q2", "type": "vendor", "query": "acme", "relevant": {"vendors": ["Acme"]}}]
    path = tmp_path / "q.json"
    path.write_text(json.dumps({"queries": good}))
    assert [r["id"] for r in readers.query_set(spark, str(path)).orderBy("id").collect()] == ["q1", "q2"]
    for wrong in ([*good, good[0]], [*good, {"id": "q3", "query": "x", "relevant": {}}]):
        path.write_text(json.dumps({"queries": wrong}))
        with pytest.raises(readers.BadInput):
            readers.query_set(spark, str(path))


def test_refreshed_routing(spark):
    doc = json.dumps({"currency": "USD", "subtotal": "10.00", "tax": "1.00", "total": "12.00", "verified": ["subtotal", "tax"]})
    told = reports(spark.createDataFrame([(1, doc), (2, "broken")], "document_id int, doc string"), "doc", "document_id").select("document_id", "report")
    rows = [(1, "total", 0.99, False, None), (1, "tax", 0.99, False, "total_math"), (1, "vendor", 0.1, False, "confidence"), (1, "subtotal", 0.1, True, "confidence"), (2, "total", 0.99, False, "confidence")]
    fields = spark.createDataFrame(rows, "document_id int, name string, confidence double, reviewed boolean, reason string")
    got = {(r["document_id"], r["name"]): (r["old"], r["new"], r["error"] is not None) for r in corrections.refreshed(fields, told).collect()}
    assert got == {(1, "total"): (None, "total_math", False), (1, "tax"): ("total_math", None, False), (2, "total"): ("confidence", "confidence", True)}


def test_coerced_leaves_and_field_rows(spark):
    rows = spark.createDataFrame([(1, '"a"', 0.4, True), (2, '"b"', 7.0, True), (3, '"c"', float("nan"), True), (4, '"d"', 0.9, False), (5, None, None, True)], "i int, value string, confidence double, whole boolean")
    value, sure = merge.coerced(F.col("value"), F.col("confidence"), F.col("whole"))
    assert [tuple(r) for r in rows.orderBy("i").select(value, sure).collect()] == [('"a"', 0.4), ('"b"', 1.0), ('"c"', 0.0), (None, 0.0), (None, 0.0)]
    merged = spark.createDataFrame([(1, "total", '"5"', 0.9), (1, "odd", '"x"', 0.9), (2, "total", '"6"', 0.5)], "document_id int, field_name string, value string, confidence double")
    schema = spark.createDataFrame([("total",), ("vendor",)], "field_name string")
    got = {(r["document_id"], r["field_name"]): (r["value"], r["confidence"], r["needs_review"]) for r in merge.field_rows(merged, schema, 0.6).collect()}
    assert got == {(1, "total"): ('"5"', 0.9, False), (1, "vendor"): (None, 0.0, True), (2, "total"): ('"6"', 0.5, True), (2, "vendor"): (None, 0.0, True)}
