import json

import pytest

from folio.operators import mutations as M
from folio.operators import scoring as S

CASES = [
    ("vendor", "Harborline Supply, Inc.", "harborline supply inc", True), ("vendor", "Harborline Supply", "Northwind", False), ("invoice_number", "INV-2026-0417", "inv 2026 0417", True),
    ("invoice_number", "INV-2026-0417", "INV-2026-0471", False), ("invoice_number", "--", "--", False), ("document_date", "2026-03-05", "03/05/2026", True), ("document_date", "2026-12-25", "25/12/2026", True),
    ("document_date", "2026-12-25", "2026/12/25", True), ("document_date", "2026-02-28", "2026-02-30", False), ("payment_terms", "Net 30", "Terms: net 30 days", True), ("payment_terms", "Net 30", "Net 300", False),
    ("payment_terms", "Due upon receipt", "Due on receipt", True), ("currency", "USD", " usd ", True), ("total", "20.00", "19.99", True), ("total", "20.00", "19.98", False), ("total", "20.00", "$20.00", False),
    ("rate", "8.875", "8.88", False), ("rate", "8.8750", "8.875", True), ("payment_card_last4", "1234", " 1234", True), ("tax", None, None, True), ("tax", None, "1.00", False), ("tax", "1.00", None, False),
]


def test_rules(spark):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, field string, gold string, found string, want boolean").selectExpr("*", "true AS quoted")
    got = S.scored(rows).orderBy("i").collect()
    assert [r["i"] for r in got if r["correct"] != r["want"]] == []
    assert [r["i"] for r in got if r["hallucinated"]] == [20]
    assert {r["field"] for r in got if r["violated"]} == {"total", "rate", "tax"}


def test_row_accuracy(spark):
    cells = spark.createDataFrame([(1, 0, True), (1, 0, True), (1, 1, True), (1, 1, False), (2, None, True)], "doc int, position int, correct boolean")
    assert {r["doc"]: r["accuracy"] for r in S.row_accuracy(cells, "doc").collect()} == {1: 0.5, 2: 1.0}


@pytest.mark.parametrize("shown,want", [("46.25", {"46.52", "96.25", "4625", "146.25"}), ("-5.00", {"-0.50", "-6.00", "-500", "-15.00"}), ("7", {"1", "17"})])
def test_misreadings(shown, want):
    assert {t for _, t in M.rewritten(shown)} == want


def test_mutations(spark):
    doc = {"currency": "USD", "subtotal": 30, "tax": 3, "total": 33, "line_items": [{"quantity": 2, "unit_price": 5, "total": 10}, {"quantity": 1, "unit_price": 20, "total": 20}], "tax_lines": [{"rate": 10, "base": 30, "amount": 3}]}
    rows = spark.createDataFrame([(1, json.dumps(doc)), (2, None), (3, "{"), (4, json.dumps(doc | {"total": 40}))], "id int, doc string")
    found = M.outcomes(rows, "id", "doc")
    assert {r["id"] for r in found.select("id").distinct().collect()} == {1}
    tally = {r["kind"]: r for r in M.tallied(found).collect()}
    assert set(tally) == {*M.KINDS, "total"} and tally["total"]["mutations"] == found.count() and all(r["wrong_fix"] == 0 and r["detected"] == r["flagged"] for r in tally.values())
    # a total that equals the subtotal reads as one that holds the tax; a base one unit off stays within the amount's rounding
    missed = {(r["path"], r["kind"]) for r in found.where("not detected").collect()}
    assert missed == {("total", "wrong_row"), ("tax_lines[0].base", "one_minor_unit")}
