import json
import random
from decimal import Decimal

import arithmetic_mirror as R
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.functions import masking
from folio.functions.printed import agreement, printed_amounts
from folio.operators import mutations as M
from folio.operators import reconcile as E

D = Decimal
DOC = {"currency": "USD", "subtotal": "30.00", "discount": "2.00", "shipping": "1.50", "tax": "2.80", "total": "32.30", "amount_paid": "10.00", "amount_due": "22.30",
       "document_date": "2026-01-05", "due_date": "2026-02-04",
       "line_items": [{"quantity": "2", "unit_price": "5.00", "total": "10.00"}, {"quantity": "1", "unit_price": "20", "total": "20.00"}],
       "tax_lines": [{"rate": "10", "base": "28.00", "amount": "2.80"}]}


def failed(report):
    return [c["id"] for c in report["checks"] if c["status"] == "fail"]


def test_consistent():
    assert R.reconcile(DOC)["status"] == "pass" and not failed(R.reconcile(DOC))
    assert R.reconcile({})["status"] == "skipped"


@pytest.mark.parametrize("path,wrong", [("total", "33.30"), ("subtotal", "31.00")])
def test_one_wrong_amount_is_mended(path, wrong):
    report = R.reconcile(DOC | {path: wrong})
    assert report["status"] == "fail"
    assert report["suggestion"] == {"path": path, "current": wrong, "value": DOC[path]}


@pytest.mark.parametrize("path,wrong,other", [("discount", "20.00", ["shipping"]), ("shipping", "1.05", ["discount"]), ("amount_due", "22.03", ["amount_paid"]), ("amount_paid", "1.00", ["amount_due"])])
def test_two_fixes_are_none(path, wrong, other):
    """Either of two amounts could settle it, so none is suggested until the other is verified."""
    report = R.reconcile(DOC | {path: wrong})
    assert report["status"] == "fail" and report["suggestion"] is None
    assert R.reconcile(DOC | {path: wrong, "verified": other})["suggestion"] == {"path": path, "current": wrong, "value": DOC[path]}


def test_verified_amounts_stay():
    assert R.reconcile(DOC | {"shipping": "1.05", "verified": ["shipping", "discount"]})["suggestion"] is None


def test_readings_and_formats():
    gross = {"currency": "EUR", "subtotal": "119.00", "tax": "19.00", "total": "119.00"}
    assert R.reconcile(gross)["status"] == "pass"
    after = {"currency": "USD", "subtotal": "28.00", "discount": "2.00", "tax": "2.80", "total": "30.80", "line_items": DOC["line_items"]}
    assert R.reconcile(after)["status"] == "pass"
    assert failed(R.reconcile(DOC | {"total": "32.301"})) == ["format:total"]
    assert failed(R.reconcile(DOC | {"currency": "JPY"})) and "format:total" in failed(R.reconcile(DOC | {"total": "1e3"}))
    assert "due_date_order" in failed(R.reconcile(DOC | {"due_date": "2025-01-01"}))
    assert "lines_present" in failed(R.reconcile({"subtotal": "3.00", "line_items": []}))
    assert "non_negative:total" in failed(R.reconcile({"total": "-3.00"}))


def test_quotes():
    cite = {"total": {"page": 1, "quote": "TOTAL $32.30"}}
    assert R.reconcile(DOC | {"evidence": cite})["status"] == "pass"
    report = R.reconcile(DOC | {"total": "33.30", "evidence": cite})
    assert failed(report) == ["quote:total", "total_math", "balance_math"] and report["suggestion"]["value"] == "32.30"


def test_one_printed_tax():
    doc = {"currency": "USD", "subtotal": "10.00", "tax": "0.90", "total": "10.80", "tax_lines": [{"rate": None, "base": None, "amount": "0.90"}], "line_items": [{"quantity": "1", "unit_price": "10.00", "total": "10.00"}], "verified": ["total"]}
    assert R.reconcile(doc)["suggestion"] == {"path": "tax", "current": "0.90", "value": "0.80"}


@settings(max_examples=150, deadline=None, derandomize=True)
@given(st.lists(st.tuples(st.integers(1, 9), st.decimals(0, 500, places=2)), min_size=1, max_size=5), st.decimals(1, 50, places=2), st.integers(1, 9999))
def test_wrong_total_never_mended_wrongly(lines, ship, off):
    subtotal = sum(q * u for q, u in lines)
    rows = [{"quantity": q, "unit_price": u, "total": q * u} for q, u in lines]
    doc = {"currency": "USD", "subtotal": subtotal, "shipping": ship, "total": subtotal + ship, "line_items": rows}
    assert R.reconcile(doc)["status"] == "pass"
    report = R.reconcile(doc | {"total": subtotal + ship + D(off) / 100})
    assert report["status"] == "fail" and (report["suggestion"] is None or report["suggestion"]["path"] in ("total", "shipping"))


def test_reports(spark):
    rows = spark.createDataFrame([(1, json.dumps(DOC)), (2, None), (3, "{"), (4, json.dumps(DOC | {"total": "33.30"})), (5, "[]")], "id int, doc string")
    got = {r["id"]: r["report"] for r in E.reports(rows, "doc").collect()}
    assert got[1]["status"] == "pass" and got[4]["suggestion"]["path"] == "total"
    assert all(got[i]["status"] is None and got[i]["error"] for i in (2, 3, 5))
    fields = spark.createDataFrame([(4, "total", 0.99, False), (4, "tax", 0.2, False), (4, "subtotal", 0.99, True), (4, "vendor", 0.95, False)], "document_id int, name string, confidence double, reviewed boolean")
    joined = fields.join(E.reports(rows, "doc").select("id", "report"), fields["document_id"] == rows["id"])
    routes = {r["name"]: r["review_reason"] for r in E.routed(joined, joined["report"]).collect()}
    assert routes == {"total": "total_math", "tax": "confidence", "subtotal": None, "vendor": None}


def invented(rnd):
    """A document that is mostly consistent, with faults, citations, confirmed fields and odd shapes."""
    cents = lambda a, b: D(rnd.randint(a, b)) / 100
    lines = []
    for _ in range(rnd.randint(0, 3)):
        q, u = rnd.choice([D(rnd.randint(1, 5)), D(rnd.randint(1, 3000)) / 1000]), cents(1, 5000)
        lines.append({"quantity": q, "unit_price": u, "total": round(q * u, 2)})
    s = sum((x["total"] for x in lines), D(0)) if lines else cents(100, 9999)
    doc = {"currency": rnd.choice(["USD", "EUR", None, "KWD"]), "subtotal": s}
    some = {k: cents(1, most) for k, most, odds in (("discount", 300, 0.4), ("shipping", 999, 0.4), ("tip", 500, 0.2)) if rnd.random() < odds}
    rate, less = D(rnd.choice(["10", "8.875", "19", "5"])), some.get("discount", D(0))
    doc |= some
    tax = round((s - less) * rate / 100, 2) if rnd.random() < 0.7 else None
    if tax is not None:
        doc["tax"] = tax
        if rnd.random() < 0.6:
            doc["tax_lines"] = [{"rate": rate, "base": s - less if rnd.random() < 0.5 else None, "amount": tax}]
            if rnd.random() < 0.2:
                del doc["tax"]
    total = s - less + some.get("shipping", 0) + some.get("tip", 0) + (tax or 0)
    doc["total"] = s if rnd.random() < 0.1 else total
    if less and rnd.random() < 0.2:
        doc["subtotal"] = s - less
    if lines and rnd.random() < 0.9:
        doc["line_items"] = lines
    if rnd.random() < 0.3:
        doc["amount_due"] = total - (cents(0, 500) if rnd.random() < 0.5 else 0)
    if rnd.random() < 0.2:
        doc["amount_paid"] = cents(0, 500)
    if rnd.random() < 0.1:
        doc |= {"document_date": "2026-01-05", "due_date": rnd.choice(["2026-02-30", "2025-12-31", "2026-01-05", 7])}
    if lines and rnd.random() < 0.2:
        lines[0]["total"] = None
    if lines and rnd.random() < 0.1:
        doc.pop("subtotal")
    cited = {k: {"page": rnd.choice([1, 2, None]), "quote": rnd.choice([f"{k} {v}", f"{k}: ${v:,}", f"{v} of 99.10", "none", ""])} for k, v in doc.items() if isinstance(v, D) and rnd.random() < 0.4}
    if doc.get("tax_lines") and rnd.random() < 0.4:
        cited["tax_lines[0].amount"] = {"page": 1, "quote": f"tax {doc['tax_lines'][0]['amount']}"}
    if lines and rnd.random() < 0.4:
        cited["line_items[0].total"] = {"page": 1, "quote": f"x {lines[0]['total']}"}
    for _ in range(rnd.choice([0, 0, 1, 1, 1, 2])):
        spot = rnd.choice([(doc, k) for k in doc if isinstance(doc[k], D)] + [(x, k) for x in lines for k in x if x[k] is not None])
        spot[0][spot[1]] = rnd.choice([spot[0][spot[1]] + D("0.01"), spot[0][spot[1]] + 1, spot[0][spot[1]] * 10, -spot[0][spot[1]], D("12.3456789"), spot[0][spot[1]] - D("0.90")])
    return doc | ({"evidence": cited} if cited else {}) | ({"verified": rnd.sample(["total", "tax", "subtotal", "line_items", "discount", "tax_lines"], 2)} if rnd.random() < 0.2 else {})


def plain(report):
    return report["status"], [(c["id"], c["status"], c["delta"], list(c["fields"])) for c in report["checks"]], report["suggestion"] and {k: report["suggestion"][k] for k in ("path", "current", "value")}


def test_columns_equal_plain_rules(spark):
    rnd = random.Random(11)
    docs = [DOC, {}, *(DOC | x for x in ({"total": "33.30"}, {"subtotal": "31.00"}, {"discount": "20.00"}, {"discount": "20.00", "verified": ["shipping"]}, {"currency": "JPY"}, {"currency": 5}, {"total": "1e3"}, {"total": True}, {"total": " 32.30 "},
            {"due_date": "2025-01-01"}, {"total": "33.30", "evidence": {"total": {"page": 1, "quote": "TOTAL $32.30"}}}, {"line_items": [7, None, {}]}, {"tax_lines": [{"rate": "10", "base": None, "amount": "2.80"}] * 2}, {"shipping": "999999999999.99"}, {"shipping": "1000000000000"}))]
    docs += [invented(rnd) for _ in range(400)]
    texts = [json.dumps(d, default=str) for d in docs] + [None, "{", "[]", '{"line_items": 5}', '{"evidence": 5}']
    rows = spark.createDataFrame(list(enumerate(texts)) + [(1000, texts[2])], "id int, doc string")
    for key in ("id", None):
        got = {r["id"]: r["report"] for r in E.reports(rows, "doc", key).collect()}
        assert len(got) == len(texts) + 1 and plain(got[1000]) == plain(got[2])
        for i, text in enumerate(texts):
            want = R.report(text)
            if want["status"] is None:
                assert got[i]["status"] is None and got[i]["error"] and not got[i]["checks"]
            else:
                assert plain(got[i]) == plain(want), text
    assert sum(r["suggestion"] is not None for r in got.values()) > 30


def test_mutations_equal_plain_rules(spark):
    doc = json.loads(json.dumps(DOC)) | {"evidence": {"total": {"page": 1, "quote": "Total 32,30 EUR"}, "tax": {"page": 1, "quote": "tax 2.80"}, "tax_lines[0].amount": {"page": 1, "quote": "tax 2.80"}, "subtotal": {"page": 1, "quote": "goods"}, "shipping": {"page": 1, "quote": "1.50"}}}
    doc = json.loads(json.dumps(doc), parse_float=D)
    for k in ("subtotal", "discount", "shipping", "tax", "total", "amount_paid", "amount_due"):
        doc[k] = float(doc[k])
    for row in doc["line_items"] + doc["tax_lines"]:
        row.update({k: float(v) for k, v in row.items()})
    doc["evidence"].pop("subtotal")
    rows = spark.createDataFrame([(1, json.dumps(doc)), (2, json.dumps(doc | {"total": 40}))], "id int, doc string")
    found = M.outcomes(rows, "id", "doc", M.VARIANTS).collect()
    parsed = json.loads(json.dumps(doc), parse_float=D, parse_int=D)
    want = list(M.mutations(parsed))
    assert len(found) == len(want) * len(M.VARIANTS) and {r["id"] for r in found} == {1}
    for r in found:
        report = R.reconcile(json.loads(json.dumps(M.broken(parsed, r["path"], r["original"], r["mutated"], r["variant"])), parse_float=D, parse_int=D))
        field = r["path"].split("[")[0]
        about = [c for c in report["checks"] if c["status"] == "fail" and any(f.split("[")[0] == field for f in c["fields"])]
        fix = report["suggestion"]
        fixed = fix is not None and fix["path"] == r["path"] and D(fix["value"]) == D(r["original"])
        assert (r["detected"], r["flagged"], r["quote_flagged"], r["fixed"], r["wrong_fix"]) == (report["status"] == "fail", bool(about), any(c["id"].startswith("quote:") for c in about), fixed, fix is not None and not fixed), r
    # a faithful quote tells a misread value, a misread one doesn't; twins are misread together
    flagged = {v: {(r["path"], r["kind"]) for r in found if r["variant"] == v and r["quote_flagged"]} for v in M.VARIANTS}
    assert ("total", "misread_digit") in flagged["faithful"] and ("shipping", "misread_digit") in flagged["faithful"]
    assert not flagged["none"] and ("total", "misread_digit") not in flagged["same_misread"] | flagged["missing"]
    both = M.broken(parsed, "tax", "2.80", "7.80", "same_misread")
    assert both["tax_lines"][0]["amount"] == "7.80" and both["evidence"]["tax_lines[0].amount"]["quote"] == "tax 7.80"


@pytest.mark.parametrize("quote,before,after,want", [
    ("Total 2,226.78", "2226.78", "2262.78", "Total 2,262.78"), ("2.226,78 EUR", "2226.78", "12226.78", "12.226,78 EUR"), ("27,82", "27.82", "28.72", "28,72"), ("x 12 of 112", "12", "21", "x 21 of 112"),
    ("1 234.50 and 234.50", "1234.50", "5234.50", "5 234.50 and 234.50"), ("none", "5", "6", None), ("122.50", "22.50", "25.20", None), ("(5.00)", "-5.00", "-6.00", "(6.00)"),
])
def test_quotes_are_misread_in_their_style(quote, before, after, want):
    assert M.misread_quote(quote, D(before), D(after)) == want


@pytest.mark.parametrize("text,places,want", [
    ("27,82 EUR", None, ["27.82"]), ("$1,234.56", None, ["1234.56"]), ("1.234", None, ["1.234", "1234"]), ("1,000", 2, ["1000"]), ("8.875%", 2, ["8.875"]),
    ("1'234.56", None, ["1", "234.56", "1234.56"]), ("06/30/2026", None, []), ("12.05.2024", None, []), ("2 x 4.50 = 9.00", 2, ["2", "4.50", "9.00"]),
    ("$.50", 2, ["0.50"]), ("12,34,567", 2, ["1234567"]), ("Total ...... 48.30", 2, ["48.30"]), ("", 2, []), (None, 2, []),
])
def test_printed(text, places, want):
    assert set(printed_amounts(text, places)) == set(map(D, want)) and len(printed_amounts(text, places)) == len(want)


def test_agreement():
    assert agreement(D("-5.00"), "(5.00)", 2) == "pass" and agreement(D(5), "six", 2) == "fail_no_number" and agreement(D(0), "free", 2) == "skipped_zero_unprinted"
    assert agreement(D(5), " ", 2) == "skipped_no_quote" and agreement(D(5), "6.00", 2) == "fail_mismatch"


@pytest.mark.parametrize("text,want", [
    ("VISA 4111 1111 1111 1111 12-27", "VISA ****1111 12-27"), ("2026-10-01 - 2026-10-31", "2026-10-01 - 2026-10-31"), ("ref 1234567812345678", "ref 1234567812345678"),
    ("card 378282246310005.", "card ****0005."), ("", ""), (None, None),
])
def test_cards(text, want):
    assert masking.mask_cards(text) == want and masking.mask_cards(want) == want


def test_amounts_are_looked_up_once(spark):
    from folio.operators import reconcile

    docs = spark.createDataFrame([(1, '{"subtotal": "1.00", "line_items": [{"total": 1}]}')], "k int, d string")
    plan = reconcile.papers(docs, "d", "k")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get") < 300  # in one expression there were over a thousand


def test_usable_texts(spark):
    rows = [("000000000000000.1000000000", True), ("999999999999", True), ("1000000000000", False), ("1.005", False), ("-1.50000", True), ("1.", False), (".5", False), ("+1", False), (" 7 ", True), ("7\n", True), ("1e3", False), ("", False)]
    docs = spark.createDataFrame([(i, '{"currency": "USD", "total": "' + t.replace("\n", "\\n") + '"}') for i, (t, _) in enumerate(rows)], "k int, d string")
    from folio.operators import reconcile

    got = {r["_key"]: r["a_total"]["v"] is not None and not r["a_total"]["bad"] for r in reconcile.papers(docs, "d", "k").select("_key", "a_total").collect()}
    assert got == {i: good for i, (_, good) in enumerate(rows)}


def _faulty(spark):
    docs = [DOC, DOC | {"total": "33.30"}, DOC | {"subtotal": "31.00"}, DOC | {"line_items": [DOC["line_items"][0] | {"total": "12.00"}, DOC["line_items"][1]]}]
    return spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id int, doc string").coalesce(1)


def test_broken_documents_are_dealt_to_all_cores(spark, monkeypatch):
    seen, reports = [], M.reports
    monkeypatch.setattr(M, "reports", lambda docs, *a: seen.append(docs) or reports(docs, *a))
    M.outcomes(_faulty(spark), "id", "doc")
    assert seen[-1].rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism  # it was one: the documents are small


def test_each_change_is_tried_once_and_only_where_it_may_settle_all(spark):
    d = E.written(E._first(_faulty(spark), "doc", "id")).where("again is not null").select("_key", "again.*")
    tried = [(r["_key"], r["path"], str(r["value"].normalize())) for r in E.candidates(d).collect()]
    assert len(tried) == len(set(tried)) and (3, "line_items[0].total", "1E+1") in tried
    assert not any(key == 3 and path in ("line_items[1].total", "subtotal") for key, path, _ in tried)  # they leave line_math[0] failed


def test_reports_store_amounts_of_failed_documents_only(spark):
    stored = {r["_key"]: r["again"] for r in E._first(_faulty(spark), "doc", "id").collect()}
    assert stored[0] is None and all(stored[i] is not None for i in (1, 2, 3))


def test_reports_without_suggestions(spark, monkeypatch):
    rows = _faulty(spark)
    want = {r["id"]: r["report"] for r in E.reports(rows, "doc", "id").collect()}
    monkeypatch.setattr(E, "candidates", None)  # nothing is tried
    got = {r["id"]: r["report"] for r in E.reports(rows, "doc", "id", suggest=False).collect()}
    assert all((got[i]["status"], got[i]["checks"], got[i]["suggestion"]) == (want[i]["status"], want[i]["checks"], None) for i in want)
