"""Corrections that reviewers send, as JSON text: what is stored of them, or what is wrong with them; and payment fields without card
numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import answers as A
from folio.functions import masking
from folio.functions import money as M
from folio.operators.records import kind_of, text_of

# Fields by the rule that judges them, and the cells of the array fields with theirs.
MONEY = ("subtotal", "discount", "shipping", "tax", "tip", "total", "amount_paid", "amount_due")
CELLS = {"line_items": {"description": "text", "quantity": "quantity", "unit_price": "money", "total": "money"}, "tax_lines": {"label": "text", "rate": "rate", "base": "money", "amount": "money"}}


def number_text(value: Column) -> Column:
    """The digits of a number or of a text."""
    return F.when(kind_of(value) == "number", value).otherwise(text_of(value))


def _money(value: Column, places: Column) -> Column:
    typed = A.input_amount(number_text(value), places)
    shown = F.regexp_replace(F.format_string("%s", typed["value"].cast("decimal(38,6)")), r"0+$", "")
    # padded to the currency's places; no point where there are none
    point = F.instr(shown, ".")
    padded = F.concat(shown, F.repeat(F.lit("0"), F.greatest(places - (F.length(shown) - point), F.lit(0))))
    plain = F.regexp_replace(padded, r"\.$", "")
    return F.struct(F.when(typed["problem"].isNull(), F.concat(F.lit('"'), plain, F.lit('"'))).alias("stored"), typed["problem"].alias("problem"))


def _plain(typed: Column) -> Column:
    shown = F.regexp_replace(F.regexp_replace(typed["value"].cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.struct(F.when(typed["problem"].isNull(), F.concat(F.lit('"'), shown, F.lit('"'))).alias("stored"), typed["problem"].alias("problem"))


def _kept(value: Column, ok: Column, problem: str, stored: Column | None = None) -> Column:
    return F.struct(F.when(ok, value if stored is None else stored).alias("stored"), F.when(ok, F.lit(None).cast("string")).otherwise(F.lit(problem)).alias("problem"))


def _cell(kind: str, value: Column, places: Column) -> Column:
    none = kind_of(value) == "null"
    if kind == "text":
        return _kept(value, none | (kind_of(value) == "text"), "must be text or null")
    judged = _money(value, places) if kind == "money" else _plain((A.input_quantity if kind == "quantity" else A.input_rate)(number_text(value)))
    return F.when(none, F.struct(F.lit("null").alias("stored"), F.lit(None).cast("string").alias("problem"))).otherwise(judged)


def validated(corrections: DataFrame) -> DataFrame:
    """corrections (document_id, field_name, value as JSON text, currency) with stored (JSON text) and problem (null: fine). Amounts fit
    the document's currency, rows of array fields have exactly their cells, a currency is three letters, no card or account number is
    taken; other fields are stored as sent. A null value is taken for every field."""
    value, name = F.col("value"), F.col("field_name")
    places = M.minor_units(F.col("currency"))
    text, none = text_of(value), kind_of(value) == "null"
    code = M.stripped(text)
    rules = F.when(none, _kept(value, F.lit(True), "", F.lit("null"))).when(name.isin(*MONEY), _money(value, places))
    rules = rules.when(name == "currency", _kept(value, F.coalesce(code.rlike(r"^[A-Za-z]{3}$"), F.lit(False)), "not a three-letter currency code", F.concat(F.lit('"'), F.upper(code), F.lit('"'))))
    rules = rules.when(name == "payment_card_last4", _kept(value, F.coalesce(text.rlike(r"\A[0-9]{4}\z"), F.lit(False)), "not the last four digits of a card"))
    rules = rules.when(name == "payment_method", _kept(value, F.coalesce(~masking.has_long_run(text), F.lit(False)), "not a text, or a card or account number in it"))
    for array, cells in CELLS.items():
        rules = rules.when(name == array, _rows(value, cells, places))
    return corrections.withColumn("_x", rules.otherwise(_kept(value, F.lit(True), ""))).select(*corrections.columns, "_x.stored", "_x.problem")


def _rows(value: Column, cells: dict[str, str], places: Column) -> Column:
    """Judges each row of an array; the first problem is told, with its row and cell."""
    names = sorted(cells)
    # rows and cells as JSON text, each read once
    rows = F.transform(F.try_variant_get(F.try_parse_json(value), "$", "array<variant>"), lambda v: F.to_json(v))
    part = lambda row, c: F.to_json(F.try_variant_get(F.try_parse_json(row), f"$.{c}", "variant"))

    def judged(row: Column, i: Column) -> Column:
        label = F.concat(F.lit("row "), (i + 1).cast("string"), F.lit(" "))
        keys = F.array_sort(F.json_object_keys(row))
        exact = F.coalesce(keys == F.array(*map(F.lit, names)), F.lit(False))
        told = [(c, _cell(kind, part(row, c), places)) for c, kind in cells.items()]
        problem = F.coalesce(F.when(~exact, F.lit("has other cells than " + ", ".join(cells))), *(F.when(x["problem"].isNotNull(), F.concat(F.lit(f"{c}: "), x["problem"])) for c, x in told))
        stored = F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{c}":'), x["stored"]) for c, x in told)), F.lit("}"))
        return F.struct(stored.alias("stored"), F.concat(label, problem).alias("problem"))

    out = F.transform(rows, judged)
    first = F.try_element_at(F.filter(F.transform(out, lambda x: x["problem"]), lambda p: p.isNotNull()), F.lit(1))
    problem = F.when(kind_of(value) != "list", F.lit("must be a list, or null")).otherwise(first)
    return F.struct(F.when(problem.isNull(), F.concat(F.lit("["), F.array_join(F.transform(out, lambda x: x["stored"]), ","), F.lit("]"))).alias("stored"), problem.alias("problem"))


def masked_leaf(field: Column, value: Column, quote: Column) -> tuple[Column, Column]:
    """A leaf's text value and quote without card numbers: payment fields by the stricter rule, all others by the check sum. What is
    masked once stays as it is."""
    payment = field.startswith("payment_")
    return F.when(payment, masking.mask_runs(value)).otherwise(value), F.when(payment, masking.mask_runs(quote)).otherwise(masking.masked_cards(quote))


def refreshed(fields: DataFrame, reports: DataFrame) -> DataFrame:
    """document_id, name, old, new, error of fields whose review reason changes with a recomputed report. fields: document_id, name,
    confidence, reviewed, reason; reports: document_id, report. A document whose report failed keeps its reasons and tells the error."""
    from folio.operators.reconcile import routed

    rows = routed(fields.join(reports, "document_id"), F.col("report"))
    broken = F.col("report.error").isNotNull()
    new = F.when(broken | F.col("reviewed"), F.col("reason")).otherwise(F.col("review_reason"))
    return rows.withColumn("new", new).where(broken | ~F.col("reason").eqNullSafe(F.col("new"))).select("document_id", "name", F.col("reason").alias("old"), "new", F.col("report.error").alias("error"))
