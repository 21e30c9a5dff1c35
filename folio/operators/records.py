"""Records: the latest extraction of each document, its fields with corrections laid over them, and questions about them.

Tables: documents (id, status, filename, created_at), extractions (id, document_id, created_at), fields (extraction_id,
field_name, value, review_action, corrected_value, needs_review, reviewed_at); value is a leaf {"value": ..., "confidence": ...} and
corrected_value a bare value, both as JSON text. A value of a column here is JSON text too, until it is tested or shown.

Tests have three values: null or missing is FALSE, the expected type is tested, and any other type is unknown (null). settled()
answers the unknown ones by the value's text, so one pass gives the whole answer.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import money as M
from folio.operators import relational as R

FIELDS = ("vendor_name", "currency", "total", "document_date")


def latest_extractions(documents: DataFrame, extractions: DataFrame, scope: Sequence | None = None) -> DataFrame:
    """document_id, extraction_id, filename, created_at of extracted documents, with their newest extraction (the larger id
    among those of one time). scope: only these documents; an empty one gives none."""
    docs = documents.where("status = 'extracted'").select(F.col("id").alias("document_id"), "filename", "created_at")
    if scope is not None:
        docs = docs.where(F.col("document_id").isin(list(scope)))
    newest = extractions.groupBy("document_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("extraction_id"))
    return docs.join(newest, "document_id")


def value_of(value: Column, action: Column, corrected: Column) -> Column:
    """A field's verified value as JSON text: a correction, even to null, wins over the leaf's value; what isn't a leaf is null."""
    leaf = F.try_variant_get(F.try_parse_json(value), "$.value", "variant")
    return F.to_json(F.when(action == "corrected", F.try_parse_json(corrected)).otherwise(leaf))


def kind_of(value: Column) -> Column:
    """text, number, truth, list, object or null (also for a missing value)."""
    v = F.ltrim(value)
    first = F.substring(v, 1, 1)
    return F.when(v.isNull() | (v == "null"), "null").when(first == '"', "text").when(first == "[", "list").when(first == "{", "object").when(first.isin("t", "f"), "truth").otherwise("number")


def text_of(value: Column) -> Column:
    """The characters of a text value, else null."""
    return F.when(kind_of(value) == "text", F.try_variant_get(F.try_parse_json(value), "$", "string"))


def total_of(value: Column) -> Column:
    """The usable amount of a number, or of a text that is a plain decimal; else null."""
    number = F.when(kind_of(value) == "number", F.try_variant_get(F.try_parse_json(value), "$", "decimal(38,6)"))
    return M.usable(F.coalesce(number, M.to_decimal(text_of(value))))


def fields_of(latest: DataFrame, fields: DataFrame) -> DataFrame:
    """document_id, filename, created_at, field_name, value, pending (flagged, and not reviewed yet)."""
    own = fields.select("extraction_id", "field_name", value_of(F.col("value"), F.col("review_action"), F.col("corrected_value")).alias("value"), (F.col("needs_review") & F.col("reviewed_at").isNull()).alias("pending"))
    return latest.join(own, "extraction_id").select("document_id", "filename", "created_at", "field_name", "value", "pending")


def facts(latest: DataFrame, fields: DataFrame, names: Sequence[str] = FIELDS) -> DataFrame:
    """One row per document: document_id, filename, created_at, a column of JSON text for each name (of a repeated field the first
    in order of its text)."""
    rows = fields_of(latest, fields.where(F.col("field_name").isin(list(names))))
    return rows.groupBy("document_id", "filename", "created_at").agg(*(F.min(F.when(F.col("field_name") == n, F.col("value"))).alias(n) for n in names))


def loaded(latest: DataFrame, fields: DataFrame) -> DataFrame:
    """Whole records: document_id, filename, created_at, fields (a map), low_confidence (names still to be reviewed, sorted)."""
    rows = fields_of(latest, fields)
    once = rows.groupBy("document_id", "filename", "created_at", "field_name").agg(F.min("value").alias("value"), F.bool_or("pending").alias("pending"))
    pair = F.struct(F.col("field_name").alias("key"), "value")
    return once.groupBy("document_id", "filename", "created_at").agg(F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("fields"), F.array_sort(F.collect_list(F.when(F.col("pending"), F.col("field_name")))).alias("low_confidence"))


def rows_of(value: Column, cells: Sequence[str]) -> Column:
    """Rows of a stored array of cells: an array of structs with the JSON text of each cell's value; a row that is no object has
    null cells, what is no array is null."""
    item = lambda x: F.struct(*(F.to_json(F.try_variant_get(x, f"$.{c}.value", "variant")).alias(c) for c in cells))
    return F.transform(F.try_variant_get(F.try_parse_json(value), "$", "array<variant>"), item)


def shown_lines(record: Column, names: Sequence[str]) -> Column:
    """Lines for display: (field, text) of each named field that the record has, in order of the names."""
    shown = lambda v: F.coalesce(text_of(v), v)
    lines = F.array(*(F.struct(F.lit(n).alias("field"), shown(F.try_element_at(record, F.lit(n))).alias("text")) for n in names))
    return F.filter(lines, lambda x: x["text"].isNotNull() & (x["text"] != "null"))


def tested(value: Column, test) -> Column:
    """Three values: null FALSE, text tested, any other type unknown."""
    kind = kind_of(value)
    return F.when(kind == "text", test(text_of(value))).when(kind == "null", F.lit(False))


def settled(answer: Column, value: Column, test) -> Column:
    """answer, and where it is unknown the test of the value's text (that of zero, false and empty lists is empty)."""
    plain = F.when(value.isin("0", "false", "[]", "{}", "0.0"), "").when(value == "true", "True").otherwise(value)
    return F.coalesce(answer, test(plain), F.lit(False))


@dataclass(frozen=True)
class Question:
    """Filters of a question; an empty text filters nothing."""

    vendor: str | None = None
    currency: str | None = None
    first_day: str | None = None
    last_day: str | None = None
    least: str | None = None
    most: str | None = None

    def impossible(self) -> bool:
        """Whether a text can't occur in stored values: it has a NUL or half a surrogate pair."""
        return any(any(c == "\0" or 0xD800 <= ord(c) < 0xE000 for c in x or "") for x in (self.vendor, self.currency))


def matching(rows: DataFrame, q: Question) -> DataFrame:
    """facts() that match, with vendor, code and amount for what follows."""
    out = rows.withColumns({"vendor": text_of(F.col("vendor_name")), "code": text_of(F.col("currency")), "amount": total_of(F.col("total"))})
    if q.impossible():
        return out.limit(0)
    if q.vendor:
        test = lambda x: R.contains_text(x, q.vendor)
        out = out.where(settled(tested(F.col("vendor_name"), test), F.col("vendor_name"), test))
    if q.currency:
        test = lambda x: R.equals_text(x, q.currency)
        out = out.where(settled(tested(F.col("currency"), test), F.col("currency"), test))
    if q.first_day or q.last_day:
        test = lambda x: F.coalesce(R.dated_within(x, q.first_day, q.last_day), F.lit(False))
        out = out.where(F.coalesce(tested(F.col("document_date"), test), F.lit(False)))
    if q.least is not None or q.most is not None:
        out = out.where(R.total_within(F.col("amount"), q.least, q.most))
    return out


def totals(found: DataFrame) -> DataFrame:
    """currency, n_documents, missing_total, sum_total of matching(); a group without a usable total has no sum."""
    return R.currency_totals(found, "code", "amount")


def listing(found: DataFrame, limit: int = 20) -> DataFrame:
    return found.orderBy("created_at", "filename", "document_id").limit(max(1, min(50, limit)))


def sentence(summed: DataFrame) -> DataFrame:
    """One row: the sums in words, by currency."""
    part = F.concat(F.col("currency"), F.lit(" "), F.coalesce(M.plain_string(F.col("sum_total"), 2), F.lit("no total")), F.lit(" ("), F.col("n_documents").cast("string"), F.lit(")"))
    return summed.agg(F.array_join(F.array_sort(F.collect_list(part)), "; ").alias("answer"))
