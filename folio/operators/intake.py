"""Taking in what a model answered: which leaves are malformed, what is stored of each field, and where its quotes stand.

An answer is JSON text; a leaf is {"value": ..., "confidence": ..., "evidence": {"page": ..., "quote": ...}}. A schema maps field names
to None (one leaf) or, for a field that holds rows, to the names of a row's cells. An answer is parsed once; the walk over it is made of
expressions, one for each path that the schema allows.

Cases: a null or broken answer, or one that is no object, lacks every field; a leaf without a value key, or whose confidence
is no finite number (a text or a truth that reads as one counts), is malformed, also if its value is null; a row that is no object lacks all its
cells; bad evidence is never a violation, it counts as none.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions import masking
from folio.functions.text import let
from folio.operators.corrections import masked_leaf

Schema = Mapping[str, Sequence[str] | None]

#: Violations that are shown at once.
SHOWN = 20
# The longest quote and the highest page that count as evidence, and the reason of a field that isn't sure enough.
LONGEST_QUOTE, LAST_PAGE, UNSURE = 200, 10_000, "confidence"
OUTER = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
SPACE = r"(?U)[\s\x1c-\x1f]+"
# A leaf's own keys, read in one pass, and the rows of a list by cell; what is no object is null.
LEAF = "struct<value:variant,confidence:variant>"
ROWS = f"array<map<string,{LEAF}>>"


def part(leaf: Column, key: str, kind: str = "variant") -> Column:
    """What a leaf has under a key; all of it for "$"."""
    return F.try_variant_get(leaf, "$" if key == "$" else f"$.{key}", kind)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _finite(raw: Column) -> Column:
    """A confidence as a finite number, else null; each of its parts is read once."""

    def read(x: Column) -> Column:
        words = F.regexp_replace(F.regexp_replace(F.try_variant_get(x, "$", "string"), OUTER, ""), r"(?<=\d)_(?=\d)", "")
        text = let(words, lambda t: F.when(t.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), t.try_cast("double")))
        # as JSON, since a variant's cast to a number costs far more than a text's
        plain = lambda j: F.when(j.startswith('"'), text).when(j == "true", 1.0).when(j == "false", 0.0).when(j.rlike("^-?[0-9]"), j.try_cast("double"))
        return let(let(F.to_json(x), plain), lambda n: F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n))

    return let(raw, read)


def confidence_of(leaf: Column) -> Column:
    """A leaf's confidence as a finite number, else null."""
    return _finite(part(leaf, "confidence"))


def _whole(parts: Column) -> Column:
    """Whether a leaf that was read as LEAF is well formed."""
    return F.coalesce(parts["value"].isNotNull() & _finite(parts["confidence"]).isNotNull(), F.lit(False))


def well_formed(leaf: Column) -> Column:
    return let(part(leaf, "$", LEAF), _whole)


def rows_in(leaf: Column) -> Column:
    """The rows of a leaf whose value is a list, else null."""
    return F.try_variant_get(leaf, "$.value", "array<variant>")


def _paths(answer: Column, schema: Schema) -> Column:
    none = F.array().cast("array<string>")

    def of_field(name: str, cells: Sequence[str] | None) -> Column:
        inside = none
        if cells is not None:
            prefix = lambda i: F.concat(F.lit(f"{name}.value["), i.cast("string"), F.lit("]."))
            broken = lambda x, c: ~let(F.try_element_at(x, F.lit(c)), _whole)
            row = lambda x, i: F.array_compact(F.array(*(F.when(broken(x, c), F.concat(prefix(i), F.lit(c))) for c in cells)))
            inside = F.coalesce(F.flatten(F.transform(part(answer, f"{name}.value", ROWS), row)), none)
        return F.when(let(part(answer, name, LEAF), _whole), inside).otherwise(F.array(F.lit(name)))

    return F.concat(*(of_field(name, cells) for name, cells in schema.items()))


def violations(answer: Column, schema: Schema) -> Column:
    """All dotted paths at which an answer breaks the schema, in the schema's order: a field, or field.value[row].cell."""
    return let(F.try_parse_json(answer), lambda v: _paths(v, schema))


def listed(paths: Column, most: int = SHOWN) -> Column:
    """Paths as lines for display; beyond `most` only their number is told."""
    lines = F.transform(F.slice(paths, 1, most), lambda p: F.concat(F.lit("- "), p))
    rest = F.size(paths) - most
    return F.array_join(F.concat(lines, F.when(rest > 0, F.array(F.concat(F.lit("- … ("), rest.cast("string"), F.lit(" more)")))).otherwise(F.array().cast("array<string>"))), "\n")


def evidence_of(leaf: Column, pages: Column | None = None) -> Column:
    """struct<page, quote> of a leaf, or null: a quote of 1 to LONGEST_QUOTE characters between its outer blanks, and a page key that
    is null or a whole number up to LAST_PAGE. pages, if given, is how many pages the document has (null for a picture, whose
    quotes all stand on page 1): a page that the document doesn't have becomes null, its quote stays."""
    raw = F.try_variant_get(leaf, "$.evidence.quote", "variant")
    quote = F.when(_kind(raw) == "STRING", F.regexp_replace(F.try_variant_get(raw, "$", "string"), OUTER, ""))
    page = F.try_variant_get(leaf, "$.evidence.page", "variant")
    number = F.when(_kind(page) == "BIGINT", F.try_variant_get(page, "$", "bigint"))
    if pages is None:
        kept, fits = number, page.isNotNull() & (F.is_variant_null(page) | F.coalesce(number.between(1, LAST_PAGE), F.lit(False)))
    else:
        kept, fits = F.when(pages.isNull(), 1).when(number.between(1, pages), number), F.lit(True)
    good = fits & F.length(quote).between(1, LONGEST_QUOTE)
    return F.when(good, F.struct(kept.cast("int").alias("page"), quote.alias("quote")))


def stored_leaf(leaf: Column, field: Column, pages: Column | None = None) -> Column:
    """struct<value (JSON text), confidence, page, quote> as stored: confidence kept within 0 and 1, card numbers masked in the
    payment fields' texts and in all quotes; a malformed leaf is null with confidence 0 and without evidence."""
    value, evidence = part(leaf, "value"), evidence_of(leaf, pages)
    text = F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))
    shown, quote = masked_leaf(field, text, evidence["quote"])
    digits = F.right(masking.folded_digits(F.try_variant_get(value, "$", "string")), F.lit(4))
    shown = F.when(field == "payment_card_last4", F.when(F.length(digits) == 4, digits)).otherwise(shown)
    # of the payment fields only texts are kept; elsewhere any value is
    as_json = F.when(shown.isNotNull(), _quoted(shown)).when(field.startswith("payment_") | F.is_variant_null(value), F.lit("null")).otherwise(F.to_json(value))
    whole = well_formed(leaf)
    sure = F.least(F.greatest(confidence_of(leaf), F.lit(0.0)), F.lit(1.0))
    told = lambda value, sure, page, quote: F.struct(value.alias("value"), sure.alias("confidence"), page.alias("page"), quote.alias("quote"))
    # judged once for all parts
    return F.when(whole, told(as_json, sure, evidence["page"], quote)).otherwise(told(F.lit("null"), F.lit(0.0), F.lit(None).cast("int"), F.lit(None).cast("string")))


def _quoted(text: Column) -> Column:
    """A text as JSON."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def leaves(answers: DataFrame, key: str, schema: Schema) -> tuple[DataFrame, DataFrame | None]:
    """key, pages, field_name, row, cell, place, leaf of each leaf that the schema asks for: fields (row and cell null), and the cells of
    each row of fields that hold rows (None if none do). answers: key, answer, perhaps pages (how many the document has)."""
    pages = F.col("pages").cast("int") if "pages" in answers.columns else F.lit(None).cast("int")
    held = answers.select(key, pages.alias("pages"), F.try_parse_json("answer").alias("_v"))
    own = F.array(*(F.struct(F.lit(n).alias("field_name"), part(F.col("_v"), n).alias("leaf")) for n in schema))
    nothing = [F.lit(None).cast("int").alias("row"), F.lit(None).cast("string").alias("cell"), F.lit(0).alias("place")]
    fields, out = held.select(key, "pages", F.explode(own).alias("_x")).select(key, "pages", "_x.field_name", *nothing, "_x.leaf"), None
    for name, cells in schema.items():
        if cells is None:
            continue
        leaf = part(F.col("_v"), name)
        rows = held.select(key, "pages", F.posexplode_outer(F.when(well_formed(leaf), rows_in(leaf))).alias("row", "_r")).where("row is not null")
        inner = F.array(*(F.struct(F.lit(c).alias("cell"), F.lit(i).alias("place"), part(F.col("_r"), c).alias("leaf")) for i, c in enumerate(cells)))
        held_cells = rows.select(key, "pages", "row", F.explode(inner).alias("_x")).select(key, "pages", F.lit(name).alias("field_name"), "row", "_x.cell", "_x.place", "_x.leaf")
        out = held_cells if out is None else out.unionByName(held_cells)
    return fields, out


def fields(answers: DataFrame, key: str, schema: Schema, threshold: float, paged: bool = True) -> DataFrame:
    """One row for each answer and field of the schema: key, field_name, value, confidence, needs_review, review_reason. value is JSON
    text: the leaf as stored, with its evidence if `paged`; of a field that holds rows a list of rows of stored cells. Each key
    stands for one answer. Leaves are judged as rows of one table, so one long list is no one's task."""
    own, within = leaves(answers, key, schema)
    paging = F.col("pages") if "pages" in answers.columns else None
    cited = F.when(F.col("_s.quote").isNotNull(), F.to_json(F.struct(F.col("_s.page").alias("page"), F.col("_s.quote").alias("quote")), {"ignoreNullFields": "false"})).otherwise("null")
    text = F.concat(F.lit('{"value":'), F.col("_s.value"), F.lit(',"confidence":'), F.col("_s.confidence").cast("string"), *([F.lit(',"evidence":'), cited] if paged else []), F.lit("}"))
    stored = lambda told: told.withColumn("_s", stored_leaf(F.col("leaf"), F.col("field_name"), paging)).select(key, "field_name", "row", "cell", "place", text.alias("text"), F.col("_s.confidence").alias("confidence"))
    lists = [n for n, cells in schema.items() if cells is not None]
    cell = F.concat(F.lit('"'), F.col("cell"), F.lit('":'), F.col("text"))
    joined = lambda parts, a, b: F.concat(F.lit(a), F.array_join(F.transform(F.array_sort(F.collect_list(parts)), lambda x: x["t"]), ","), F.lit(b))
    whole = stored(own)
    rows = None if within is None else stored(within).groupBy(key, "field_name", "row").agg(joined(F.struct("place", cell.alias("t")), "{", "}").alias("t"))
    if rows is not None:
        whole = whole.join(rows.groupBy(key, "field_name").agg(joined(F.struct("row", "t"), "[", "]").alias("_rows")), [key, "field_name"], "left")
    value = F.when(F.col("field_name").isin(*lists), F.coalesce("_rows", F.lit("[]"))).otherwise(F.col("text")) if lists else F.col("text")
    unsure = F.col("confidence") < threshold
    return whole.select(key, "field_name", value.alias("value"), "confidence", unsure.alias("needs_review"), F.when(unsure, UNSURE).alias("review_reason"))


def collapsed(text: Column) -> Column:
    """A text with each stretch of white space as one blank, and one at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(text, SPACE, " ")), F.lit(" "))


def located(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """quotes (document_id, quote and more) with `found`: the first page of its document that holds a quote's words in a row, white
    space aside; null if none does. pages: document_id, page, text.

    A quote meets only pages that hold its rarest word: of the words of quotes it is the one on the fewest pages of the document,
    so quotes and pages of one document are not all compared. White space counts as one blank, letters as they are."""
    asked = quotes.select("document_id", F.array_distinct(F.filter(F.split(collapsed(F.col("quote")), " "), lambda w: w != "")).alias("ws"), "quote").distinct()
    words = asked.select("document_id", "quote", F.explode_outer("ws").alias("w")).where("w is not null")
    wanted = words.select("document_id", "w").distinct()
    said = pages.select("document_id", "page", F.explode_outer(F.array_distinct(F.split(collapsed(F.col("text")), " "))).alias("w")).join(wanted, ["document_id", "w"]).distinct()
    held = said.groupBy("document_id", "w").agg(F.count("*").alias("on"))
    # a quote with a word that no page has stands nowhere
    rare = words.join(held, ["document_id", "w"], "left").groupBy("document_id", "quote").agg(F.min(F.struct(F.coalesce("on", F.lit(0)).alias("on"), "w")).alias("r")).where("r.on > 0")
    pairs = rare.select("document_id", "quote", F.col("r.w").alias("w")).join(said, ["document_id", "w"]).select("document_id", "quote", "page")
    good = pairs.join(pages.select("document_id", "page", "text"), ["document_id", "page"]).where(F.contains(collapsed(F.col("text")), collapsed(F.col("quote"))))
    return quotes.join(good.groupBy("document_id", "quote").agg(F.min("page").alias("found")), ["document_id", "quote"], "left")


def placed(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """quotes (document_id, page, quote and more) whose page is mended: it stays if that page holds the quote, else it becomes the
    first page that does, or null."""
    both = located(quotes, pages).join(pages.select("document_id", "page", F.col("text").alias("_text")), ["document_id", "page"], "left")
    stays = F.coalesce(F.contains(collapsed(F.col("_text")), collapsed(F.col("quote"))), F.lit(False))
    return both.select(*(F.when(stays, F.col("page")).otherwise(F.col("found")).alias("page") if c == "page" else F.col(c) for c in quotes.columns))
