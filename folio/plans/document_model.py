"""Queries over the document model, which is derived here from the driver's tables: orders as documents with one to three extractions
each, whose fields are leaves of JSON, some null, of another type, corrected or still to be reviewed. Each query has an SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import normalize as N
from folio.functions import text as T
from folio.operators import merge as G
from folio.operators import records as C

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    """Registers a query with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents, extractions, fields."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    k = F.col("o_orderkey")
    orders = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "c_mktsegment", "o_orderdate", F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"))
    documents = orders.select(k.alias("id"), F.when(k % 10 == 0, "failed").otherwise("extracted").alias("status"), F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("filename"), F.col("o_orderdate").alias("created_at"))
    every = F.filter(F.array(F.lit(0), F.when(k % 3 == 0, 1), F.when(k % 6 == 0, 2)), lambda x: x.isNotNull())
    runs = orders.withColumn("n", F.explode(every)).withColumn("extraction_id", k * 10 + F.col("n"))
    extractions = runs.select(F.col("extraction_id").alias("id"), k.alias("document_id"), F.date_add(F.col("o_orderdate").cast("date"), F.least(F.col("n"), F.lit(1))).alias("created_at"))
    leaf = lambda v: F.concat(F.lit('{"value": '), v, F.lit(', "confidence": 0.9}'))
    text = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    vendor = F.when(k % 8 == 0, "null").when(k % 8 == 1, "42").otherwise(text(F.concat(F.lit("Vendor#"), (F.col("o_custkey") % 100).cast("string"))))
    code = F.when(k % 9 == 0, text(F.lit("  "))).otherwise(text(F.lower("c_mktsegment")))
    price = F.when(k % 7 == 0, text(F.concat(F.lit(" "), F.col("price")))).when(k % 7 == 1, text(F.lit("n/a"))).otherwise(F.col("price"))
    day = F.when(k % 17 == 0, text(F.date_format("o_orderdate", "yyyyMMdd"))).otherwise(text(F.date_format("o_orderdate", "yyyy-MM-dd")))
    none, no = F.lit(None).cast("string"), F.lit(False)
    corrected = F.when(k % 7 == 2, "corrected")
    row = lambda name, value, action, fixed, flagged: F.struct(F.lit(name).alias("field_name"), leaf(value).alias("value"), action.alias("review_action"), fixed.alias("corrected_value"), flagged.alias("needs_review"))
    fields = F.array(
        row("vendor_name", vendor, none, none, no),
        row("currency", code, F.when(k % 9 == 1, "corrected"), text(F.lit("EUR")), no),
        row("total", price, F.when(F.col("n") == 0, corrected).otherwise("approved"), F.lit("null"), k % 5 == 0),
        row("document_date", day, none, none, k % 4 == 0),
    )
    rows = runs.select("extraction_id", F.explode(fields).alias("f")).select("extraction_id", "f.*").withColumn("reviewed_at", F.when(F.col("review_action").isNotNull(), F.lit("2024-01-01").cast("timestamp_ntz")))
    return documents, extractions, rows


MODEL = """WITH o AS (SELECT o_orderkey AS k, o_custkey, c_mktsegment, o_orderdate, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders JOIN customer ON o_custkey = c_custkey),
latest AS (SELECT k AS document_id, 'f' || o_custkey AS filename, o_orderdate AS created_at, CASE WHEN k % 6 = 0 THEN 2 WHEN k % 3 = 0 THEN 1 ELSE 0 END AS n, * FROM o WHERE k % 10 <> 0),
facts AS (SELECT document_id, filename, created_at, n, k,
  CASE WHEN k % 8 = 0 THEN NULL WHEN k % 8 = 1 THEN '42' ELSE 'Vendor#' || (o_custkey % 100) END AS vendor_text,
  CASE WHEN k % 9 = 1 THEN 'EUR' WHEN k % 9 = 0 THEN '  ' ELSE lower(c_mktsegment) END AS code,
  CASE WHEN k % 7 = 2 AND n = 0 THEN NULL WHEN k % 7 = 1 THEN NULL ELSE price END AS amount,
  CASE WHEN k % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day,
  CASE WHEN k % 7 = 2 AND n = 0 THEN 'null' WHEN k % 7 = 0 THEN '" ' || price || '"' WHEN k % 7 = 1 THEN '"n/a"' ELSE NULL END AS shown FROM latest)
"""
GROUPS = "SELECT coalesce(nullif(upper(trim(code)), ''), 'unknown currency') AS currency, count(*) AS n_documents, count(*) FILTER (WHERE amount IS NULL) AS missing_total, CAST(sum(amount) AS DOUBLE) AS sum_total FROM facts"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, extractions, fields = model(spark, sf_dir)
    return C.facts(C.latest_extractions(documents, extractions), fields)


def _summed(found: DataFrame) -> DataFrame:
    return C.totals(found).withColumn("sum_total", F.col("sum_total").cast("double"))


@query(MODEL + "SELECT document_id, k * 10 + n AS extraction_id, filename FROM latest")
def rec_latest_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, extractions, _ = model(spark, sf_dir)
    return C.latest_extractions(documents, extractions).select("document_id", "extraction_id", "filename")


@query(MODEL + GROUPS + " GROUP BY 1")
def fq_record_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summed(C.matching(_facts(spark, sf_dir), C.Question()))


@query(MODEL + GROUPS + """ WHERE contains(lower(coalesce(vendor_text, '')), '2') AND day BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'
AND coalesce(amount BETWEEN 1000 AND 250000, false) GROUP BY 1""")
def fq_record_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors that hold a 2, numbers read as their text included, in some years, within bounds of the total."""
    return _summed(C.matching(_facts(spark, sf_dir), C.Question(vendor="2", first_day="1994-01-01", last_day="1996-12-31", least="1000", most="250000")))


@query(MODEL + "SELECT document_id, filename, CAST(amount AS DOUBLE) AS amount FROM facts WHERE upper(code) = 'EUR' ORDER BY created_at, filename, document_id LIMIT 20")
def fq_record_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.listing(C.matching(_facts(spark, sf_dir), C.Question(currency="eur")))
    return found.select("document_id", "filename", F.col("amount").cast("double").alias("amount"))


@query(MODEL + ", g AS (" + GROUPS.replace("CAST(sum(amount) AS DOUBLE)", "CAST(sum(amount) AS DECIMAL(38,2))") + " GROUP BY 1) SELECT string_agg(currency || ' ' || coalesce(CAST(sum_total AS VARCHAR), 'no total') || ' (' || n_documents || ')', '; ' ORDER BY currency || ' ' || coalesce(CAST(sum_total AS VARCHAR), 'no total')) AS answer FROM g")
def fq_record_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sentence(C.totals(C.matching(_facts(spark, sf_dir), C.Question())))


@query(MODEL + """SELECT document_id, concat_ws(',', CASE WHEN k % 4 = 0 THEN 'document_date' END, CASE WHEN k % 5 = 0 AND n = 0 AND k % 7 <> 2 THEN 'total' END) AS low_confidence, 4 AS n_fields FROM latest""")
def rec_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole records with the names of fields that still wait for review."""
    documents, extractions, fields = model(spark, sf_dir)
    rows = C.loaded(C.latest_extractions(documents, extractions), fields)
    return rows.select("document_id", F.array_join("low_confidence", ",").alias("low_confidence"), F.size("fields").alias("n_fields"))


@query(MODEL + """SELECT document_id, concat_ws('|', CASE WHEN vendor_text IS NOT NULL THEN 'vendor_name=' || vendor_text END, CASE WHEN shown IS NULL THEN 'total=' || rtrim(rtrim(CAST(amount AS VARCHAR), '0'), '.') WHEN shown = 'null' THEN NULL ELSE 'total=' || trim(shown, '"') END) AS lines FROM facts""")
def rec_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines for display of two fields of every document."""
    documents, extractions, fields = model(spark, sf_dir)
    rows = C.loaded(C.latest_extractions(documents, extractions), fields)
    lines = C.shown_lines(F.col("fields"), ["vendor_name", "total"])
    return rows.select("document_id", F.array_join(F.transform(lines, lambda x: F.concat(x["field"], F.lit("="), x["text"])), "|").alias("lines"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE CAST(CAST(l_quantity AS DECIMAL(18,2)) AS DOUBLE) END AS quantity,
CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE 'part ' || l_partkey END AS description FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity) = 1""")
def rec_array_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items stored as one array of leaves per order, read back; every fourth is no object."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("decimal(18,2)").alias("q"))
    once = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "q")).alias("x"))
    cell = F.concat(F.lit('{"quantity": {"value": '), F.col("x.q").cast("string"), F.lit('}, "description": {"value": "part '), F.col("x.l_partkey").cast("string"), F.lit('"}}'))
    item = F.when(F.col("l_linenumber") % 4 == 0, F.lit('"no object"')).otherwise(cell)
    stored = once.withColumn("item", item).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "item"))).alias("items"))
    stored = stored.select("l_orderkey", F.col("items.l_linenumber").alias("numbers"), F.concat(F.lit("["), F.array_join("items.item", ","), F.lit("]")).alias("value"))
    rows = stored.select("l_orderkey", "numbers", F.posexplode(C.rows_of(F.col("value"), ["quantity", "description"])).alias("i", "r"))
    return rows.select("l_orderkey", F.get("numbers", "i").alias("l_linenumber"), C.total_of(F.col("r.quantity")).cast("double").alias("quantity"), C.text_of(F.col("r.description")).alias("description"))


# search forms

SAMPLES = ["Total: 27,82 EUR", "Total: 1.234,56 EUR", "$1,234.56 due", "$1,234", "Subtotal: 2,95 EUR  Total: 5,90 EUR", "Detroit, MI 48201", "Bend, OR", "in, or out", "v1.2.3,44,5", "12 pounds and 3 euros, twice 27,82 27,82", "Paris, XX", ""]


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, each with a receipt's line after its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    line = F.get(F.array(*map(F.lit, SAMPLES)), F.pmod(F.col("doc_id"), F.lit(len(SAMPLES))).cast("int"))
    return docs.select("doc_id", F.concat(F.col("text"), F.lit("\n"), line).alias("text"))


# a pattern without look-around takes the marks beside an amount along, so each of them is doubled first
DOUBLED = r"regexp_replace(text, '([^0-9.,])', '\1\1', 'g')"
EU_SQL = rf"list_transform(regexp_extract_all({DOUBLED}, '(?:^|[^0-9.,])((?:[0-9]{{1,3}}(?:\.[0-9]{{3}})+|[0-9]+),[0-9]{{2}})(?:$|[^0-9,])', 1), lambda m: replace(replace(m, '.', ''), ',', '.'))"
US_SQL = rf"list_transform(regexp_extract_all({DOUBLED}, '(?:^|[^0-9.,])([0-9]{{1,3}}(?:,[0-9]{{3}})+(?:\.[0-9]{{2}})?)(?:$|[^0-9,])', 1), lambda m: replace(m, ',', ''))"
WORDS_SQL = r"""list_filter([CASE WHEN regexp_matches(text, '(?i)€|\bEUR\b|\beuros?\b') THEN 'euro' END, CASE WHEN regexp_matches(text, '(?i)\$|\bUSD\b|\bdollars?\b') THEN 'dollar' END,
CASE WHEN regexp_matches(text, '(?i)£|\bGBP\b|\bpounds?\b') THEN 'pound' END], lambda x: x IS NOT NULL)"""
STATES_SQL = r"""list_filter(list_transform(regexp_extract_all(text, '(?m),[ \t]*([A-Z]{2})(?:[ \t]+[0-9]{5}(?:-[0-9]{4})?)?[ \t]*$', 1), lambda c: CASE c WHEN 'MI' THEN 'michigan' WHEN 'OR' THEN 'oregon' END), lambda x: x IS NOT NULL)"""
SAMPLE_SQL = "WITH t AS (SELECT doc_id, text || chr(10) || [" + ", ".join("'" + x + "'" for x in SAMPLES) + f"][1 + doc_id % {len(SAMPLES)}] AS text FROM documents)\n"


def _joined(c: F.Column) -> F.Column:
    return F.array_join(c, "|")


@query(SAMPLE_SQL + f"SELECT doc_id, coalesce(array_to_string({EU_SQL}, '|'), '') AS amounts FROM t")
def txt_eu_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", _joined(N.eu_amounts(F.col("text"))).alias("amounts"))


@query(SAMPLE_SQL + f"SELECT doc_id, coalesce(array_to_string({US_SQL}, '|'), '') AS amounts FROM t")
def txt_us_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", _joined(N.us_amounts(F.col("text"))).alias("amounts"))


@query(SAMPLE_SQL + f"SELECT doc_id, coalesce(array_to_string({WORDS_SQL}, '|'), '') AS words FROM t")
def txt_currency_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", _joined(N.currency_words(F.col("text"))).alias("words"))


@query(SAMPLE_SQL + f"SELECT doc_id, coalesce(array_to_string({STATES_SQL}, '|'), '') AS states FROM t")
def txt_city_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", _joined(N.state_names(F.col("text"))).alias("states"))


@query(SAMPLE_SQL + f", a AS (SELECT doc_id, {EU_SQL} || {US_SQL} || {WORDS_SQL} || {STATES_SQL} AS l FROM t) SELECT doc_id, nullif(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' '), '') AS aliases FROM a")
def txt_dedup_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", N.search_aliases(F.col("text")).alias("aliases"))


# chunks

@query("SELECT CAST(1.0 AS DOUBLE) AS intact, 0 AS too_long")
def txt_chunk_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the chunks of all whole documents: the share whose span holds the chunk's text in the stored page (1 if there are none),
    and the chunks over the limit."""
    pages = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cited = T.chunks(pages).withColumn("_page", F.expr("substring(text, char_start + 1, char_end - char_start)"))
    return cited.agg(F.coalesce(F.avg((F.col("_page") == F.col("chunk")).cast("int")), F.lit(1.0)).alias("intact"), F.count_if(F.length("chunk") > T.MAX_CHARS).cast("int").alias("too_long"))


# page merge

PAGES = """WITH p AS (SELECT user_id AS document_id, event_type AS field_name, event_id AS page, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 3 = 0 THEN lower('V' || (event_id % 2)) ELSE ' V' || (event_id % 2) END AS value,
  CAST(event_id % 4 AS DOUBLE) / 4 AS confidence, CASE WHEN event_id % 3 <> 1 THEN 'q' || event_id END AS quote FROM events),
n AS (SELECT *, lower(trim(value)) AS norm FROM p),
w AS (SELECT * FROM n WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id, field_name ORDER BY confidence DESC, page) = 1),
c AS (SELECT n.document_id, n.field_name, n.page AS cited_page, n.quote AS cited FROM n JOIN w USING (document_id, field_name) WHERE n.quote IS NOT NULL AND n.norm = w.norm QUALIFY row_number() OVER (PARTITION BY n.document_id, n.field_name ORDER BY n.confidence DESC, n.page) = 1),
g AS (SELECT document_id, field_name, min(confidence) AS low, count(DISTINCT norm) AS kinds FROM n GROUP BY 1, 2)
SELECT g.document_id, g.field_name, w.value, CASE WHEN kinds = 0 THEN low WHEN kinds > 1 THEN least(w.confidence, 0.5) ELSE w.confidence END AS confidence,
  CASE WHEN w.quote IS NOT NULL THEN w.page ELSE cited_page END AS page, coalesce(w.quote, cited) AS quote
FROM g LEFT JOIN w USING (document_id, field_name) LEFT JOIN c USING (document_id, field_name)"""


@query(PAGES)
def mrg_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pages of users' documents: one merged leaf per document and field, with ties, nulls, disagreement and borrowed
    evidence."""
    e, i = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    word = F.concat(F.lit("V"), (i % 2).cast("string"))
    value = F.when(i % 5 == 0, "null").when(i % 3 == 0, F.concat(F.lit('"'), F.lower(word), F.lit('"'))).otherwise(F.concat(F.lit('" '), word, F.lit('"')))
    pages = e.select(F.col("user_id").alias("document_id"), F.col("event_type").alias("field_name"), i.alias("page"), value.alias("value"), ((i % 4).cast("double") / 4).alias("confidence"), F.when(i % 3 != 1, F.concat(F.lit("q"), i.cast("string"))).alias("quote"))
    out = G.merged_scalars(pages)
    return out.select("document_id", "field_name", C.text_of(F.col("value")).alias("value"), "confidence", F.col("evidence.page").alias("page"), F.col("evidence.quote").alias("quote"))


@query("""WITH p AS (SELECT user_id AS document_id, event_id AS page, CASE WHEN event_id % 4 = 0 THEN NULL ELSE [event_id, event_id + 1] END AS items, CAST(event_id % 10 AS DOUBLE) / 10 AS confidence FROM events)
SELECT document_id, coalesce(array_to_string(flatten(list(items ORDER BY page) FILTER (WHERE items IS NOT NULL)), ','), '') AS items, coalesce(min(confidence) FILTER (WHERE items IS NOT NULL), 0.0) AS confidence FROM p GROUP BY 1""")
def mrg_page_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    value = F.when(i % 4 == 0, '"no list"').otherwise(F.concat(F.lit("["), i.cast("string"), F.lit(","), (i + 1).cast("string"), F.lit("]")))
    pages = e.select(F.col("user_id").alias("document_id"), F.lit("items").alias("field_name"), i.alias("page"), value.alias("value"), ((i % 10).cast("double") / 10).alias("confidence"))
    out = G.merged_arrays(pages)
    return out.select("document_id", F.translate("value", "[]", "").alias("items"), "confidence")
