"""Queries over the driver's tables, each with its SQL twin. The operators come from folio.operators and folio.functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import masking
from folio.functions import money as M
from folio.operators import relational as R
from folio.operators import search as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Tables of one folder, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(sql: str, day: str | None = None):
    """Registers a query with its SQL. day: a date column, shown as text by both."""

    def add(f):
        key = f.__name__
        shown = (lambda df: df.withColumn(day, F.col(day).cast("string"))) if day else (lambda df: df)
        QUERIES[key] = lambda spark, sf_dir: shown(f(Tables(spark, sf_dir)))
        ORACLE[key] = f"SELECT * REPLACE (CAST(CAST({day} AS DATE) AS VARCHAR) AS {day}) FROM ({sql})" if day else sql
        return f

    return add


def dbl(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def dec(c, scale: int = 2) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal(18,{scale})")


def long(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def facts(t: Tables) -> DataFrame:
    """Orders as documents: vendor, currency (the segment), date as text, total as text (some null, some unusable)."""
    raw = F.when(F.col("o_orderkey") % 7 == 0, None).when(F.col("o_orderkey") % 11 == 0, "n/a").when(F.col("o_orderkey") % 13 == 0, "1e3").otherwise(dec("o_totalprice").cast("string"))
    code = F.when(F.col("c_mktsegment") == "MACHINERY", "  ").when(F.col("c_mktsegment") == "FURNITURE", " furniture ").otherwise(F.col("c_mktsegment"))
    day = F.when(F.col("o_orderkey") % 17 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("o_orderkey").alias("document_id"), F.col("c_name").alias("vendor"), code.alias("currency"), day.alias("document_date"), M.to_decimal(raw).alias("total"), F.col("o_orderdate").alias("created_at"))


FACTS = """WITH facts AS (
  SELECT o_orderkey AS document_id, c_name AS vendor,
         CASE c_mktsegment WHEN 'MACHINERY' THEN '  ' WHEN 'FURNITURE' THEN ' furniture ' ELSE c_mktsegment END AS currency,
         CASE WHEN o_orderkey % 17 = 0 THEN strftime(o_orderdate, '%Y%m%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS document_date,
         CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS total,
         o_orderdate AS created_at
  FROM orders JOIN customer ON o_custkey = c_custkey)
"""
KEY = "coalesce(nullif(upper(trim(currency)), ''), 'unknown currency')"
TOTALS = f"SELECT {KEY} AS currency, count(*) AS n_documents, count(*) FILTER (WHERE total IS NULL) AS missing_total, CAST(sum(total) AS DOUBLE) AS sum_total FROM facts"


def totals(rows: DataFrame) -> DataFrame:
    return R.currency_totals(rows, "currency", "total").withColumn("sum_total", dbl("sum_total"))


# filtered totals over records


@query(FACTS + TOTALS + " GROUP BY 1")
def fq_currency_totals(t):
    return totals(facts(t))


@query(FACTS + TOTALS + " WHERE contains(lower(vendor), '#00000001') GROUP BY 1")
def fq_vendor_contains(t):
    return totals(facts(t).where(R.contains_text(F.col("vendor"), "#00000001")))


@query(FACTS + TOTALS + " WHERE upper(currency) = 'BUILDING' GROUP BY 1")
def fq_currency_equals(t):
    return totals(facts(t).where(R.equals_text(F.col("currency"), "Building")))


@query(FACTS + TOTALS + " WHERE document_date LIKE '____-__-__' AND document_date BETWEEN '1995-03-01' AND '1996-02-29' GROUP BY 1")
def fq_date_bounds(t):
    return totals(facts(t).where(R.dated_within(F.col("document_date"), "1995-03-01", "1996-02-29")))


@query(FACTS + TOTALS + " WHERE coalesce(total BETWEEN 100000 AND 200000.50, false) GROUP BY 1")
def fq_total_bounds(t):
    return totals(facts(t).where(R.total_within(F.col("total"), "100000", "200000.50")))


@query("""
WITH i AS (SELECT l_orderkey, max(CASE WHEN l_linenumber % 5 = 0 THEN 1 WHEN contains(lower(p_name), 'red') THEN 2 ELSE 0 END) AS rank
           FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT CASE rank WHEN 2 THEN 'true' WHEN 1 THEN 'unknown' ELSE 'false' END AS verdict, count(*) AS n FROM i GROUP BY 1""")
def fq_item_any(t):
    # the largest rank of an order's items, in a partial aggregate: TRUE over unknown over FALSE
    name = F.when(F.col("l_linenumber") % 5 != 0, F.col("p_name"))
    items = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", R.truth_rank(F.lower(name).contains("red")).alias("rank"))
    verdict = F.get(F.array(*map(F.lit, ("false", "unknown", "true"))), F.max("rank"))
    return items.groupBy("l_orderkey").agg(verdict.alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("""
SELECT CASE WHEN v IS NULL THEN 'unknown' WHEN v THEN 'true' ELSE 'false' END AS verdict, count(*) AS n FROM (
  SELECT CASE WHEN event_id % 5 = 0 THEN false WHEN event_id % 3 = 0 THEN NULL ELSE contains(event_type, 'e') END AS v FROM events) GROUP BY 1""")
def fq_three_valued(t):
    # null is FALSE, another JSON type unknown, a string is tested
    leaf = F.when(F.col("event_id") % 5 == 0, F.lit('{"value": null}')).when(F.col("event_id") % 3 == 0, F.lit('{"value": 7}')).otherwise(F.concat(F.lit('{"value": "'), "event_type", F.lit('"}')))
    rows = t.events.select(leaf.alias("leaf")).selectExpr("try_variant_get(parse_json(leaf), '$.value', 'variant') AS v")
    kind = F.schema_of_variant("v")
    test = F.when(kind == "STRING", F.expr("contains(lower(variant_get(v, '$', 'string')), 'e')")).when(F.col("v").isNull() | (kind == "VOID"), F.lit(False))
    return rows.select(F.when(test.isNull(), "unknown").when(test, "true").otherwise("false").alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query(FACTS + "SELECT document_id, vendor, CAST(total AS DOUBLE) AS total FROM facts WHERE coalesce(total >= 150000, false) ORDER BY created_at, vendor, document_id LIMIT 20")
def fq_listing_top20(t):
    return facts(t).where(R.total_within(F.col("total"), "150000", None)).orderBy("created_at", "vendor", "document_id").limit(20).select("document_id", "vendor", dbl("total").alias("total"))


@query(FACTS + f""", g AS ({TOTALS} GROUP BY 1),
l AS (SELECT document_id, vendor, CAST(total AS DOUBLE) AS total FROM facts ORDER BY created_at, vendor, document_id LIMIT 20)
SELECT 0 AS rank, currency, n_documents, missing_total, sum_total, NULL AS document_id, NULL AS vendor FROM g
UNION ALL SELECT 1, NULL, NULL, NULL, total, document_id, vendor FROM l""")
def fq_union_tagged(t):
    rows = facts(t)
    groups = totals(rows).withColumn("rank", F.lit(0))
    listing = rows.orderBy("created_at", "vendor", "document_id").limit(20).select(F.lit(1).alias("rank"), dbl("total").alias("sum_total"), "document_id", "vendor")
    return groups.unionByName(listing, allowMissingColumns=True)


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE event_id % 4 = 0) AS missing,
CAST(sum(CASE WHEN event_id % 4 <> 0 THEN CAST(json_extract_string(props, '$.k') AS DECIMAL(18,2)) END) AS DOUBLE) AS total FROM events GROUP BY 1""")
def fq_missing_total(t):
    k = M.to_decimal(F.when(F.col("event_id") % 4 != 0, F.get_json_object("props", "$.k")))
    return t.events.select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("k").isNull()).alias("missing"), dbl(F.sum("k")).alias("total"))


# records


@query("SELECT user_id, event_type, event_id, CAST(value AS DOUBLE) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def rec_latest_per_key(t):
    return R.latest(t.events, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("""SELECT user_id, max(CASE WHEN event_type = 'click' THEN n END) AS click, max(CASE WHEN event_type = 'purchase' THEN n END) AS purchase, max(CASE WHEN event_type = 'view' THEN n END) AS view
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def rec_pivot_wide(t):
    counts = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return R.pivoted(counts, "user_id", "event_type", "n", ["click", "purchase", "view"])


@query("""SELECT d.doc_id, CASE WHEN l.quality = 0 THEN NULL WHEN l.quality = 1 THEN upper(d.lang) ELSE d.lang END AS lang, l.quality IS NOT NULL AS reviewed
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def rec_correction_overlay(t):
    action = F.when(F.col("quality").isNotNull(), "corrected")
    correction = F.when(F.col("quality") == 1, F.upper("lang"))
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", R.corrected(F.col("lang"), action, correction).alias("lang"), F.col("quality").isNotNull().alias("reviewed"))


@query("SELECT doc_id, lang FROM documents WHERE source IN ('src1', 'src3', 'src9')")
def flt_scope_isin(t):
    return t.documents.where(F.col("source").isin("src1", "src3", "src9")).select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def flt_scope_semi(t):
    return t.documents.join(t.labels.where("toxic = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT doc_id FROM labels WHERE toxic = 1 AND quality <> 1")
def flt_pending_review(t):
    return t.labels.where((F.col("toxic") == 1) & (F.col("quality") != 1)).select("doc_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12 12:00:00'")
def flt_time_window(t):
    return t.events.where(F.col("ts").between(F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-12 12:00:00").cast("timestamp_ntz"))).select("event_id")


@query("SELECT lang, count(*) AS n FROM documents WHERE source = 'src2' GROUP BY 1")
def flt_tenant(t):
    return t.documents.where(F.col("source") == "src2").groupBy("lang").agg(F.count("*").alias("n"))


# joins


@query("SELECT d.doc_id, d.source, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def jn_left_optional(t):
    return t.documents.join(t.labels, "doc_id", "left").select("doc_id", "source", "quality")


@query("SELECT n_name, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def jn_inner_chain(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("n_orders"), dbl(F.sum(dec("o_totalprice"))).alias("total"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def jn_anti_unindexed(t):
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def jn_anti_open_job(t):
    return t.documents.join(t.labels.where("quality = 1"), "doc_id", "left_anti").select("doc_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderdate <= l_shipdate WHERE o_orderkey IS NULL")
def jn_composite_integrity(t):
    return t.lineitem.join(t.orders, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("o_orderdate") <= F.col("l_shipdate")), "left_anti").select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS latest FROM customer")
def jn_corr_scalar_latest(t):
    newest = R.latest(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("latest"))
    return t.customer.select("c_custkey").join(newest, "c_custkey", "left")


@query("""WITH a AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) AS q, list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity) FILTER (WHERE l_linenumber % 6 <> 0 AND CAST(l_tax AS DECIMAL(18,6)) <= 0.07) AS p FROM lineitem GROUP BY 1)
SELECT l_orderkey, i AS pos, q[i] AS quantity, p[i] AS part FROM (SELECT *, unnest(range(1, least(len(q), coalesce(len(p), 0)) + 1)) AS i FROM a)""")
def jn_positional_zip(t):
    """The quantities of all lines of an order beside the parts of its lines whose check passes, by position; the shorter list wins."""
    passed = F.coalesce((F.col("l_linenumber") % 6 != 0) & (dec("l_tax", 6) <= F.lit("0.07").cast("decimal(18,6)")), F.lit(False))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", passed.alias("passed")))).alias("r"))
    lists = rows.select("l_orderkey", F.transform("r", lambda x: x["l_quantity"]).alias("q"), F.transform(F.filter("r", lambda x: x["passed"]), lambda x: x["l_partkey"]).alias("p"))
    zipped = lists.select("l_orderkey", F.least(F.size("q"), F.size("p")).alias("n"), F.posexplode(F.arrays_zip("q", "p")).alias("i", "z"))
    return zipped.where("i < n").select("l_orderkey", long(F.col("i") + 1).alias("pos"), F.col("z.q").alias("quantity"), F.col("z.p").alias("part"))


@query("SELECT a.doc_id AS doc_id, b.doc_id AS twin FROM documents a JOIN documents b ON a.text = b.text AND a.lang = b.lang AND a.doc_id < b.doc_id")
def jn_twin_cells(t):
    # whole texts stay where they are; digests and lengths are joined
    d = t.documents.where("text is not null and lang is not null").select("doc_id", F.struct(F.sha2("text", 256), F.length("text"), "lang").alias("same"))
    return d.join(d.withColumnRenamed("doc_id", "twin"), "same").where("doc_id < twin").select("doc_id", "twin")


# aggregations


@query("""WITH k(event_type) AS (VALUES ('click'), ('view'), ('refund')), c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
SELECT coalesce(k.event_type, c.event_type) AS event_type, coalesce(n, 0) AS n FROM k FULL JOIN c ON k.event_type = c.event_type""")
def ag_status_zero_filled(t):
    return R.zero_filled_counts(t.events, "event_type", ["click", "view", "refund"])


@query("""SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS cost,
round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1""")
def ag_rollup_p50_p95(t):
    rows = t.events.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("rows"), dbl(F.sum(dec("value", 6))).alias("cost"))
    return rows.join(interpolated(t.events, "event_type", "value", {"p50": "0.5", "p95": "0.95"}), "event_type").select("event_type", "users", F.col("rows").alias("n"), "cost", "p50", "p95")


def interpolated(df: DataFrame, key: str, value: str, shares: dict[str, str]) -> DataFrame:
    """Percentiles between the two nearest ranks, to six places."""
    spot = lambda p: (F.col("n") - 1) * F.lit(p).cast("double")
    low = {f"{name}_low": F.floor(spot(p)).cast("long") + 1 for name, p in shares.items()}
    high = {f"{name}_high": F.ceil(spot(p)).cast("long") + 1 for name, p in shares.items()}
    found = R.ranked_values(df, key, value, low | high)
    part = lambda name, p: F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (spot(p) - F.floor(spot(p)))
    return found.select(key, *(F.round(part(name, p), 6).alias(name) for name, p in shares.items()))


@query("""SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS answered, count(*) FILTER (WHERE event_type = 'error') AS failed,
count(*) FILTER (WHERE value > 50) AS costly FROM events GROUP BY 1""", day="day")
def ag_filtered_counts(t):
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("answered"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("value") > 50).alias("costly"))


@query("SELECT quality, CAST(avg(toxic) FILTER (WHERE doc_id % 3 <> 0) AS DOUBLE) AS rate, count(*) AS n FROM labels GROUP BY 1")
def ag_bool_mean(t):
    return t.labels.groupBy("quality").agg(F.avg(F.when(F.col("doc_id") % 3 != 0, F.col("toxic"))).alias("rate"), F.count("*").alias("n"))


@query("SELECT source, CAST(sum(n_chars) AS DOUBLE) / nullif(count(*) FILTER (WHERE lang = 'fr'), 0) AS chars_per_fr FROM documents GROUP BY 1")
def ag_ratio_null_safe(t):
    return t.documents.groupBy("source").agg(F.expr("try_divide(cast(sum(n_chars) as double), count_if(lang = 'fr'))").alias("chars_per_fr"))


@query("""SELECT CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS cost, round(quantile_cont(value, 0.5), 6) AS p50,
round(quantile_cont(value, 0.95), 6) AS p95, count(*) FILTER (WHERE event_type = 'purchase') AS up FROM events GROUP BY 1""", day="day")
def ag_daily_metrics(t):
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), dbl(F.sum(dec("value", 6))).alias("cost"), F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.count_if(F.col("event_type") == "purchase").alias("up"))


@query("""WITH days AS (SELECT CAST(unnest(generate_series(DATE '2023-12-30', DATE '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS day),
a AS (SELECT CAST(ts AS DATE) AS day, count(*) AS asks FROM events WHERE event_type = 'view' GROUP BY 1),
b AS (SELECT CAST(ts + INTERVAL 1 DAY AS DATE) AS day, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS grading FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT days.day, coalesce(asks, 0) AS asks, coalesce(grading, 0) AS grading FROM days LEFT JOIN a USING (day) LEFT JOIN b USING (day)""", day="day")
def ag_daily_calendar(t):
    asks = t.events.where("event_type = 'view'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("asks"))
    graded = t.events.where("event_type = 'signup'").groupBy(F.to_date(F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("day")).agg(dbl(F.sum(dec("value", 6))).alias("grading"))
    return R.on_calendar(R.calendar(asks, "2023-12-30", "2024-02-02"), asks, graded).select("day", F.coalesce("asks", F.lit(0)).alias("asks"), F.coalesce("grading", F.lit(0.0)).alias("grading"))


@query("""SELECT CAST(coalesce(sum(cost), 0) AS DOUBLE) AS spend FROM (
SELECT ts AS moment, CAST(value AS DECIMAL(18,6)) AS cost FROM events WHERE event_type = 'click' UNION ALL
SELECT ts + INTERVAL 1 DAY, CAST(value AS DECIMAL(18,6)) FROM events WHERE event_type = 'purchase' UNION ALL
SELECT o_orderdate, CAST(o_totalprice AS DECIMAL(18,6)) FROM orders) WHERE moment >= TIMESTAMP '2024-01-15'""")
def ag_spend_since(t):
    cost = dec("value", 6).alias("cost")
    parts = [t.events.where("event_type = 'click'").select(F.col("ts").alias("at"), cost), t.events.where("event_type = 'purchase'").select((F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("at"), cost), t.orders.select(F.col("o_orderdate").alias("at"), dec("o_totalprice", 6).alias("cost"))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).where(F.col("at") >= F.lit("2024-01-15").cast("timestamp_ntz")).agg(dbl(F.coalesce(F.sum("cost"), F.lit(0))).alias("spend"))


@query("SELECT conv_id, arg_min(text, turn) AS first_question, count(*) AS turns, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY 1")
def ag_conversation_rollup(t):
    return t.conversations.groupBy("conv_id").agg(F.min_by("text", "turn").alias("first_question"), F.count("*").alias("turns"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


TERMS = ["the", "une", "und", "que", "license", "zzz"]
TOKENS = r"""WITH tok AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents),
q(w) AS (VALUES ('the'), ('une'), ('und'), ('que'), ('license'), ('zzz')), n AS (SELECT count(*) AS n FROM documents),
df AS (SELECT q.w, count(tok.doc_id) AS df FROM q LEFT JOIN tok ON tok.w = q.w GROUP BY 1),
idf AS (SELECT w, df, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM df, n)
"""


def wanted_words(t: Tables) -> DataFrame:
    """Distinct query words of each document; only these leave the scan."""
    return t.documents.select("doc_id", F.array_intersect(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), F.array(*map(F.lit, TERMS))).alias("ws"))


def idf(t: Tables) -> DataFrame:
    """w, df, idf of the query words: documents and those that hold each word are counted in one pass."""
    counts = [F.struct(F.lit(w).alias("w"), F.count_if(F.array_contains("ws", w)).alias("df")) for w in TERMS]
    told = wanted_words(t).agg(F.count("*").alias("n"), F.array(*counts).alias("words"))
    return told.select("n", F.explode("words").alias("x")).select("x.w", "x.df", F.expr("ln((n - x.df + 0.5D) / (x.df + 0.5D) + 1)").alias("idf"))


@query(TOKENS + "SELECT w, df FROM df")
def ag_doc_freq(t):
    return idf(t).select("w", "df")


@query(TOKENS + "SELECT w, round(idf, 6) AS idf FROM idf")
def lex_idf(t):
    return idf(t).select("w", F.round("idf", 6).alias("idf"))


@query(TOKENS + "SELECT doc_id, round(sum(idf ORDER BY w), 6) AS score FROM tok JOIN idf USING (w) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def lex_score_topk(t):
    # summed in the words' order, so that scores don't depend on partitioning
    rows = wanted_words(t).select("doc_id", F.explode("ws").alias("w")).join(F.broadcast(idf(t)), "w").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("w", "idf"))).alias("x"))
    score = F.round(F.aggregate("x", F.lit(0.0), lambda a, x: a + x["idf"]), 6)
    return rows.select("doc_id", score.alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


@query("SELECT event_type AS kind, CASE WHEN user_id % 3 = 0 THEN 'pending' ELSE 'done' END AS state, count(*) AS n, sum(CASE WHEN event_type = 'click' THEN 2 ELSE 1 END)::BIGINT AS expected FROM events GROUP BY 1, 2")
def ag_queue_counts(t):
    state = F.when(F.col("user_id") % 3 == 0, "pending").otherwise("done")
    return t.events.groupBy(F.col("event_type").alias("kind"), state.alias("state")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("event_type") == "click", 2).otherwise(1)).alias("expected"))


@query("SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation")
def ag_tenant_sizes(t):
    c = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return t.nation.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("""SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS items, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS returned FROM orders""")
def ag_doc_facts(t):
    counts = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("items"), F.count_if(F.col("l_returnflag") == "R").alias("returned"))
    return t.orders.select("o_orderkey").join(counts, "o_orderkey", "left").na.fill(0)


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def ag_nearest_rank(t):
    return R.ranked_values(t.events, "event_type", "value", {n: R.rank_of(p) for n, p in (("p50", "0.5"), ("p95", "0.95"), ("p99", "0.99"))}).drop("n")


@query("SELECT event_type, count(*) AS n, min(value) AS low, round(avg(CAST(value AS DECIMAL(18,6))), 4) AS mean, max(value) AS high, quantile_disc(value, 0.1) AS q10, quantile_disc(value, 0.25) AS q25, quantile_disc(value, 0.75) AS q75, quantile_disc(value, 0.9) AS q90 FROM events GROUP BY 1")
def ag_quantile_set(t):
    mean = F.round(dbl(F.sum(dec("value", 6))) / F.count("*"), 4)
    rows = t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("low"), mean.alias("mean"), F.max("value").alias("high"))
    ranks = R.ranked_values(t.events, "event_type", "value", {f"q{p[2:]:0<2}": R.rank_of(p) for p in ("0.1", "0.25", "0.75", "0.9")})
    return rows.join(ranks.drop("n"), "event_type")


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE user_id % 10 = 0) AS errors, CAST(count(*) FILTER (WHERE user_id % 10 = 0) AS DOUBLE) / count(*) AS error_rate,
quantile_disc(value, 0.95) FILTER (WHERE user_id % 10 <> 0) AS p95 FROM events GROUP BY 1""")
def ag_endpoint_stats(t):
    bad = F.col("user_id") % 10 == 0
    rows = t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(bad).alias("errors"), F.expr("cast(count_if(user_id % 10 = 0) as double) / count(*)").alias("error_rate"))
    return rows.join(R.ranked_values(t.events.where(~bad), "event_type", "value", {"p95": R.rank_of("0.95")}).drop("n"), "event_type", "left")


@query("""WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, CAST(median(n) FILTER (WHERE n >= 5) AS DOUBLE) AS mid, min(n) FILTER (WHERE n >= 5) AS low, max(n) FILTER (WHERE n >= 5) AS high, count(*) FILTER (WHERE n < 5) AS invalid FROM d GROUP BY 1""")
def ag_spread(t):
    d = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).withColumn("v", F.when(F.col("n") >= 5, F.col("n")))
    return d.groupBy("event_type").agg(F.median("v").alias("mid"), F.min("v").alias("low"), F.max("v").alias("high"), F.count_if(F.col("v").isNull()).alias("invalid"))


@query("SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total FROM events GROUP BY 1 ORDER BY sum(CAST(value AS DECIMAL(18,6))) DESC, 1 LIMIT 15")
def ag_top15(t):
    return t.events.groupBy("user_id").agg(F.sum(dec("value", 6)).alias("s")).orderBy(F.desc("s"), "user_id").limit(15).select("user_id", dbl("s").alias("total"))


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, grouping(event_type) + grouping(CAST(ts AS DATE)) AS level FROM events GROUP BY GROUPING SETS ((event_type, CAST(ts AS DATE)), (event_type), ())", day="day")
def ag_grouping_sets(t):
    rows = t.events.select("event_type", F.to_date("ts").alias("day"))
    return rows.rollup("event_type", "day").agg(F.count("*").alias("n"), (F.grouping("event_type").cast("int") + F.grouping("day").cast("int")).alias("level"))


@query("SELECT coalesce(l_returnflag, 'all') AS kind, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.05) AS detected FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def ag_rollup_total(t):
    return t.lineitem.rollup("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("detected")).select(F.coalesce("l_returnflag", F.lit("all")).alias("kind"), "n", "detected")


@query("""WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fn, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn FROM labels),
d AS (SELECT *, tp + fp + fn + tn AS n FROM c), e AS (SELECT *, CAST(tp + tn AS DOUBLE) / n AS observed, CAST((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn) AS DOUBLE) / (CAST(n AS DOUBLE) * n) AS expected FROM d)
SELECT tp, fp, fn, tn, n, round(observed, 9) AS observed, round(expected, 9) AS expected, round((observed - expected) / (1 - expected), 9) AS kappa FROM e""")
def ag_kappa(t):
    return R.kappa(t.labels, "quality", "toxic").select("tp", "fp", "fn", "tn", "n", *(F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa")))


@query("SELECT lang, count(*) AS n, CAST(avg(quality) AS DOUBLE) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def ag_micro_accuracy(t):
    return t.labels.join(t.documents, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.avg("quality").alias("accuracy"))


@query("""SELECT round(avg(n_chars) FILTER (WHERE quality = 1), 6) AS mean_correct, round(avg(n_chars) FILTER (WHERE quality = 0), 6) AS mean_incorrect,
CAST(count(*) FILTER (WHERE quality = 0 AND n_chars < 1000) AS DOUBLE) / nullif(count(*) FILTER (WHERE quality = 0), 0) AS caught FROM labels JOIN documents USING (doc_id)""")
def ag_confidence_split(t):
    rows = t.labels.join(t.documents, "doc_id")
    mean = lambda v: F.round(F.avg(F.when(F.col("quality") == v, F.col("n_chars"))), 6)
    return rows.agg(mean(1).alias("mean_correct"), mean(0).alias("mean_incorrect"), F.expr("try_divide(cast(count_if(quality = 0 and n_chars < 1000) as double), count_if(quality = 0))").alias("caught"))


@query("SELECT event_type, CAST(sum(CASE WHEN user_id % 4 = 0 THEN CAST(value AS DECIMAL(18,6)) END) AS DOUBLE) AS errored, CAST(sum(CASE WHEN user_id % 4 <> 0 THEN CAST(value AS DECIMAL(18,6)) END) AS DOUBLE) AS scored FROM events GROUP BY 1")
def ag_cost_split(t):
    part = lambda test: dbl(F.sum(F.when(test, dec("value", 6))))
    return t.events.groupBy("event_type").agg(part(F.col("user_id") % 4 == 0).alias("errored"), part(F.col("user_id") % 4 != 0).alias("scored"))


# windows, sorts, sets


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'purchase') AS a, count(*) FILTER (WHERE event_type = 'view') AS b FROM events GROUP BY 1)
SELECT day, CAST(sum(a) OVER w AS DOUBLE) / nullif(sum(b) OVER w, 0) AS ratio FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""", day="day")
def win_trailing7(t):
    d = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "purchase").alias("a"), F.count_if(F.col("event_type") == "view").alias("b"))
    w = Window.orderBy("day").rowsBetween(-6, 0)  # one row a day
    return d.select("day", F.try_divide(dbl(F.sum("a").over(w)), F.sum("b").over(w)).alias("ratio"))


@query("SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_event FROM events")
def win_lead_step(t):
    return t.events.select("user_id", "event_id", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next_event"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def win_rank_total_order(t):
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rank"))


@query("""WITH r AS (SELECT event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(ts) FILTER (WHERE i = CAST(ceil(n * 0.1) AS BIGINT)) AS t10, max(ts) FILTER (WHERE i = CAST(ceil(n * 0.9) AS BIGINT)) AS t90 FROM r GROUP BY 1""")
def win_steady_window(t):
    at = t.events.select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    found = R.ranked_values(at, "event_type", "at", {"a": R.rank_of("0.1"), "b": R.rank_of("0.9")})
    return found.select("event_type", *(F.timestamp_micros(c).cast("timestamp_ntz").alias(n) for c, n in (("a", "t10"), ("b", "t90"))))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def srt_offset_page(t):
    return R.paged(t.orders.select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.col("o_orderkey")], 50, 100)


@query("SELECT c_mktsegment AS name FROM customer UNION SELECT event_type FROM events UNION SELECT lang FROM documents")
def set_union_distinct(t):
    return t.customer.select(F.col("c_mktsegment").alias("name")).union(t.events.select("event_type")).union(t.documents.select("lang")).distinct()


def ordered_dedup(docs: DataFrame) -> DataFrame:
    """The distinct words of whole texts, in the order in which they first come."""
    return docs.select("doc_id", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words"))


@query("""WITH w AS (SELECT doc_id, i, ws[i] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents WHERE text IS NOT NULL))),
f AS (SELECT doc_id, w, min(i) AS i FROM w GROUP BY 1, 2) SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS words FROM f GROUP BY 1""")
def set_ordered_dedup(t):
    return ordered_dedup(t.documents.where("text is not null"))


@query("""WITH a AS (SELECT o_custkey, array_agg(DISTINCT o_orderpriority) AS p FROM orders GROUP BY 1)
SELECT o_custkey, CAST(len(list_intersect(p, ['1-URGENT', '2-HIGH'])) AS INTEGER) AS n FROM a""")
def set_intersection_size(t):
    return t.orders.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p")).select("o_custkey", F.size(F.array_intersect("p", F.array(F.lit("1-URGENT"), F.lit("2-HIGH")))).alias("n"))


# document arithmetic on line items


def lines(t: Tables) -> DataFrame:
    q, net = dec("l_quantity", 6), dec("l_extendedprice", 6)
    unit = F.round(net / q, 2).cast("decimal(18,6)")
    return t.lineitem.select("l_orderkey", "l_linenumber", q.alias("qty"), net.alias("total"), unit.alias("unit"), dec("l_discount", 6).alias("disc"), dec("l_tax", 6).alias("tax"))


LINES = """WITH li AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DECIMAL(18,6)) AS qty, CAST(l_extendedprice AS DECIMAL(18,6)) AS total, CAST(l_discount AS DECIMAL(18,6)) AS disc, CAST(l_tax AS DECIMAL(18,6)) AS tax FROM lineitem)
"""


@query(LINES + "SELECT l_orderkey, l_linenumber, CASE WHEN abs(qty * CAST(2.5 AS DECIMAL(18,6)) - total) <= 0.01 THEN 'pass' ELSE 'fail' END AS status FROM li")
def rcl_line_math(t):
    # quantity x unit price against the line total, one minor unit of tolerance
    product = F.col("qty") * F.lit("2.5").cast("decimal(18,6)")
    return lines(t).select("l_orderkey", "l_linenumber", F.when(F.abs(product - F.col("total")) <= F.lit("0.01").cast("decimal(18,6)"), "pass").otherwise("fail").alias("status"))


@query(LINES + """SELECT o_orderkey, CASE WHEN s IS NULL THEN 'skipped' WHEN abs(s - CAST(o_totalprice AS DECIMAL(18,6))) <= 1000 THEN 'pass' ELSE 'fail' END AS status, CAST(s AS DOUBLE) AS lines_sum
FROM orders LEFT JOIN (SELECT l_orderkey, sum(total) AS s FROM li GROUP BY 1) ON l_orderkey = o_orderkey""")
def rcl_lines_sum(t):
    s = lines(t).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("total").alias("s"))
    return t.orders.join(s, "o_orderkey", "left").select("o_orderkey", F.when(F.col("s").isNull(), "skipped").when(F.abs(F.col("s") - dec("o_totalprice", 6)) <= 1000, "pass").otherwise("fail").alias("status"), dbl("s").alias("lines_sum"))


@query(LINES + "SELECT l_orderkey, CAST(sum(total) - sum(CAST(total * disc AS DECIMAL(18,4))) + sum(CAST(total * tax AS DECIMAL(18,4))) AS DOUBLE) AS expected FROM li GROUP BY 1")
def rcl_total_math(t):
    # subtotal - discount + tax
    part = lambda c: F.sum((F.col("total") * F.col(c)).cast("decimal(18,4)"))
    return lines(t).groupBy("l_orderkey").agg(dbl(F.sum("total") - part("disc") + part("tax")).alias("expected"))


@query(LINES + "SELECT l_orderkey, l_linenumber, coalesce(tax BETWEEN 0 AND 0.30, false) AS ok, total < 0 AS negative FROM li")
def rcl_tax_rate(t):
    return lines(t).select("l_orderkey", "l_linenumber", F.coalesce(F.col("tax").between(F.lit("0").cast("decimal(18,6)"), F.lit("0.30").cast("decimal(18,6)")), F.lit(False)).alias("ok"), (F.col("total") < 0).alias("negative"))


@query("SELECT c_custkey, c_acctbal < 0 AS negative, CAST(CAST(c_acctbal AS DECIMAL(18,2)) - 100 AS DOUBLE) AS due FROM customer")
def rcl_balance(t):
    return t.customer.select("c_custkey", (F.col("c_acctbal") < 0).alias("negative"), dbl(dec("c_acctbal") - 100).alias("due"))


STATUS = LINES + """, ch AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 6 = 0 THEN 'skipped' WHEN tax > 0.07 THEN 'fail' ELSE 'pass' END AS status FROM li)
"""


def checks(t: Tables) -> DataFrame:
    status = F.when(F.col("l_linenumber") % 6 == 0, "skipped").when(F.col("tax") > F.lit("0.07").cast("decimal(18,6)"), "fail").otherwise("pass")
    return lines(t).select("l_orderkey", "l_linenumber", status.alias("status"))


@query(STATUS + "SELECT l_orderkey, CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'pass') THEN 'pass' ELSE 'skipped' END AS status FROM ch GROUP BY 1")
def rcl_status_fold(t):
    folded = F.when(F.bool_or(F.col("status") == "fail"), "fail").when(F.bool_or(F.col("status") == "pass"), "pass").otherwise("skipped")
    return checks(t).groupBy("l_orderkey").agg(folded.alias("status"))


@query(STATUS + "SELECT l_orderkey, 'line_math[' || min(l_linenumber) || ']' AS reason FROM ch WHERE status = 'fail' GROUP BY 1")
def rcl_routing_first_reason(t):
    first = F.min(F.when(F.col("status") == "fail", F.col("l_linenumber")))
    return checks(t).groupBy("l_orderkey").agg(first.alias("i")).where("i is not null").select("l_orderkey", F.concat(F.lit("line_math["), F.col("i").cast("string"), F.lit("]")).alias("reason"))


@query(STATUS + "SELECT o_orderkey, count(*) AS failing FROM ch JOIN orders ON o_orderkey = l_orderkey WHERE status = 'fail' GROUP BY o_orderkey, o_orderdate ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 10")
def rcl_review_queue(t):
    rows = checks(t).where("status = 'fail'").join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey", "o_orderdate").agg(F.count("*").alias("failing"))
    return R.paged(rows, [F.col("o_orderdate"), F.col("o_orderkey")], 50, 10).select("o_orderkey", "failing")


def failing_checks(t: Tables) -> DataFrame:
    """The failing checks of line_items of each order."""
    path = F.concat(F.lit("line_items["), F.col("l_linenumber").cast("string"), F.lit("].total"))
    rows = checks(t).withColumn("path", path).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "status", "path"))).alias("checks"))
    bad = F.filter("checks", lambda c: (c["status"] == "fail") & (M.field_of(c["path"]) == "line_items"))
    return rows.where(F.size(bad) > 0).select("l_orderkey", F.array_join(F.transform(bad, lambda c: c["l_linenumber"].cast("string")), ",").alias("failing"))


@query(STATUS + "SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS failing FROM ch WHERE status = 'fail' GROUP BY 1")
def rcl_failing_checks(t):
    return failing_checks(t)


# text


def line_windows(docs: DataFrame) -> DataFrame:
    """Windows of 200 characters, one each 120, over whole texts of any length, in one pass over each text."""
    spans = docs.select("doc_id", F.length("text").cast("bigint").alias("n"), F.posexplode(F.regexp_extract_all("text", F.lit("(?s)(?=(.{1,200})).{1,120}"), F.lit(1))).alias("i", "chunk"))
    start = long("i") * 120
    return spans.select("doc_id", start.alias("char_start"), F.least(start + 200, F.col("n")).alias("char_end"), "chunk")


@query("SELECT doc_id, s AS char_start, least(s + 200, n) AS char_end, substring(text, s + 1, least(s + 200, n) - s) AS chunk FROM (SELECT doc_id, text, length(text) AS n, unnest(range(0, length(text), 120)) AS s FROM documents WHERE text <> '')")
def txt_long_line_windows(t):
    return line_windows(t.documents)


@query("SELECT doc_id, trim(regexp_extract(text, '[^\\n]*[^\\n ][^\\n]*')) || ' (page 1 of 1)' AS header FROM documents")
def txt_title_header(t):
    return t.documents.select("doc_id", F.concat(F.trim(F.regexp_extract("text", r"[^\n]*[^\n ][^\n]*", 0)), F.lit(" (page 1 of 1)")).alias("header"))


@query("SELECT doc_id, length(text) AS n, n_chars = length(text) AS intact FROM documents")
def txt_chunk_invariant(t):
    return t.documents.select("doc_id", F.length("text").cast("bigint").alias("n"), (F.col("n_chars") == F.length("text")).alias("intact"))


@query("SELECT doc_id, regexp_matches(text, '\\p{Nd}{5}') OR regexp_matches(text, '(\\p{Nd}[ \\t\\x{00a0}\\x{2009}\\x{202f}.-]*){12}\\p{Nd}') AS long_run FROM documents")
def pii_long_run(t):
    return t.documents.select("doc_id", masking.has_long_run(F.col("text")).alias("long_run"))


@query("SELECT event_id, CAST(ts AS DATE) AS day FROM events", day="day")
def sc_utc_day(t):
    return t.events.select("event_id", F.to_date("ts").alias("day"))


@query("SELECT event_id, round((CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) + 14.5) * 3 + 75, 4) AS cost FROM events")
def sc_cost(t):
    # price of a call in millionths
    c = M.model_cost(F.col("value"), F.lit(10), F.lit(20), F.lit(5), 300_000.0, 1_500_000.0)
    return t.events.select("event_id", F.round(dbl(c) * 10, 4).alias("cost"))


@query("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount FROM orders")
def sc_pad_money(t):
    return t.orders.select("o_orderkey", M.plain_string(dec("o_totalprice", 2), 2).alias("amount"))


@query("""SELECT event_id, regexp_full_match(s, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)') AS plain FROM (
SELECT event_id, CASE event_id % 5 WHEN 0 THEN '1e3' WHEN 1 THEN '$5' WHEN 2 THEN '5.00' WHEN 3 THEN '' ELSE '-.5' END AS s FROM events)""")
def sc_plain_decimal(t):
    k = F.col("event_id") % 5
    s = F.when(k == 0, "1e3").when(k == 1, "$5").when(k == 2, " 5.00 ").when(k == 3, "").otherwise("-.5")
    return t.events.select("event_id", M.to_decimal(s).isNotNull().alias("plain"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 2 END AS units FROM events")
def sc_minor_units(t):
    k = F.col("event_id") % 4
    return t.events.select("event_id", M.minor_units(F.when(k == 0, " jpy ").when(k == 1, "BHD").when(k == 2, "XXX?")).alias("units"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def sc_sha256(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def sc_escape(t):
    return t.pages.select("page_id", M.escape_markup(F.col("html")).alias("escaped"))


@query(r"SELECT doc_id, contains(' ' || trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) || ' ', ' of the ') AS quoted FROM documents")
def sc_quote_words(t):
    return t.documents.select("doc_id", M.words_contain(F.col("text"), F.lit("of  the")).alias("quoted"))


@query("SELECT source, regexp_extract(source, '^[^.\\[0-9]+') AS field, ceil(length(source) / 4.0)::BIGINT AS tokens FROM (SELECT DISTINCT source FROM documents)")
def sc_field_of_path(t):
    rows = t.documents.select("source").distinct()
    return rows.select("source", F.regexp_extract(M.field_of(F.col("source")), "^[^0-9]+", 0).alias("field"), F.ceil(F.length("source") / 4).alias("tokens"))


# vectors, fusion, ranking metrics

COS = """WITH q AS (SELECT vec_id AS query_id, embedding AS qe, label AS ql FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS id, label, ql, round(list_dot_product(qe::DOUBLE[], embedding::DOUBLE[]) / (sqrt(list_dot_product(qe::DOUBLE[], qe::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 9) AS sim
      FROM q, embeddings WHERE vec_id <> query_id),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s WHERE sim > 0)
"""


def nearest(t: Tables, k: int, every: int = 20) -> DataFrame:
    """The k nearest by cosine of a stated query set (ids divisible by `every`), in a total order."""
    e = t.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label", F.lit("own").alias("model"))
    asked = e.where(F.col("id") % every == 0)
    found = S.cosine_topk(e, asked, k)
    named = e.select("id", "label")
    return found.join(named, "id").join(named.select(F.col("id").alias("query_id"), F.col("label").alias("ql")), "query_id")


@query(COS + "SELECT query_id, id, rank, sim FROM d WHERE rank <= 10")
def vec_cosine_topk(t):
    return nearest(t, 10).select("query_id", "id", "rank", "sim")


FUSE = COS + """, x AS (SELECT query_id, id, rank, 0 AS l FROM d WHERE rank <= 20),
y AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY abs(id - query_id), id) AS rank, 1 AS l FROM (SELECT query_id, vec_id AS id FROM q, embeddings WHERE vec_id <> query_id AND abs(vec_id - query_id) <= 15)),
u AS (SELECT * FROM x UNION ALL SELECT * FROM y),
f AS (SELECT query_id, id, sum(1.0 / (60 + rank)) AS score, min(l * 1000 + rank) AS first FROM u GROUP BY 1, 2)
"""


def fused(t: Tables, every: int = 20) -> DataFrame:
    q = t.embeddings.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"))
    near = q.select("query_id", F.explode(F.sequence(F.col("query_id") - 15, F.col("query_id") + 15)).alias("id")).where("id <> query_id").join(t.embeddings.select(F.col("vec_id").alias("id")), "id")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.abs(F.col("id") - F.col("query_id")), "id")))
    return R.reciprocal_rank_fusion([nearest(t, 20, every), near], ["query_id"])


@query(FUSE + "SELECT query_id, id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first) AS position FROM f")
def hyb_rrf(t):
    return fused(t).select("query_id", "id", F.round("score", 9).alias("score"), "position")


@query(FUSE + ", p AS (SELECT query_id, id % 100 AS doc, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first) AS position FROM f) SELECT query_id, doc, min(position) AS position FROM p GROUP BY 1, 2")
def hyb_collapse_docs(t):
    return fused(t).groupBy("query_id", (F.col("id") % 100).alias("doc")).agg(F.min("position").alias("position"))


METRIC = COS + """, r AS (SELECT query_id, ql, count(*) AS n FROM q JOIN embeddings ON label = ql AND vec_id <> query_id GROUP BY 1, 2),
m AS (SELECT r.query_id, r.n, coalesce(sum(CASE WHEN d.label = d.ql THEN 1 ELSE 0 END), 0) AS hits, min(CASE WHEN d.label = d.ql THEN rank END) AS first,
             coalesce(sum(CASE WHEN d.label = d.ql THEN 1 / log2(rank + 1) END), 0) AS dcg FROM r LEFT JOIN d ON d.query_id = r.query_id AND d.rank <= 10 GROUP BY 1, 2),
e AS (SELECT query_id, CAST(hits AS DOUBLE) / n AS recall, coalesce(1.0 / first, 0) AS rr, dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) z(i) WHERE i <= n) AS ndcg FROM m)
"""


def metrics(t: Tables, every: int = 20) -> DataFrame:
    e = t.embeddings
    q = e.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql"))
    sizes = e.groupBy(F.col("label").alias("ql")).agg((F.count("*") - 1).alias("n"))
    relevant = q.join(sizes, "ql").where("n > 0").select("query_id", "n")
    hit = F.col("label") == F.col("ql")
    found = nearest(t, 10, every).groupBy("query_id").agg(F.count_if(hit).alias("hits"), F.min(F.when(hit, F.col("rank"))).alias("first"), F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1))).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(10)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    rows = relevant.join(found, "query_id", "left")
    return rows.select("query_id", (F.coalesce("hits", F.lit(0)).cast("double") / F.col("n")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


@query(METRIC + "SELECT query_id, round(recall, 9) AS recall, round(rr, 9) AS rr, round(ndcg, 9) AS ndcg FROM e")
def ev_recall_mrr_ndcg(t):
    return metrics(t).select("query_id", *(F.round(c, 9).alias(c) for c in ("recall", "rr", "ndcg")))


@query(METRIC + "SELECT query_id, round(rr, 9) AS rr FROM e ORDER BY round(rr, 9), query_id LIMIT 10")
def ev_hardest10(t):
    return metrics(t).select("query_id", F.round("rr", 9).alias("rr")).orderBy("rr", "query_id").limit(10)


@query("""WITH b AS (SELECT source, CAST(avg(n_chars) AS DOUBLE) AS m FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), f AS (SELECT source, CAST(avg(n_chars) AS DOUBLE) AS m FROM documents WHERE doc_id % 2 = 1 GROUP BY 1)
SELECT coalesce(b.source, f.source) AS source, CASE WHEN b.m IS NULL OR f.m IS NULL THEN 'incomparable' WHEN f.m < b.m * 0.95 THEN 'regression' ELSE 'ok' END AS verdict FROM b FULL JOIN f ON b.source IS NOT DISTINCT FROM f.source""")
def ev_regression_compare(t):
    run = lambda k, name: t.documents.where(F.col("doc_id") % 2 == k).groupBy(F.col("source").alias(f"s{k}")).agg(F.avg("n_chars").alias(name))
    both = run(0, "b").join(run(1, "f"), F.col("s0").eqNullSafe(F.col("s1")), "full_outer")
    return both.select(F.coalesce("s0", "s1").alias("source"), F.when(F.col("b").isNull() | F.col("f").isNull(), "incomparable").when(F.col("f") < F.col("b") * 0.95, "regression").otherwise("ok").alias("verdict"))


@query("SELECT conv_id, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) <= 2")
def ev_history(t):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    return t.conversations.withColumn("n", F.row_number().over(w)).where("n <= 2").select("conv_id", "turn", "text")


@query("SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS used FROM conversations QUALIFY used <= 2000")
def ev_fit_prefix(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t.conversations.select("conv_id", "turn", F.sum(F.length("text")).over(w).alias("used")).where("used <= 2000")


# page merge


@query("""SELECT user_id, arg_max(event_type, struct_pack(v := value, e := -event_id)) FILTER (WHERE event_type <> 'error') AS value, max(value) FILTER (WHERE event_type <> 'error') AS confidence,
count(DISTINCT event_type) FILTER (WHERE event_type <> 'error') > 1 AS disagree FROM events GROUP BY 1""")
def mrg_scalar(t):
    good = F.col("event_type") != "error"
    rows = t.events.withColumn("kind", F.when(good, F.col("event_type")))
    best = F.max_by("kind", F.when(good, F.struct("value", (-F.col("event_id")).alias("e"))))
    return rows.groupBy("user_id").agg(best.alias("value"), F.max(F.when(good, F.col("value"))).alias("confidence"), (F.countDistinct("kind") > 1).alias("disagree"))


@query("""SELECT user_id, CASE WHEN count(DISTINCT event_type) > 1 THEN least(max(value) / 100, 0.5) ELSE max(value) / 100 END AS confidence FROM events GROUP BY 1""")
def mrg_disagreement_cap(t):
    top = F.max("value") / 100
    return t.events.groupBy("user_id").agg(F.when(F.countDistinct("event_type") > 1, F.least(top, F.lit(0.5))).otherwise(top).alias("confidence"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn, role) AS roles, min(length(text)) AS least FROM conversations GROUP BY 1")
def mrg_array_concat(t):
    rows = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"), F.min(F.length("text")).cast("bigint").alias("least"))
    return rows.select("conv_id", F.array_join(F.transform("x", lambda r: r["role"]), ",").alias("roles"), "least")


# batch views of the queue and the budget


@query("SELECT user_id, event_id FROM events WHERE event_type = 'view' AND ts <= TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def str_next_claimable(t):
    ready = t.events.where((F.col("event_type") == "view") & (F.col("ts") <= F.lit("2024-01-20").cast("timestamp_ntz")))
    return R.latest(ready, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


@query("SELECT event_id, CASE WHEN user_id % 4 >= 3 THEN 'failed' ELSE 'pending' END AS next_state FROM events WHERE event_type = 'click' AND ts < TIMESTAMP '2024-01-30' - INTERVAL 5 DAY")
def str_lease_expired(t):
    late = t.events.where((F.col("event_type") == "click") & (F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-30' - INTERVAL 5 DAY")))
    return late.select("event_id", F.when(F.col("user_id") % 4 >= 3, "failed").otherwise("pending").alias("next_state"))


@query("""SELECT event_id, coalesce(sum(CAST(value AS DECIMAL(18,6))) OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 100 AS refused FROM events""")
def str_budget_running(t):
    w = Window.partitionBy(F.to_date("ts"), "user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return t.events.select("event_id", (F.coalesce(F.sum(dec("value", 6)).over(w), F.lit(0)) >= 100).alias("refused"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS tick, event_type, count(*) AS depth FROM events GROUP BY 1, 2")
def str_queue_depth(t):
    return t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("depth")).select(F.col("w.start").alias("tick"), "event_type", "depth")
