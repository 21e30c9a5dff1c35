"""Queries of evaluation and of answers' scalars over the driver's tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import answers as A
from folio.operators import evaluation as E
from folio.plans.document_model import Query

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' totals as sentences, written in different ways."""
    o = _read(spark, sf_dir, "orders")
    cents = F.col("o_totalprice").cast("decimal(18,2)")
    k = F.col("o_orderkey") % 4
    shown = F.when(k == 0, cents.cast("string")).when(k == 1, F.translate(cents.cast("string"), ".", ",")).when(k == 2, F.format_number(cents, 2)).otherwise(F.lit("not known"))
    return o.select("o_orderkey", cents.alias("total"), F.to_date("o_orderdate").alias("day"), F.concat(F.lit("The total is "), shown, F.lit(" [1] for order "), (F.col("o_orderkey") % 7).cast("string"), F.lit(".")).alias("answer"))


@query("SELECT o_orderkey, o_orderkey % 4 <> 3 AS stated, CASE WHEN o_orderkey % 4 = 3 THEN 1 ELSE 2 END AS numbers FROM orders")
def sc_numbers_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _answers(spark, sf_dir).withColumn("plain", A.unmarked(F.col("answer")))
    return rows.select("o_orderkey", A.states_number(F.col("plain"), F.col("total")).alias("stated"), F.size(A.numbers_in(F.col("plain"))).alias("numbers"))


@query("SELECT o_orderkey, o_orderkey % 4 <> 3 AS amount FROM orders")
def sc_states_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("o_orderkey", A.states_amount(F.col("answer")).alias("amount"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%B ') || day(o_orderdate) || ', ' || year(o_orderdate) AS long_form, month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate) AS short_form FROM orders")
def sc_date_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = A.date_forms(F.to_date("o_orderdate"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", F.get(forms, 1).alias("long_form"), F.get(forms, 5).alias("short_form"))


@query("SELECT event_id, CAST(greatest(86400 - (epoch_ms(date_trunc('second', ts)) // 1000) % 86400, 1) AS BIGINT) AS seconds FROM events")
def sc_seconds_to_midnight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", A.seconds_to_midnight(F.col("ts").cast("timestamp")).alias("seconds"))


@query("SELECT event_id, epoch_ms(date_trunc('second', ts)) // 1000 AS extended, epoch_ms(date_trunc('second', ts)) // 1000 AS basic, CAST(NULL AS BIGINT) AS none FROM events")
def sc_iso_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    read = lambda c: F.unix_seconds(A.iso_instant(c))
    return _read(spark, sf_dir, "events").select("event_id", read(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("extended"), read(F.date_format(ts, "yyyyMMdd'T'HHmmss")).alias("basic"), read(F.lit("yesterday")).alias("none"))


@query("SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'document') AS slug FROM part")
def sc_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", A.slug(F.concat("p_name", F.lit(".pdf"))).alias("slug"))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'a' || c_custkey || '@x.org' END AS address, CASE c_custkey % 3 WHEN 0 THEN c_name END AS name FROM customer")
def sc_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = lambda *p: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in p))
    mail = F.when(k % 5 == 0, text("  a", k.cast("string"), "@x.org\t")).when(k % 5 == 1, "a@b@c").when(k % 5 == 2, "no address").when(k % 5 == 3, "a b@c").otherwise("")
    name = F.when(k % 3 == 0, text(" ", F.col("c_name"), " ")).when(k % 3 == 1, "").otherwise("a\x00b")
    return _read(spark, sf_dir, "customer").select("c_custkey", A.address(mail).alias("address"), A.clean_name(name).alias("name"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'too many decimal places' WHEN o_orderkey % 3 = 1 THEN 'not a plain number' END AS problem, CASE WHEN o_orderkey % 3 = 2 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS value FROM orders")
def sc_input_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, cents = F.col("o_orderkey") % 3, F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    typed = A.input_amount(F.when(k == 0, F.concat(cents, F.lit("5"))).when(k == 1, F.concat(F.lit("$"), cents)).otherwise(F.concat(F.lit(" "), cents)))
    return _read(spark, sf_dir, "orders").select("o_orderkey", typed.alias("x")).select("o_orderkey", "x.problem", F.col("x.value").cast("double").alias("value"))


@query("""WITH e AS (SELECT event_type AS field_name, CASE WHEN event_id % 9 <> 0 THEN 'v' END AS value, CASE WHEN event_id % 4 <> 0 THEN 'word ' || (event_id % 3) END AS quote, event_id % 2 AS page, CASE WHEN event_id % 5 <> 0 THEN 'a word ' || (event_id % 6) || ' more' END AS gold FROM events)
SELECT field_name, count(*) AS leaves, count(quote) AS with_quote, count(gold) AS judged, count(*) FILTER (WHERE gold IS NOT NULL AND quote IS NOT NULL AND page = 0) AS page_agree,
  count(*) FILTER (WHERE contains(' ' || gold || ' ', ' ' || quote || ' ')) AS quote_agree, round(CAST(count(quote) AS DOUBLE) / count(*), 9) AS coverage FROM e WHERE value IS NOT NULL GROUP BY ROLLUP (field_name)""")
def ag_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    word = lambda n: (i % n).cast("string")
    leaves = _read(spark, sf_dir, "events").select(F.col("event_type").alias("field_name"), F.when(i % 9 != 0, "v").alias("value"), F.when(i % 4 != 0, F.concat(F.lit("word  "), word(3))).alias("quote"), (i % 2).alias("page"), F.lit(0).alias("gold_page"), F.when(i % 5 != 0, F.concat(F.lit("a word "), word(6), F.lit(" more"))).alias("gold_quote"))
    return E.evidence(leaves, ["field_name"]).select("field_name", "leaves", "with_quote", "judged", "page_agree", "quote_agree", F.round("coverage", 9).alias("coverage"))


@query("""WITH t AS (SELECT lang AS type, count(*) AS n, CAST(avg(n_chars) AS DOUBLE) AS recall FROM documents GROUP BY 1), g(name, type) AS (VALUES ('latin', 'fr'), ('latin', 'es'), ('other', 'en'), ('other', 'de'), ('none', 'xx'))
SELECT name, round(sum(recall * n) / nullif(sum(n), 0), 6) AS recall FROM g LEFT JOIN t USING (type) GROUP BY 1""")
def ag_weighted_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = _read(spark, sf_dir, "documents").groupBy(F.col("lang").alias("type")).agg(F.count("*").alias("n"), F.avg("n_chars").alias("recall"))
    return E.weighted_recall(types, {"latin": ["fr", "es"], "other": ["en", "de"], "none": ["xx"]}).select("name", F.round("recall", 6).alias("recall"))


@query("SELECT o_orderkey, o_orderkey % 4 <> 3 AS correct FROM orders")
def ev_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers judged by a rubric: the total has to be stated, another number must not be."""
    none = F.lit(None)
    rows = _answers(spark, sf_dir).withColumns({"status": F.lit("answered"), "numbers": F.array("total"), "forbidden": F.array((F.col("total") + 1000).cast("decimal(18,2)")), "day": none.cast("date"), "count": (F.col("o_orderkey") % 7).cast("int"), "any_of": F.array(F.lit("TOTAL"), F.lit("sum")), "all_of": none.cast("array<string>"), "abstain": F.lit(False), "answer": A.unmarked(F.col("answer"))})
    return E.judged(rows).select("o_orderkey", "correct")


@query("""SELECT o_custkey AS question_id, count(DISTINCT o_orderkey % 5) FILTER (WHERE o_orderkey % 5 IN (1, 2)) > 0 AS cites_relevant,
CAST(count(DISTINCT o_orderkey % 5) FILTER (WHERE o_orderkey % 5 IN (1, 2)) AS DOUBLE) / count(DISTINCT o_orderkey % 5) AS precision FROM orders GROUP BY 1""")
def ev_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("question_id")).agg(F.collect_list(F.col("o_orderkey") % 5).alias("cited")).withColumn("relevant", F.array(F.lit(1).cast("long"), F.lit(2).cast("long")))
    return E.cited(pairs)


@query("""SELECT count(*) FILTER (WHERE event_type <> 'error') AS n, round(avg(CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE event_type <> 'error'), 9) AS accuracy,
round(median(value) FILTER (WHERE event_type <> 'error'), 6) AS latency_p50, count(*) FILTER (WHERE event_type = 'error') AS errors, CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS views FROM events""")
def ev_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _read(spark, sf_dir, "events").select(F.col("event_type").alias("status"), (F.col("event_id") % 3 == 0).alias("correct"), F.lit(None).cast("boolean").alias("cites_relevant"), F.lit(None).cast("double").alias("precision"), F.col("value").cast("decimal(18,6)").alias("cost"), F.col("value").alias("latency_ms"), F.when(F.col("event_type") == "error", "failed").alias("error"))
    return E.summary(runs).select("n", F.round("accuracy", 9).alias("accuracy"), F.round("latency_p50", 6).alias("latency_p50"), "errors", F.coalesce(F.try_element_at("statuses", F.lit("view")), F.lit(0)).alias("views"))


@query("SELECT CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS currency, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS expected FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1")
def ev_expected_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("currency"), F.col("o_totalprice").alias("total"), "o_orderdate")
    return E.expected_totals(labels, F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")).select("currency", F.col("expected").cast("double").alias("expected"))


@query("SELECT doc_id FROM labels WHERE (doc_id % 3 = 0) <> (toxic = 1) OR (doc_id % 4 <> 0 AND (quality = 1) <> (toxic = 1)) OR doc_id % 11 = 0")
def ev_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    items = _read(spark, sf_dir, "labels").select("doc_id", (i % 3 == 0).alias("rubric"), F.when(i % 4 != 0, F.col("quality") == 1).alias("grader"), (F.col("toxic") == 1).alias("human"), F.when(i % 11 == 0, "failed").alias("error"))
    return E.disagreements(items).select("doc_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'primary' WHEN doc_id % 3 = 0 THEN 'later' ELSE 'label' END AS source, CASE WHEN doc_id % 4 <> 0 AND doc_id % 3 = 0 THEN CASE WHEN doc_id % 9 = 0 THEN 'r2' ELSE 'r1' END END AS run FROM documents""")
def ev_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, i = _read(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id")
    later = docs.where(i % 3 == 0).select("doc_id", F.lit("r1").alias("run"), F.lit(1).alias("started_at")).unionAll(docs.where(i % 9 == 0).select("doc_id", F.lit("r2"), F.lit(1)))
    return E.replays(docs, docs.where(i % 4 == 0), later)


@query("""WITH f AS (SELECT conv_id, turn % 3 AS key, min(turn) AS first FROM conversations WHERE turn % 5 <> 4 GROUP BY 1, 2), n AS (SELECT conv_id, key, row_number() OVER (PARTITION BY conv_id ORDER BY first) AS number FROM f)
SELECT c.conv_id AS answer_id, c.turn AS position, CASE WHEN turn % 5 <> 4 THEN number END AS number FROM conversations c LEFT JOIN n ON n.conv_id = c.conv_id AND n.key = c.turn % 3""")
def ev_numbered_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cites = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("position"), F.when(F.col("turn") % 5 != 4, F.col("turn") % 3).alias("key"))
    return E.numbered_citations(cites).select("answer_id", "position", "number")


@query("""WITH a AS (SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 3 = 0 THEN 'confidence' END AS old, CASE WHEN o_orderkey % 4 = 0 THEN 'confidence' WHEN o_orderkey % 5 = 0 THEN 'quote:total' END AS new FROM orders)
SELECT document_id, old, new FROM a WHERE old IS DISTINCT FROM new""")
def rcl_routing_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = _read(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = lambda reason: o.select(k.alias("document_id"), F.lit("total").alias("field_name"), reason.alias("reason")).where("reason is not null")
    return E.routing_changes(rows(F.when(k % 3 == 0, "confidence")), rows(F.when(k % 4 == 0, "confidence").when(k % 5 == 0, "quote:total"))).select("document_id", "old", "new")
