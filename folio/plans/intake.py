"""Answers of a model taken in: violations, stored fields, and the pages of quotes. Answers are written from orders and their lines, quotes
from conversations; the SQL reads the same JSON and computes what it finds there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import intake as I

SCHEMA = {"vendor": None, "total": None, "payment_method": None, "line_items": ("quantity", "total")}
THRESHOLD = 0.6

# The JSON text of a line's row and of an order's answer, in words that both engines read.
ROW = """CASE l_linenumber % 4 WHEN 0 THEN 'null' WHEN 1 THEN '{"quantity": {"value": ' || CAST(l_linenumber AS VARCHAR(9)) || ', "confidence": 1}, "total": {"value": "' || l_returnflag || '", "confidence": 0.5}}'
WHEN 2 THEN '{"quantity": 3, "total": {"value": null, "confidence": null}}' ELSE '{"total": {"value": 1, "confidence": "1e-2"}}' END"""
VENDOR = """CASE o_orderkey % 7 WHEN 0 THEN '"bare"' WHEN 1 THEN '{"value": null, "confidence": "0.5", "evidence": {"page": 2, "quote": "  seen   twice "}}' WHEN 2 THEN '{"confidence": 1}'
WHEN 3 THEN '{"value": "x", "confidence": "high"}' WHEN 4 THEN '{"value": 7, "confidence": 1.5, "evidence": {"quote": "no page"}}'
WHEN 5 THEN '{"value": true, "confidence": true, "evidence": {"page": 99, "quote": "' || o_orderpriority || '"}}' ELSE '{"value": "' || o_orderpriority || '", "confidence": 0.25, "evidence": {"page": 1, "quote": "' || o_orderstatus || '"}}' END"""
TOTAL = """CASE WHEN o_totalprice > 200000 THEN '{"value": "' || CAST(CAST(o_totalprice AS INT) AS VARCHAR(20)) || '", "confidence": -2, "evidence": {"page": 1.5, "quote": "half"}}' WHEN o_totalprice > 100000 THEN '{"value": 1, "confidence": "NaN"}' ELSE '{"value": 2, "confidence": 1e999}' END"""
ITEMS = """CASE WHEN o_orderkey % 11 = 0 THEN '{"value": "no list", "confidence": 1}' WHEN o_orderkey % 13 = 0 THEN '[]' ELSE '{"value": [' || items || '], "confidence": 0.8}' END"""
ANSWER = f"""CASE WHEN o_orderkey % 17 = 0 THEN 'no json' WHEN o_orderkey % 19 = 0 THEN '[1]' WHEN o_orderkey % 23 = 0 THEN NULL
ELSE '{{' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '"vendor": ' || {VENDOR} || ', ' END || '"payment_method": {{"value": "VISA 4111 1111 1111 1111", "confidence": 0.9}}, "total": ' || {TOTAL} || ', "line_items": ' || {ITEMS} || '}}' END"""
PAGES = "CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE o_orderkey % 3 END"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, answer, pages."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.struct("l_linenumber", F.expr(ROW).alias("t")).alias("row"))
    rows = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["t"]), ", ").alias("items"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").join(rows, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.select("o_orderkey", F.expr(ANSWER).alias("answer"), F.expr(PAGES).alias("pages"))


def ex_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places at which each answer breaks the schema, and the list that is shown."""
    found = answers(spark, sf_dir).select("o_orderkey", I.violations(F.col("answer"), SCHEMA).alias("v"))
    return found.select("o_orderkey", F.size("v").cast("bigint").alias("n"), F.array_join("v", ",").alias("paths"), I.listed(F.col("v"), 3).alias("shown"))


def ex_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored of each field of each answer: its confidence, whether it waits for review, its citation, its rows."""
    rows = I.fields(answers(spark, sf_dir), "o_orderkey", SCHEMA, THRESHOLD)
    cite = lambda c: F.get_json_object("value", f"$.evidence.{c}")
    listing = F.from_json("value", "array<struct<quantity:struct<confidence:double>,total:struct<confidence:double>>>")
    sure = F.aggregate(listing, F.lit(0.0), lambda a, r: a + r["quantity"]["confidence"] + r["total"]["confidence"])
    is_list = F.col("field_name") == "line_items"
    return rows.select(
        "o_orderkey", "field_name", "confidence", "needs_review", cite("page").cast("bigint").alias("page"), cite("quote").alias("quote"),
        F.when(is_list, F.size(listing)).cast("bigint").alias("n_rows"), F.when(is_list, F.round(sure, 6)).alias("cells"), F.when(F.col("field_name") == "payment_method", F.get_json_object("value", "$.value")).alias("payment"),
    )


def ex_quotes_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words 3 to 7 of every conversation turn, cited on the turn after it: the page that each quote really stands on."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page"), "text")
    words = F.array_join(F.slice(F.split(F.trim(I.collapsed(F.col("text"))), " "), 3, 5), " ")
    quotes = turns.select("document_id", F.col("page").alias("cited"), (F.col("page") + 1).alias("page"), words.alias("quote")).where("quote <> ''")
    return I.placed(quotes, turns)


LEAVES = f"""WITH o AS (
  SELECT o_orderkey, CASE WHEN json_valid(answer) THEN CAST(answer AS JSON) END AS a, pages FROM (
    SELECT o_orderkey, {ANSWER} AS answer, {PAGES} AS pages FROM orders JOIN (SELECT l_orderkey, string_agg({ROW}, ', ' ORDER BY l_linenumber) AS items FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)),
f AS (SELECT o_orderkey, pages, unnest([{{'p': 1, 'name': 'vendor', 'leaf': a->'$.vendor'}}, {{'p': 2, 'name': 'total', 'leaf': a->'$.total'}}, {{'p': 3, 'name': 'payment_method', 'leaf': a->'$.payment_method'}}, {{'p': 4, 'name': 'line_items', 'leaf': a->'$.line_items'}}], recursive := true) FROM o),
k AS (SELECT *, CASE json_type(leaf->'$.confidence') WHEN 'VARCHAR' THEN TRY_CAST(leaf->>'$.confidence' AS DOUBLE) WHEN 'BOOLEAN' THEN CAST(CAST(leaf->>'$.confidence' AS BOOLEAN) AS DOUBLE) ELSE TRY_CAST(leaf->>'$.confidence' AS DOUBLE) END AS c FROM f),
g AS (SELECT *, coalesce(json_exists(leaf, '$.value') AND isfinite(c), false) AS ok FROM k),
r AS (SELECT o_orderkey, row, list_extract(rows, row + 1) AS x FROM (SELECT o_orderkey, rows, unnest(range(len(rows))) AS row FROM (SELECT o_orderkey, CAST(leaf->'$.value' AS JSON[]) AS rows FROM g WHERE ok AND name = 'line_items' AND json_type(leaf->'$.value') = 'ARRAY'))),
s AS (SELECT o_orderkey, row, unnest([{{'q': 1, 'cell': 'quantity', 'leaf': x->'$.quantity'}}, {{'q': 2, 'cell': 'total', 'leaf': x->'$.total'}}], recursive := true) FROM r),
t AS (SELECT *, TRY_CAST(leaf->>'$.confidence' AS DOUBLE) AS c, coalesce(json_exists(leaf, '$.value') AND isfinite(TRY_CAST(leaf->>'$.confidence' AS DOUBLE)), false) AS ok FROM s)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"ex_violations": ex_violations, "ex_fields": ex_fields, "ex_quotes_placed": ex_quotes_placed}
ORACLE: dict[str, str] = {
    "ex_violations": LEAVES + """, v AS (
  SELECT o_orderkey, p, 0 AS row, 0 AS q, name AS path FROM g WHERE NOT ok UNION ALL SELECT o_orderkey, 4, row, q, 'line_items.value[' || row || '].' || cell FROM t WHERE NOT ok),
w AS (SELECT o_orderkey, list(path ORDER BY p, row, q) AS l FROM v GROUP BY 1)
SELECT o.o_orderkey, coalesce(len(l), 0)::BIGINT AS n, coalesce(array_to_string(l, ','), '') AS paths,
  coalesce(array_to_string(list_concat(list_transform(l[1:3], lambda x: '- ' || x), CASE WHEN len(l) > 3 THEN ['- … (' || (len(l) - 3) || ' more)'] ELSE [] END), chr(10)), '') AS shown
FROM o LEFT JOIN w USING (o_orderkey)""",
    "ex_fields": LEAVES + f""", e AS (
  SELECT *, trim(leaf->>'$.evidence.quote') AS words, CASE WHEN json_type(leaf->'$.evidence.page') IN ('UBIGINT', 'BIGINT') THEN CAST(leaf->>'$.evidence.page' AS BIGINT) END AS said FROM g),
c AS (SELECT o_orderkey, count(DISTINCT row) AS n_rows, round(sum(CASE WHEN ok THEN least(greatest(c, 0), 1) ELSE 0 END), 6) AS cells FROM t GROUP BY 1)
SELECT e.o_orderkey, name AS field_name, CASE WHEN ok THEN least(greatest(c, 0.0), 1.0) ELSE 0.0 END AS confidence, CASE WHEN ok THEN least(greatest(c, 0.0), 1.0) ELSE 0.0 END < {THRESHOLD} AS needs_review,
  CASE WHEN ok AND name <> 'line_items' AND length(words) BETWEEN 1 AND 200 THEN CASE WHEN pages IS NULL THEN 1 WHEN said BETWEEN 1 AND pages THEN said END END AS page,
  CASE WHEN ok AND name <> 'line_items' AND length(words) BETWEEN 1 AND 200 THEN words END AS quote,
  CASE WHEN name = 'line_items' THEN coalesce(n_rows, 0) END AS n_rows, CASE WHEN name = 'line_items' THEN coalesce(cells, 0.0) END AS cells,
  CASE WHEN ok AND name = 'payment_method' THEN regexp_replace(leaf->>'$.value', '[0-9][0-9 ]{{10,}}([0-9]{{4}})', '****\\1') END AS payment
FROM e LEFT JOIN c USING (o_orderkey)""",
    "ex_quotes_placed": r"""WITH d AS (SELECT conv_id AS document_id, turn AS page, ' ' || trim(regexp_replace(text, '\s+', ' ', 'g')) || ' ' AS said FROM conversations),
q AS (SELECT document_id, page AS cited, page + 1 AS page, array_to_string(string_split(trim(said), ' ')[3:7], ' ') AS quote FROM d),
f AS (SELECT q.document_id, cited, q.page, quote, min(d.page) AS first, bool_or(d.page = q.page) AS stays FROM q LEFT JOIN d ON d.document_id = q.document_id AND contains(said, ' ' || quote || ' ') WHERE quote <> '' GROUP BY ALL)
SELECT document_id, cited, CASE WHEN stays THEN page ELSE first END AS page, quote FROM f""",
}
