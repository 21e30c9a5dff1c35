"""Readers of labels, page texts, run files, samples and query sets. Money is read as decimals, never through doubles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEC = "decimal(38,6)"
LABEL = f"""doc_id string, image string, mime_type string, source string, dataset_version string, difficulty string,
fields struct<vendor: string, invoice_number: string, po_number: string, vendor_tax_id: string, document_date: string, due_date: string,
 payment_terms: string, payment_method: string, payment_card_last4: string, currency: string, subtotal: {DEC}, discount: {DEC}, shipping: {DEC},
 tax: {DEC}, tip: {DEC}, total: {DEC}, amount_paid: {DEC}, amount_due: {DEC},
 line_items: array<struct<description: string, quantity: {DEC}, unit_price: {DEC}, total: {DEC}>>,
 tax_lines: array<struct<label: string, rate: {DEC}, base: {DEC}, amount: {DEC}>>>,
evidence map<string, struct<page: int, quote: string>>, _corrupt_record string"""
RUN = "model string, prompt_version string, dataset_version string, started_at_utc string, total_cost_usd double, mean_cost_per_doc double, latency_p50_ms double, latency_p95_ms double, n_scored int, n_errors int, summary struct<overall_accuracy: double, mean_confidence: double, per_field_accuracy: map<string, double>>, _corrupt_record string"
SAMPLE = "name string, start double, ms double, ok boolean, error string, first_event_ms double, answer_ms double, document_id string"
QUERY_SET = "queries array<struct<id: string, type: string, query: string, relevant: struct<item: string, vendors: array<string>, doc_ids: array<string>>>>"
STAND_IN = "scripted"


class BadInput(ValueError):
    """Input files break a rule that their reader states."""


def _refuse(rows: DataFrame, what: str) -> None:
    found = [r[0] for r in rows.limit(5).collect()]
    if found:
        raise BadInput(f"{what}: {', '.join(map(str, found))}")


def labels(spark: SparkSession, folder: str, doc_ids: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Labels by doc_id: first the wanted ids, then the limit. A file that isn't a label, or a repeated id, is an error."""
    rows = spark.read.schema(LABEL).option("multiLine", True).json(folder).withColumn("file", F.input_file_name())
    usable = F.col("doc_id").isNotNull() & F.col("fields").isNotNull() & F.col("_corrupt_record").isNull()
    _refuse(rows.where(~usable).select("file"), "not labels")
    _refuse(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated labels")
    rows = rows.drop("_corrupt_record", "file")
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(list(doc_ids)))
    rows = rows.orderBy("doc_id")
    return rows if limit is None else rows.limit(limit)


def page_texts(spark: SparkSession, folder: str, known: DataFrame) -> DataFrame:
    """One page per text file (doc_id.txt) whose doc_id is known."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1)
    texts = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(F.url_decode(name).alias("doc_id"), F.lit(1).alias("page_number"), F.col("value").alias("text"))
    return texts.join(known.select("doc_id").distinct(), "doc_id", "left_semi")


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Run files by start, newest last; unreadable ones, those without a model or summary and stand-ins are left out."""
    rows = spark.read.schema(RUN).option("multiLine", True).json(folder).withColumn("file", F.input_file_name())
    kept = rows.where("_corrupt_record IS NULL AND model IS NOT NULL AND started_at_utc IS NOT NULL AND summary IS NOT NULL").where(F.col("model") != STAND_IN)
    return kept.drop("_corrupt_record").orderBy("started_at_utc", "file")


def newest(rows: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """The row of the last file name, for each key."""
    columns = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*columns), "file").alias("r")).where("r IS NOT NULL").select(*key, "r.*")


def samples(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines samples; a torn line is dropped, and so are lines without a name or start."""
    return spark.read.schema(SAMPLE).option("mode", "DROPMALFORMED").json(path).where("name IS NOT NULL AND start IS NOT NULL")


def query_set(spark: SparkSession, path: str) -> DataFrame:
    """Retrieval queries; a repeated id or a query without relevant items is an error."""
    rows = spark.read.schema(QUERY_SET).option("multiLine", True).json(path).selectExpr("inline(queries)")
    _refuse(rows.groupBy("id").count().where("count > 1").select("id"), "repeated queries")
    _refuse(rows.where("relevant.item IS NULL AND coalesce(size(relevant.vendors), 0) = 0 AND coalesce(size(relevant.doc_ids), 0) = 0").select("id"), "queries without relevance")
    return rows


def database_samples(lines: DataFrame, line: str = "value") -> DataFrame:
    """Sampler lines at|kind|state|n, white space around parts ignored; others are dropped."""
    parts = F.split(F.col(line), r"\|")
    cell = lambda i: F.trim(F.try_element_at(parts, F.lit(i)))
    rows = lines.select(cell(1).try_cast("double").alias("at"), cell(2).alias("kind"), cell(3).alias("state"), cell(4).try_cast("bigint").alias("n"), F.size(parts).alias("_n"))
    return rows.where("_n = 4 AND at IS NOT NULL AND n IS NOT NULL").drop("_n")


def byte_size(text: Column) -> Column:
    """Bytes of 1.5GiB, 20kB and the like: KiB and so on are powers of 1024, kB and so on of 1000. Null if it isn't one."""
    pattern = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([kKMGT]?)(i?)B\s*$"
    exponent = F.array_position(F.array(*map(F.lit, "KMGT")), F.upper(F.regexp_extract(text, pattern, 2)))
    base = F.when(F.regexp_extract(text, pattern, 3) == "i", 1024.0).otherwise(1000.0)
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1).try_cast("double") * F.pow(base, exponent))


def questions(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """Questions with the documents they name (doc_ids); a repeated id, or a document that isn't known, is an error."""
    rows = spark.read.schema("questions array<struct<id: string, question: string, doc_ids: array<string>, numbers: array<decimal(18,2)>, abstain: boolean>>").option("multiLine", True).json(path).selectExpr("inline(questions)")
    _refuse(rows.groupBy("id").count().where("count > 1").select("id"), "repeated questions")
    named = rows.select("id", F.explode("doc_ids").alias("doc_id"))
    _refuse(named.join(known.select("doc_id").distinct(), "doc_id", "left_anti").select(F.concat_ws(" of ", "doc_id", "id")), "unknown documents")
    return rows


def calibration(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """Answers that people judged: id, question_id, answer, human_correct, human_grounded; one to an unknown question is an error."""
    rows = spark.read.schema("items array<struct<id: string, question_id: string, answer: string, human_correct: boolean, human_grounded: boolean, note: string>>").option("multiLine", True).json(path).selectExpr("inline(items)")
    _refuse(rows.join(asked.select(F.col("id").alias("question_id")).distinct(), "question_id", "left_anti").select("id"), "answers to unknown questions")
    return rows


def suite_runs(spark: SparkSession, folder: str, schema: str, required: Sequence[str]) -> DataFrame:
    """Run files of another suite by start: unreadable ones, and those without a required field, are left out."""
    rows = spark.read.schema(f"started_at_utc string, model string, {schema}, _corrupt_record string").option("multiLine", True).json(folder).withColumn("file", F.input_file_name())
    kept = rows.where("_corrupt_record IS NULL AND started_at_utc IS NOT NULL")
    for name in required:
        kept = kept.where(F.col(name).isNotNull())
    return kept.drop("_corrupt_record").orderBy("started_at_utc", "file")


def container_stats(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines name|cpu%|used / limit of a container sampler: name, cpu (percent), used, most (bytes); others are dropped."""
    parts = F.split(F.col(line), r"\|")
    memory = F.split(F.try_element_at(parts, F.lit(3)), r"\s*/\s*")
    rows = lines.select(F.trim(F.get(parts, 0)).alias("name"), F.regexp_extract(F.try_element_at(parts, F.lit(2)), r"^\s*([0-9.]+)%\s*$", 1).try_cast("double").alias("cpu"), byte_size(F.get(memory, 0)).alias("used"), byte_size(F.try_element_at(memory, F.lit(2))).alias("most"))
    return rows.where("name <> '' AND cpu IS NOT NULL AND used IS NOT NULL AND most IS NOT NULL")
