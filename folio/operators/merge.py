"""Merging the pages of a document: one leaf per field from the leaves that the pages gave.

Rows: document_id, field_name, page, value (JSON text, null if the page has none), confidence, quote.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators.records import kind_of, text_of

#: Pages that disagree leave at most this confidence.
CONFLICT = 0.5


def coerced(value: Column, confidence: Column, whole: Column) -> tuple[Column, Column]:
    """Value and confidence of a page's leaf: a malformed one (whole is false) is null with confidence 0; confidence is kept within
    0 and 1, and what isn't a number is 0."""
    sure = F.when(confidence.isNotNull() & ~F.isnan(confidence), F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return F.when(whole, value), F.when(whole, sure).otherwise(F.lit(0.0))


def alike(value: Column) -> Column:
    """What agreeing values share: texts without case and outer white space, numbers to two decimals, others as they are."""
    number = F.round(value.try_cast("decimal(38,6)"), 2).cast("string")
    text = F.concat(F.lit('"'), F.lower(F.regexp_replace(text_of(value), r"(?U)^\s+|\s+$", "")))
    return F.when(kind_of(value) == "text", text).when(kind_of(value) == "number", F.coalesce(number, value)).when(kind_of(value) != "null", value)


def merged_scalars(pages: DataFrame, latest: Sequence[str] = ()) -> DataFrame:
    """document_id, field_name, value, confidence, evidence (page, quote) of each field.

    The most confident value that isn't null wins; of equal ones that of the earliest page (of the latest, for the fields named
    in `latest`). Values that disagree cap the confidence. Without any value the least confidence counts. A winner without a quote
    borrows that of the most confident page that agrees with it. Agreeing values meet first, so no page list is collected.
    """
    sign = F.when(F.col("field_name").isin(list(latest)), 1).otherwise(-1) if latest else F.lit(-1)
    rows = pages.withColumn("_alike", alike(F.col("value"))).withColumn("_turn", F.col("page") * sign)
    place = F.struct("confidence", "_turn", "page", "value", "quote")
    cited = F.when(F.col("quote").isNotNull(), place)
    groups = rows.groupBy("document_id", "field_name", "_alike").agg(F.max(place).alias("top"), F.max(cited).alias("cited"), F.min("confidence").alias("low"))
    some = F.col("_alike").isNotNull()
    out = groups.groupBy("document_id", "field_name").agg(F.max(F.when(some, F.struct("top", "cited"))).alias("best"), F.count_if(some).alias("kinds"), F.min("low").alias("low"))
    sure = F.when(F.col("kinds") == 0, F.col("low")).when(F.col("kinds") > 1, F.least("best.top.confidence", F.lit(CONFLICT))).otherwise(F.col("best.top.confidence"))
    spot = lambda x: F.struct(F.col(f"best.{x}.page").alias("page"), F.col(f"best.{x}.quote").alias("quote"))
    evidence = F.when(F.col("best.top.quote").isNotNull(), spot("top")).when(F.col("best.cited").isNotNull(), spot("cited"))
    return out.select("document_id", "field_name", F.col("best.top.value").alias("value"), sure.alias("confidence"), evidence.alias("evidence"))


def merged_arrays(pages: DataFrame) -> DataFrame:
    """document_id, field_name, value, confidence: the pages' lists one after the other; the least confidence of the pages that
    gave one; no list at all is an empty one of confidence 0."""
    given = kind_of(F.col("value")) == "list"
    lists = F.when(given, F.struct("page", F.substring(F.trim("value"), F.lit(2), F.length(F.trim("value")) - 2).alias("items")))
    out = pages.groupBy("document_id", "field_name").agg(F.array_sort(F.collect_list(lists)).alias("lists"), F.min(F.when(given, F.col("confidence"))).alias("confidence"))
    filled = F.filter(F.col("lists.items"), lambda x: F.trim(x) != "")
    return out.select("document_id", "field_name", F.concat(F.lit("["), F.array_join(filled, ","), F.lit("]")).alias("value"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def field_rows(merged: DataFrame, schema: DataFrame, threshold: float) -> DataFrame:
    """One row for each field of the schema (field_name) and document: value, confidence, needs_review (missing, or less confident
    than the threshold). Fields that aren't in the schema are left out."""
    every = merged.select("document_id").distinct().join(F.broadcast(schema.select("field_name")))
    rows = every.join(merged, ["document_id", "field_name"], "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    return rows.withColumn("needs_review", F.col("confidence") < threshold)
