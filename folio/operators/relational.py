"""Relational operators of the document model: latest versions, three-valued filters, rollups, ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.money import currency_key, iso_date, usable


def latest(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given total order (pushed down as a window group limit)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def corrected(value: Column, action: Column, correction: Column) -> Column:
    """A field's value; a correction wins even when it is null."""
    return F.when(action == "corrected", correction).otherwise(value)


def pivoted(fields: DataFrame, key: str, name: str, value: str, wanted: Sequence[str]) -> DataFrame:
    """One wide row per key; keys without a wanted field stay, with nulls."""
    return fields.groupBy(key).agg(*(F.first(F.when(F.col(name) == w, F.col(value)), True).alias(w) for w in wanted))


def contains_text(value: Column, needle: str) -> Column:
    """Case-insensitive literal substring; null values are FALSE, an empty needle filters nothing."""
    return F.lit(True) if not needle else F.coalesce(F.lower(value).contains(needle.lower()), F.lit(False))


def equals_text(value: Column, needle: str) -> Column:
    return F.lit(True) if not needle else F.coalesce(F.upper(value) == needle.upper(), F.lit(False))


def dated_within(value: Column, start: str | None, end: str | None) -> Column:
    """Inclusive bounds on a textual date; anything but a calendar day fails a bound."""
    day, test = iso_date(value), F.lit(True)
    if start:
        test = test & (day >= F.lit(start).try_cast("date"))
    if end:
        test = test & (day <= F.lit(end).try_cast("date"))
    return F.coalesce(test, F.lit(False)) if start or end else F.lit(True)


def total_within(total: Column, low: str | None, high: str | None) -> Column:
    """Inclusive bounds; a missing total fails a bound and passes without one. A bound that is no number lets nothing pass."""
    test = F.lit(True)
    if low is not None:
        test = test & (total >= F.lit(low).try_cast("decimal(38,6)"))
    if high is not None:
        test = test & (total <= F.lit(high).try_cast("decimal(38,6)"))
    return F.coalesce(test, F.lit(False)) if low is not None or high is not None else F.lit(True)


def any_item(items: Column, test) -> Column:
    """TRUE if some item passes, else unknown if some test is unknown, else FALSE; a null list is FALSE."""
    return F.when(items.isNull(), F.lit(False)).otherwise(F.exists(items, test))


def truth_rank(test: Column) -> Column:
    """2 for TRUE, 1 for unknown, 0 for FALSE: the largest of a group answers whether any of it passes."""
    return F.when(test, 2).when(test.isNull(), 1).otherwise(0)


def currency_totals(rows: DataFrame, currency: str, total: str) -> DataFrame:
    """Per currency: matching documents, documents without a usable total, exact sum (null where none has one)."""
    good = usable(F.col(total))
    return rows.groupBy(currency_key(F.col(currency)).alias("currency")).agg(F.count("*").alias("n_documents"), F.count_if(good.isNull()).alias("missing_total"), F.sum(good).alias("sum_total"))


def zero_filled_counts(df: DataFrame, column: str, known: Sequence[str]) -> DataFrame:
    """Counts by value: known values with 0 where absent, unknown values kept."""
    every = df.sparkSession.createDataFrame([(k,) for k in known], f"{column} string")
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return every.join(counts, column, "full_outer").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def calendar(df: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each day between two dates."""
    return df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).try_cast("date"), F.lit(end).try_cast("date"))).alias("day"))


def on_calendar(days: DataFrame, *daily: DataFrame) -> DataFrame:
    """Daily aggregates side by side on a dense calendar; the days decide which rows there are."""
    for d in daily:
        days = days.join(d, "day", "left")
    return days


def nearest_rank(column: str, p: float) -> Column:
    """Exact nearest-rank percentile: the value at ceil(p n). One task holds a group's distinct values: see ranked_values."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def rank_of(p: str) -> Column:
    """The nearest rank of a share of n rows."""
    return F.greatest(F.ceil(F.col("n") * F.lit(p).cast("decimal(6,4)")), F.lit(1)).cast("long")


def ranked_values(df: DataFrame, key: str, value: str, ranks: dict[str, Column], bins: int = 4096) -> DataFrame:
    """key, n and, for each name, the value at a rank (from 1, a Column of n) among the group's values that aren't null.

    Groups of any size: values are counted in bins of equal width, only those of the bins that hold a wanted rank are looked at,
    and equal ones are counted first; so no task holds a group.
    """
    known = df.where(F.col(value).isNotNull()).select(key, F.col(value).alias("_v"))
    span = known.groupBy(key).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("*").alias("n"))
    share = (F.col("_v") - F.col("lo")).cast("double") / (F.col("hi") - F.col("lo")).cast("double")
    binned = known.join(span, key).select(key, "_v", F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor(share * bins), F.lit(bins - 1))).cast("int").alias("_bin"))
    upto = Window.partitionBy(key).orderBy("_bin")
    counts = binned.groupBy(key, "_bin").agg(F.count("*").alias("_c")).withColumn("_upto", F.sum("_c").over(upto))
    asked = span.select(key, F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank.alias("rank")) for name, rank in ranks.items()))).alias("w")).select(key, "w.name", "w.rank")
    spots = asked.join(counts, key).where("_upto - _c < rank AND rank <= _upto").select(key, "name", "_bin", (F.col("rank") - F.col("_upto") + F.col("_c")).alias("_r"))
    inside = binned.join(spots, [key, "_bin"]).groupBy(key, "name", "_r", "_v").agg(F.count("*").alias("_c"))
    inside = inside.withColumn("_upto", F.sum("_c").over(Window.partitionBy(key, "name").orderBy("_v"))).where("_upto >= _r")
    found = inside.groupBy(key).agg(*(F.min(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in ranks))
    return span.select(key, "n").join(found, key)


def reciprocal_rank_fusion(lists: Sequence[DataFrame], key: Sequence[str], k: int = 60) -> DataFrame:
    """Ranked lists (key, id, rank) fused: sum of 1 / (k + rank); ties keep the order of the first list that has the id."""
    tagged = [d.select(*key, "id", "rank", F.lit(i).alias("_list")) for i, d in enumerate(lists)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t)
    fused = union.groupBy(*key, "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(F.struct("_list", "rank")).alias("_first"))
    order = Window.partitionBy(*key).orderBy(F.desc(F.round("score", 12)), F.col("_first._list"), F.col("_first.rank"))
    return fused.withColumn("position", F.row_number().over(order)).drop("_first")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def paged(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page in a total order; limit 1 to 200."""
    return df.orderBy(*order).offset(max(offset, 0)).limit(min(max(limit, 1), 200))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Confusion counts of two 0/1 raters, observed and expected agreement, Cohen's kappa (1 where expected is 1)."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(*(F.count_if((F.col(a) == x) & (F.col(b) == y)).alias(n) for n, x, y in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1), ("tn", 0, 0))))
    c = c.withColumn("n", F.expr("tp + fp + fn + tn"))
    c = c.withColumn("observed", F.expr("try_divide(cast(tp + tn as double), n)")).withColumn("expected", F.expr("try_divide(cast((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn) as double), cast(n as double) * n)"))
    return c.withColumn("kappa", F.expr("case when expected = 1 then 1.0D else try_divide(observed - expected, 1 - expected) end"))
