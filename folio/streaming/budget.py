"""The daily budget gate over recorded events: whether a day's recorded spend had reached a cap when something was asked for.

An organization's own cap comes first, then the installation's, over all organizations; a cap of 0 or less is off. A day is a UTC day, so
both start anew at midnight.

Running sums are made on two levels: the sums of a day's minutes, which are few, and the events within a minute. So neither a
large organization nor the whole installation's day is one task's.

Cases: an event without a cost is an ask and adds nothing; spend at the very time of an ask counts if its id is smaller; an event
without a time takes no part; one without an organization has only the installation's cap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(38,6)"
PART = 60


def running(events: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """events (day, part, at, event_id, cost and more) with the sum of cost of the events before each, among those of its keys and
    its day."""
    minute = [*keys, "day", "part"]
    sums = events.groupBy(*minute).agg(F.sum("cost").alias("_sum"))
    earlier = Window.partitionBy(*keys, "day").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_earlier", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    within = Window.partitionBy(*minute).orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("_within", F.coalesce(F.sum("cost").over(within), F.lit(0)))
    same = [rows[k].eqNullSafe(sums[k]) for k in minute]
    joined = rows.join(sums, same)
    return joined.select(*(rows[c] for c in events.columns), (F.col("_within") + F.col("_earlier")).cast(MONEY).alias(name))


def gated(events: DataFrame, organization_cap: str | float, installation_cap: str | float) -> DataFrame:
    """event_id, organization_id, own_spend, all_spend, refused_by (organization, installation or null), retry_after (seconds to midnight,
    of refused ones) of each ask. events: event_id, organization_id, at (timestamp), cost (null: an ask)."""
    at = F.col("at").cast("timestamp")
    seconds = F.unix_seconds(at) - F.unix_seconds(F.date_trunc("day", at))
    rows = events.select("event_id", "organization_id", at.alias("at"), F.col("cost").cast(MONEY).alias("cost")).where("at is not null")
    rows = rows.withColumns({"day": F.to_date("at"), "part": F.floor(seconds / PART).cast("int")})
    rows = running(running(rows, ["organization_id"], "own_spend"), [], "all_spend")
    cap = lambda c: F.lit(str(c)).cast(MONEY)
    reached = lambda spend, c: (cap(c) > 0) & (F.col(spend) >= cap(c))
    by = F.when(F.col("organization_id").isNotNull() & reached("own_spend", organization_cap), "organization").when(reached("all_spend", installation_cap), "installation")
    asks = rows.where("cost is null").withColumn("refused_by", by)
    left: Column = F.lit(86_400) - (F.unix_seconds("at") - F.unix_seconds(F.date_trunc("day", "at")))
    return asks.select("event_id", "organization_id", "own_spend", "all_spend", "refused_by", F.when(F.col("refused_by").isNotNull(), left).cast("bigint").alias("retry_after"))
