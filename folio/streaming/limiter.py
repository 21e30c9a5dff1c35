"""Sliding-log rate limiter: at most limit allowed calls of a client within any minute; refused calls aren't recorded."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW = 60.0
RESULT = "client string, call_id bigint, at double, allowed boolean, retry_after double"


def step(hits: deque[float], at: float, limit: int) -> tuple[bool, float | None]:
    """Judges a call and records it if it's allowed. A limit of 0 or less allows all. retry_after is in seconds."""
    if limit <= 0:
        return True, None
    while hits and hits[0] <= at - WINDOW:
        hits.popleft()
    if len(hits) >= limit:
        return False, hits[0] + WINDOW - at
    hits.append(at)
    return True, None


def replayed(calls: DataFrame, limit: int) -> DataFrame:
    """Verdicts over recorded calls (client, call_id, at in seconds). Calls of one time go by call_id. Clients are sorted
    within partitions and scanned in batches, so memory holds one client's window and not its calls. Calls without a client
    or a time take no part."""
    rows = calls.select("client", "call_id", F.col("at").cast("double")).where("client IS NOT NULL AND at IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, hits = None, deque()
        for batch in batches:
            out = []
            for c, i, at in batch.itertuples(index=False):
                if c != client:
                    client, hits = c, deque()
                out.append((c, i, at, *step(hits, at, limit)))
            yield pd.DataFrame(out, columns=["client", "call_id", "at", "allowed", "retry_after"])

    return rows.repartition("client").sortWithinPartitions("client", "at", "call_id").mapInPandas(run, RESULT)


def limited(calls: DataFrame, limit: int, evict: bool = True) -> DataFrame:
    """The same over a stream; clients idle for a window give up their state. Timeouts keep a query that should end when its
    input does (trigger availableNow) running: pass evict=False there."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(batches)).sort_values(["at", "call_id"])  # one trigger's calls of one client
        yield pd.DataFrame([(c, i, at, *step(hits, at, limit)) for c, i, at in rows[["client", "call_id", "at"]].itertuples(index=False)], columns=["client", "call_id", "at", "allowed", "retry_after"])
        state.update((list(hits),))
        if evict:
            state.setTimeoutDuration(int(WINDOW * 1000))

    rows = calls.select("client", "call_id", F.col("at").cast("double")).where("client IS NOT NULL AND at IS NOT NULL")
    return rows.groupBy("client").applyInPandasWithState(run, RESULT, "hits array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout if evict else GroupStateTimeout.NoTimeout)
