"""Job life cycle: claims, settlements by attempt, retries with backoff, cancellations, expired leases.

Events are (job_id, seq, at, event, attempt, retryable, message) with at in seconds and event one of created, claim,
complete, fail, cancel, reclaim. A settlement of another attempt than the current one is stale and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Attempts, backoff in seconds, lease in seconds.
MOST_ATTEMPTS = 3
BACKOFF_BASE, BACKOFF_MOST, RETRY_AFTER_MOST = 2.0, 60.0, 900.0
LEASE = 900.0
STATE = "state string, attempts int, started_at double, finished_at double, run_after double, last_error string"
RESULT = f"job_id string, seq bigint, event string, outcome string, {STATE}"
COLUMNS = [c.split()[0] for c in RESULT.split(", ")]


@dataclass
class Job:
    state: str | None = None
    attempts: int = 0
    started_at: float | None = None
    finished_at: float | None = None
    run_after: float | None = None
    last_error: str | None = None


def backoff(attempt: int, jitter: float = 0.0, retry_after: float = 0.0) -> float:
    """Half of a doubling delay plus a share (jitter, 0 to 1) of the other half; never below what the server asked for."""
    half = min(BACKOFF_MOST, BACKOFF_BASE * 2 ** (attempt - 1)) / 2
    return max(half + jitter * half, min(retry_after, RETRY_AFTER_MOST))


def backoff_delay(attempt: Column, jitter: Column, retry_after: Column) -> Column:
    half = F.least(F.lit(BACKOFF_MOST), F.lit(BACKOFF_BASE) * F.pow(F.lit(2.0), attempt - 1)) / 2
    return F.greatest(half + jitter * half, F.least(retry_after, F.lit(RETRY_AFTER_MOST)))


def step(job: Job, at: float, event: str, attempt: int | None, retryable: bool, message: str | None) -> str:
    """Applies an event to job; applied, ignored (the state doesn't allow it) or stale (another attempt's settlement)."""
    if event == "created":
        if job.state is not None:
            return "ignored"
        job.state = "pending"
    elif event == "claim":
        if job.state != "pending" or (job.run_after is not None and job.run_after > at):
            return "ignored"
        job.state, job.attempts, job.started_at = "processing", job.attempts + 1, at
    elif event == "reclaim":
        if job.state != "processing" or (job.started_at is not None and job.started_at > at - LEASE):
            return "ignored"
        job.state = "failed" if job.attempts >= MOST_ATTEMPTS else "pending"
        job.finished_at = at if job.state == "failed" else None
    elif event in ("complete", "fail", "cancel"):
        if job.state != "processing" or attempt != job.attempts:
            return "stale"
        if event == "complete":
            job.state, job.finished_at = "done", at
        elif event == "cancel":
            job.state, job.attempts = "pending", job.attempts - 1
        elif retryable and job.attempts < MOST_ATTEMPTS:
            job.state, job.run_after, job.last_error = "pending", at + backoff(job.attempts), message
        else:
            job.state, job.finished_at, job.last_error = "failed", at, message
    else:
        return "ignored"
    return "applied"


def _applied(job: Job, rows: pd.DataFrame) -> list[tuple]:
    out = []
    for job_id, seq, at, event, attempt, retryable, message in rows.itertuples(index=False):
        outcome = step(job, at, event, None if pd.isna(attempt) else int(attempt), retryable is True or retryable == 1, None if pd.isna(message) else message)
        out.append((job_id, seq, event, outcome, *astuple(job)))
    return out


def _events(events: DataFrame) -> DataFrame:
    kept = events.select("job_id", "seq", F.col("at").cast("double"), "event", "attempt", F.coalesce("retryable", F.lit(False)).alias("retryable"), "message")
    return kept.where("job_id IS NOT NULL AND at IS NOT NULL AND event IS NOT NULL")


def replayed(events: DataFrame) -> DataFrame:
    """Outcome of each recorded event and the job's state after it, in the order (at, seq). Events are sorted within
    partitions and scanned, so that memory holds one job. Events without a job, time or kind take no part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, job = None, Job()
        for batch in batches:
            out = []
            for job_id, part in batch.groupby("job_id", sort=False):
                if job_id != current:
                    current, job = job_id, Job()
                out += _applied(job, part)
            yield pd.DataFrame(out, columns=COLUMNS)

    return _events(events).repartition("job_id").sortWithinPartitions("job_id", "at", "seq").mapInPandas(run, RESULT)


def followed(events: DataFrame) -> DataFrame:
    """The same over a stream. Finished jobs keep a state, so that late settlements are stale ones."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        job = Job(*state.get) if state.exists else Job()
        yield pd.DataFrame(_applied(job, pd.concat(list(batches)).sort_values(["at", "seq"])), columns=COLUMNS)
        state.update(astuple(job))

    return _events(events).groupBy("job_id").applyInPandasWithState(run, RESULT, STATE, "append", GroupStateTimeout.NoTimeout)


def chained(settled: DataFrame) -> DataFrame:
    """New jobs that completed ones (kind, document_id, ask_run_id, sampled) ask for: an index job after an extraction, a
    grading job after a sampled answer."""
    kind = F.when(F.col("kind") == "extract", "index").when((F.col("kind") == "answer") & F.col("sampled"), "judge")
    return settled.withColumn("kind", kind).where("kind IS NOT NULL").select("kind", "document_id", "ask_run_id", F.lit("pending").alias("state"), F.lit(0).alias("attempts"))


def sampled(key: Column, rate: float) -> Column:
    """A reproducible draw: whether the key's hash falls below the rate."""
    return F.pmod(F.xxhash64(key), F.lit(1_000_000)) < F.lit(int(rate * 1_000_000))
