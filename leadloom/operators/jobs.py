"""Run ledger: the state of jobs, read from an append-only event log.

Events are ``(job_id, ts, event_id, status)``; the last event by ``(ts,
event_id)`` says what state a job is in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadloom.schema import RETENTION_HOURS

#: Progress shown for each status; a failed job stays where it was started.
PROGRESS = {"queued": 0.0, "processing": 0.1, "completed": 1.0, "failed": 0.1}
FINISHED = ("completed", "failed")


def _progress(status: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in PROGRESS.items() for x in pair))[status]


def state_aggregates() -> list[Column]:
    """Aggregates that give a job's state; usable in batch and in a stream."""
    latest = F.struct("ts", "event_id")
    return [
        F.max_by("status", latest).alias("status"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
        F.max_by(F.when(F.col("status") == "failed", F.col("error")), latest).alias("error"),
    ]


def with_progress(state: DataFrame) -> DataFrame:
    return state.select(
        "job_id",
        "status",
        _progress(F.col("status")).alias("progress"),
        "created_at",
        "updated_at",
        (F.col("status") == "completed").alias("has_result"),
        "error",
    )


def job_state(events: DataFrame) -> DataFrame:
    """Current state of every job; map tasks combine before the shuffle."""
    return with_progress(events.groupBy("job_id").agg(*state_aggregates()))


def job_lookup(events: DataFrame, job_id) -> DataFrame:
    """State of one job, no row if it is unknown; the filter reaches the scan."""
    return job_state(events.where(F.col("job_id") == job_id))


def job_list(events: DataFrame) -> DataFrame:
    return job_state(events).select(
        "job_id", "status", "created_at", "updated_at", "progress", "has_result", "error"
    )


def job_totals(events: DataFrame) -> DataFrame:
    return job_state(events).groupBy("status").agg(F.count("*").alias("jobs"))


def job_retention(events: DataFrame, as_of: Column, hours: int = RETENTION_HOURS) -> DataFrame:
    """Jobs still kept: finished ones go when untouched for ``hours``."""
    old = F.col("updated_at") < as_of - F.make_dt_interval(hours=F.lit(hours))
    return job_state(events).where(~(F.col("status").isin(*FINISHED) & old))


def job_notices(events: DataFrame, correlation_id: Column | None = None) -> DataFrame:
    """``(job_id, notice)``: the JSON message due for every finished job."""
    correlation = correlation_id if correlation_id is not None else F.col("job_id").cast("string")
    result = F.when(F.col("has_result"), F.struct(F.lit("ok").alias("status")))
    return (
        job_state(events)
        .where(F.col("status").isin(*FINISHED))
        .select(
            "job_id",
            F.to_json(
                F.struct(
                    F.col("job_id").cast("string").alias("job_id"),
                    "status",
                    correlation.alias("correlation_id"),
                    result.alias("result"),
                    "error",
                ),
                {"ignoreNullFields": "false"},
            ).alias("notice"),
        )
    )
