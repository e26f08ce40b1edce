"""Job records as an append-only ledger of status events.

Ledger rows are ``(job_id, project_id, status, progress, error, ts)``. Folding uses aggregates that
combine before the shuffle, so a job with very many events costs one row per task.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINISHED = ("completed", "failed")


def latest(ledger: DataFrame, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Current record per job, with the times it was created, last changed, completed and failed."""
    newest = F.max_by(
        F.struct("project_id", "status", *[c for c in ("progress", "error") if c in ledger.columns]),
        F.struct(*order),
    )
    return ledger.groupBy("job_id").agg(
        newest.alias("_r"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
        F.max(F.when(F.col("status") == "completed", F.col("ts"))).alias("completed_at"),
        F.max(F.when(F.col("status") == "failed", F.col("ts"))).alias("failed_at"),
    ).select("job_id", "_r.*", "created_at", "updated_at", "completed_at", "failed_at")


def by_project(jobs: DataFrame, project_id: str | None = None) -> DataFrame:
    """All jobs, or those of one project."""
    return jobs if project_id is None else jobs.where(F.col("project_id") == project_id)


def _age_over(as_of: datetime | Column, seconds: float) -> Column:
    as_of = as_of if isinstance(as_of, Column) else F.lit(as_of)
    age = as_of.cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
    return F.col("created_at").cast("timestamp") < age


def unexpired(jobs: DataFrame, as_of: datetime | Column, ttl_seconds: float) -> DataFrame:
    """Jobs not older than the time to live; one exactly that old stays."""
    return jobs.where(~_age_over(as_of, ttl_seconds))


def apply_timeout(jobs: DataFrame, as_of: datetime | Column, timeout_seconds: float) -> DataFrame:
    """Turn jobs pending for longer than the timeout into failed ones."""
    late = (F.col("status") == "pending") & _age_over(as_of, timeout_seconds)
    as_of = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return jobs.withColumns({
        "failed_at": F.when(late, as_of.cast(jobs.schema["failed_at"].dataType)).otherwise(F.col("failed_at")),
        "error": F.when(late, "pending timeout").otherwise(
            F.col("error") if "error" in jobs.columns else F.lit(None).cast("string")),
        "status": F.when(late, "failed").otherwise(F.col("status")),
    })


def purge(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs to keep and finished jobs to hand out once and drop."""
    done = F.col("status").isin(*FINISHED)
    return jobs.where(~done), jobs.where(done)
