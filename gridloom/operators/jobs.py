"""Analytics over a job log: ``id, batch_id, batch_order, status, app_generation, …``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.ordered import previous_value, running_number
from gridloom.session import per_key

# States of a job.
READY, AWAITING, PENDING = "ready_for_genesis", "awaiting_genesis", "pending_genesis"
KNOWN_STATUSES = (READY, AWAITING, PENDING, "running", "completed", "failed")
RETRYABLE = ("failed", AWAITING, READY, PENDING, "genesis_running")
READY_STAGE = 7
STUCK_SECONDS = 300


def batch_order(jobs: DataFrame, batch: str, order: list[Column]) -> DataFrame:
    """Number the jobs of each batch from 0 and give the size of the batch."""
    sizes = per_key(jobs.groupBy(batch).agg(F.count("*").alias("batch_total")))
    return running_number(jobs, [batch], order, "batch_order", start=0).join(sizes, batch)


def batch_ready(jobs: DataFrame, batch: str) -> DataFrame:
    """A batch is ready when it has app jobs and all of them are ready."""
    app = F.col("app_generation")
    return jobs.groupBy(batch).agg(
        F.count_if(app).alias("app_jobs"), F.coalesce(F.bool_and(F.when(app, F.col("status") == READY)), F.lit(False)).alias("ready")
    )


def status_counts(jobs: DataFrame, batch: str) -> DataFrame:
    """App jobs per status and batch, with a diagnosis of the batch."""
    app = F.col("app_generation")
    status = F.col("status")
    counts = [F.count_if(app & (status == s)).alias(s) for s in KNOWN_STATUSES]
    wide = jobs.groupBy(batch).agg(
        F.count_if(app).alias("app_jobs"), *counts, F.count_if(app & ~status.isin(*KNOWN_STATUSES)).alias("other")
    )
    n = F.col("app_jobs")
    diagnosis = (
        F.when(F.col("completed") == n, "all completed")
        .when(F.col("failed") > 0, "blocked by failures")
        .when(F.col("running") > 0, "processing")
        .when(F.col(PENDING) > 0, "pending trigger")
        .when(F.col(AWAITING) == n, "ready to start")
        .when(F.col(AWAITING) > 0, "partly promoted")
        .when(F.col(READY) == n, "ready but not promoted")
        .otherwise("in progress")
    )
    return wide.withColumn("diagnosis", diagnosis)


def promotion_status(jobs: DataFrame) -> DataFrame:
    app, status = F.col("app_generation"), F.col("status")
    return jobs.withColumn(
        "promotion_status",
        F.when(app & (status == READY), "Will promote").when(app, F.concat(F.lit("Blocking: "), status)).otherwise("Not app generation"),
    )


def blocked_by_previous(jobs: DataFrame, batch: str, order: str) -> DataFrame:
    """May a job run? Only when all earlier jobs of its batch completed; it fails when one failed.

    The first unfinished and the first failed position of a batch decide this for all its jobs, so
    one small aggregate replaces a window over the batch.
    """
    status = F.col("status")
    firsts = per_key(
        jobs.groupBy(batch).agg(
            F.min(F.when(status != "completed", F.col(order))).alias("_open"),
            F.min(F.when(status == "failed", F.col(order))).alias("_failed"),
        )
    )
    at = F.col(order)
    state = F.when(at > F.col("_failed"), "failed").when(at > F.col("_open"), "waiting").otherwise("may run")
    return jobs.join(firsts, batch).withColumn("decision", state).drop("_open", "_failed")


def previous_state_gap(log: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Microseconds since the entry before, per key; NULL on the first entry."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    numbered = log.withColumn("_at", micros)
    found = previous_value(numbered, [key], [F.col("_at"), F.col(tie)], F.col("_at"), "_before")
    return found.withColumn("gap_micros", F.col("_at") - F.col("_before")).drop("_at", "_before")


def eligible_for_retry(jobs: DataFrame, batch: str) -> DataFrame:
    """A batch may be retried when every app job got far enough and is in a state that allows it."""
    app, status = F.col("app_generation"), F.col("status")
    far = (
        status.isin(AWAITING, READY) | F.coalesce(F.array_contains("completed_stages", READY_STAGE), F.lit(False))
        | F.coalesce(F.col("current_stage") == READY_STAGE, F.lit(False))
    )
    good = far & status.isin(*RETRYABLE)
    return jobs.groupBy(batch).agg(F.coalesce(F.bool_and(F.when(app, good)), F.lit(False)).alias("eligible"))


def stuck_jobs(jobs: DataFrame, updated: str, as_of: Column) -> DataFrame:
    """Running jobs without an update for more than five minutes."""
    idle = F.unix_timestamp(as_of) - F.unix_timestamp(F.col(updated).cast("timestamp"))
    return jobs.withColumn("seconds_stuck", idle).filter((F.col("status") == "running") & (idle > STUCK_SECONDS))
