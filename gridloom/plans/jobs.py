"""Job-log analytics: every order is a job, every customer a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import jobs as J
from gridloom.plans.registry import query

_STATUS = {"1-URGENT": "failed", "2-HIGH": "ready_for_genesis", "3-MEDIUM": "completed", "4-NOT SPECIFIED": "running", "5-LOW": "awaiting_genesis"}


def _jobs(load) -> DataFrame:
    mapped = F.coalesce(*[F.when(F.col("o_orderpriority") == k, v) for k, v in _STATUS.items()], F.lit("paused"))
    stage = (F.col("o_orderkey") % 9).cast("int")
    return load("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("batch_id"), mapped.alias("status"),
        (F.col("o_orderstatus") != "F").alias("app_generation"), F.col("o_orderdate").alias("created_at"),
        stage.alias("current_stage"), F.when(stage > 0, F.sequence(F.lit(0), stage - 1)).alias("completed_stages"),
    )


_JOBS_SQL = """jobs AS (SELECT o_orderkey AS id, o_custkey AS batch_id, CASE o_orderpriority """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items()) + """ ELSE 'paused' END AS status,
  o_orderstatus <> 'F' AS app_generation, o_orderdate AS created_at, o_orderkey % 9 AS current_stage FROM orders),
  placed AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY created_at, id) - 1 AS batch_order, count(*) OVER (PARTITION BY batch_id) AS batch_total FROM jobs)"""


def _placed(load):
    return load.shared("placed_jobs", lambda: J.batch_order(_jobs(load), "batch_id", [F.col("created_at"), F.col("id")]))


@query("batch_order", f"WITH {_JOBS_SQL} SELECT id, batch_id, batch_order, batch_total FROM placed")
def _(load):
    return _placed(load).select("id", "batch_id", "batch_order", "batch_total")


@query("jobs_newest_first", f"WITH {_JOBS_SQL} SELECT id, status, strftime(created_at, '%Y-%m-%d') AS created FROM jobs ORDER BY created_at DESC, id")
def _(load):
    jobs = _jobs(load).orderBy(F.desc("created_at"), "id")
    return jobs.select("id", "status", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query(
    "batch_ready",
    f"WITH {_JOBS_SQL} SELECT batch_id, count(*) FILTER (app_generation) AS app_jobs, coalesce(bool_and(status = 'ready_for_genesis') FILTER (app_generation), false) AS ready FROM jobs GROUP BY 1",
)
def _(load):
    return J.batch_ready(_jobs(load), "batch_id")


_COUNTS = ", ".join(f"count(*) FILTER (app_generation AND status = '{s}') AS {s}" for s in J.KNOWN_STATUSES)


@query(
    "status_counts",
    f"""WITH {_JOBS_SQL}, c AS (SELECT batch_id, count(*) FILTER (app_generation) AS app_jobs, {_COUNTS},
          count(*) FILTER (app_generation AND status NOT IN {J.KNOWN_STATUSES}) AS other FROM jobs GROUP BY 1)
        SELECT *, CASE WHEN completed = app_jobs THEN 'all completed' WHEN failed > 0 THEN 'blocked by failures' WHEN running > 0 THEN 'processing'
          WHEN pending_genesis > 0 THEN 'pending trigger' WHEN awaiting_genesis = app_jobs THEN 'ready to start' WHEN awaiting_genesis > 0 THEN 'partly promoted'
          WHEN ready_for_genesis = app_jobs THEN 'ready but not promoted' ELSE 'in progress' END AS diagnosis FROM c""",
)
def _(load):
    return J.status_counts(_jobs(load), "batch_id")


@query(
    "promotion_status",
    f"WITH {_JOBS_SQL} SELECT id, CASE WHEN app_generation AND status = 'ready_for_genesis' THEN 'Will promote' WHEN app_generation THEN 'Blocking: ' || status ELSE 'Not app generation' END AS promotion_status FROM jobs",
)
def _(load):
    return J.promotion_status(_jobs(load)).select("id", "promotion_status")


@query(
    "blocked_by_previous",
    f"""WITH {_JOBS_SQL}, w AS (SELECT *, bool_or(status = 'failed') OVER b AS f, bool_and(status = 'completed') OVER b AS c FROM placed
          WINDOW b AS (PARTITION BY batch_id ORDER BY batch_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT id, CASE WHEN f THEN 'failed' WHEN NOT c THEN 'waiting' ELSE 'may run' END AS decision FROM w""",
)
def _(load):
    return J.blocked_by_previous(_placed(load), "batch_id", "batch_order").select("id", "decision")


@query(
    "previous_state_gap",
    "SELECT event_id, user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap_micros FROM events",
)
def _(load):
    log = load("events").select("event_id", "user_id", "ts")
    return J.previous_state_gap(log, "user_id", "ts", "event_id").select("event_id", "user_id", "gap_micros")


@query(
    "eligible_for_retry",
    f"""WITH {_JOBS_SQL} SELECT batch_id, coalesce(bool_and((status IN ('awaiting_genesis', 'ready_for_genesis') OR current_stage > 7 OR current_stage = 7)
          AND status IN {J.RETRYABLE}) FILTER (app_generation), false) AS eligible FROM jobs GROUP BY 1""",
)
def _(load):
    return J.eligible_for_retry(_jobs(load), "batch_id")


@query(
    "stuck_jobs",
    f"""WITH {_JOBS_SQL} SELECT id, epoch(TIMESTAMP '2000-06-01 12:00:00')::BIGINT - epoch(created_at)::BIGINT AS seconds_stuck FROM jobs
        WHERE status = 'running' AND epoch(TIMESTAMP '2000-06-01 12:00:00') - epoch(created_at) > 300""",
)
def _(load):
    return J.stuck_jobs(_jobs(load), "created_at", F.lit("2000-06-01 12:00:00").cast("timestamp")).select("id", "seconds_stuck")
