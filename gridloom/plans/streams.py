"""Streams over the events and over arriving files; the SQL is the batch twin of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.plans.registry import query
from gridloom.plans.sources import mixed_files
from gridloom.session import scratch_path
from gridloom.streaming import job_streams as T
from gridloom.streaming import keyed_state as K
from gridloom.streaming.arrivals import ArrivalTable


def _second(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


@query("arrivals_stream", "SELECT folder, route, files FROM (VALUES ('customers', 'tabular', 4), ('notes', 'narrative', 3), ('orders', 'rejected', 2)) t(folder, route, files)")
def _(load):
    arrived = T.run_to_table(T.arrivals_stream(load.spark, mixed_files(load)))
    return arrived.select(F.element_at(F.split("path", "/"), -2).alias("folder"), "route", "path").groupBy("folder", "route").agg(
        F.countDistinct("path").cast("int").alias("files")
    )


@query("arrivals_load", "SELECT o_orderkey, CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE o_totalprice::DECIMAL(19,4) END AS price, strftime(o_orderdate, '%Y-%m-%d') AS day, (o_custkey % 50 = 0)::INT AS unreadable FROM orders")
def _(load):
    # Every order arrives once in one of the files; the stream runs twice and another time without its checkpoint.
    inbox, checkpoint = scratch_path(load.spark, "inbox"), scratch_path(load.spark, "arrivals-checkpoint")
    price = F.when(F.col("o_custkey") % 50 == 0, "n/a").otherwise(F.col("o_totalprice").cast("decimal(12,2)").cast("string"))
    load("orders").select("o_orderkey", price.alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).repartition(4).write.option("header", True).csv(inbox)
    table = ArrivalTable(load.spark, scratch_path(load.spark, "arrived"), "o_orderkey bigint, price decimal(19,4), day date")
    for place in (checkpoint, checkpoint, scratch_path(load.spark, "other-checkpoint")):
        table.load(inbox, place, files_per_batch=2)
    return table.rows().select("o_orderkey", "price", F.date_format("day", "yyyy-MM-dd").alias("day"), "unreadable")


@query("dedupe_stream", "SELECT event_id, user_id, event_type FROM events")
def _(load):
    # Every event is delivered twice.
    events = T.event_stream(load.spark, load.root)
    twice = events.withColumn("delivery", F.explode(F.array(F.lit(1), F.lit(2))))
    return T.run_to_table(T.dedupe_stream(twice, ["event_id"])).select("event_id", "user_id", "event_type")


_WINDOW = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS start, strftime({0} + INTERVAL {1}, '%Y-%m-%d %H:%M:%S') AS stop"


@query(
    "progress_counts_stream",
    f"""SELECT 'tumbling' AS kind, {_WINDOW.format("date_trunc('hour', ts)", "1 HOUR")}, event_type, count(*) AS n FROM events GROUP BY ALL
        UNION ALL SELECT 'sliding', {_WINDOW.format("(date_trunc('day', ts) - INTERVAL (back) DAY)", "2 DAY")}, event_type, count(*) FROM events, (VALUES (0), (1)) s(back) GROUP BY ALL""",
)
def _(load):
    keys = ["start", "stop", "event_type"]
    events = lambda: T.event_stream(load.spark, load.root)
    tumbling = T.latest_per_key(T.progress_counts_stream(events(), "1 hour"), keys).withColumn("kind", F.lit("tumbling"))
    sliding = T.latest_per_key(T.progress_counts_stream(events(), "2 days", "1 day"), keys).withColumn("kind", F.lit("sliding"))
    return tumbling.unionByName(sliding).select("kind", _second("start"), _second("stop"), "event_type", "n")


def _sessions_sql(minutes: int) -> str:
    return f"""e AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL {minutes} MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM e),
        sess AS (SELECT user_id, s, min(ts) AS start, max(ts) AS last_update, arg_max(event_type, {{'ts': ts, 'id': event_id}}) AS last_status, max(ts) + INTERVAL {minutes} MINUTE AS stop, count(*) AS n FROM n GROUP BY 1, 2),
        closed AS (SELECT * FROM sess WHERE stop <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE)"""


@query("job_sessions_stream", f"WITH {_sessions_sql(30)} SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, strftime(stop, '%Y-%m-%d %H:%M:%S') AS stop, n, last_status FROM closed")
def _(load):
    sessions = T.run_to_table(T.sessions_stream(T.event_stream(load.spark, load.root), "user_id", "30 minutes"))
    return sessions.select("user_id", _second("start"), _second("stop"), "n", "last_status")


@query("stuck_jobs_stream", f"WITH {_sessions_sql(5)} SELECT user_id, strftime(last_update, '%Y-%m-%d %H:%M:%S') AS last_update, strftime(stop, '%Y-%m-%d %H:%M:%S') AS stuck_since FROM closed WHERE last_status IN ('view', 'click')")
def _(load):
    stuck = T.run_to_table(K.stuck_jobs(T.event_stream(load.spark, load.root), "user_id", ("view", "click")))
    return stuck.select("user_id", _second("last_update"), _second("stuck_since"))


@query("latest_state_stream", "SELECT user_id, arg_max(event_type, {'ts': ts, 'id': event_id}) AS state, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at FROM events GROUP BY 1")
def _(load):
    newest = K.latest_state(T.event_stream(load.spark, load.root), "user_id", ["ts", "event_id"], "event_type", ttl="30 days")
    return T.latest_per_key(newest, ["user_id"], by_clock=True).select("user_id", "state", _second("updated_at"))
