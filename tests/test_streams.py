"""Streams over several arrivals: late, repeated and out-of-order rows, timers, expiry, restarts."""

import datetime as dt
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from gridloom.session import scratch_path
from gridloom.streaming import job_streams as T
from gridloom.streaming import keyed_state as K

START = dt.datetime(2024, 1, 1, 10)


class Arrivals:
    """A folder into which files of events arrive one after the other, a second apart by their times."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.count = spark, folder, 0
        folder.mkdir()

    def add(self, rows):
        """``rows``: event_id, minute, user_id, event_type."""
        import pyarrow as pa
        import pyarrow.parquet as pq

        at = [None if m is None else START + dt.timedelta(minutes=m) for _, m, _, _ in rows]
        table = pa.table({
            "event_id": pa.array([r[0] for r in rows], pa.int64()), "ts": pa.array(at, pa.timestamp("us")),
            "user_id": pa.array([r[2] for r in rows], pa.int64()), "event_type": pa.array([r[3] for r in rows], pa.string()),
            "value": pa.array([0.0] * len(rows)), "props": pa.array([""] * len(rows)),
        })
        path = self.folder / f"{self.count}.parquet"
        pq.write_table(table, path)
        self.count += 1
        os.utime(path, (1_700_000_000 + self.count, 1_700_000_000 + self.count))

    def stream(self):
        raw = self.spark.readStream.schema(T.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet")
        return raw.parquet(str(self.folder)).withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.fixture
def arrivals(spark, tmp_path):
    return Arrivals(spark, tmp_path / "in")


def test_duplicates_are_skipped(arrivals):
    arrivals.add([(1, 0, 7, "view"), (2, 1, 7, "view"), (3, 0, 8, "view"), (4, 2, 8, "purchase")])
    arrivals.add([(5, 90, 9, "view"), (1, 0, 7, "view")])
    arrivals.add([(6, 1, 7, "click"), (7, 200, 9, "view")])
    assert T.run_to_table(T.dedupe_stream(arrivals.stream(), ["event_id"], "1 day")).count() == 7


def test_sessions_drop_late_rows(arrivals):
    arrivals.add([(1, 0, 7, "view"), (2, 1, 7, "view")])
    arrivals.add([(3, 90, 9, "view")])
    # What is late is told by the watermark that the batch before began with.
    arrivals.add([(6, 91, 9, "view")])
    arrivals.add([(4, 1, 7, "click"), (5, 200, 9, "view")])
    closed, late = T.run_counting_late(T.sessions_stream(arrivals.stream(), "user_id", "5 minutes"))
    assert sorted((r["user_id"], r["n"]) for r in closed.collect()) == [(7, 2), (9, 2)] and late >= 1


def states(df):
    return {r["user_id"]: r["state"] for r in df.collect()}


def newest(arrivals, checkpoint, ttl):
    told = K.latest_state(arrivals.stream(), "user_id", ["ts", "event_id"], "event_type", ttl)
    return states(T.latest_per_key(told, ["user_id"], checkpoint, by_clock=ttl is not None))


def test_latest_state_survives_restarts_and_disorder(spark, arrivals):
    """The second run goes on from the first one's state; compaction changes nothing."""
    checkpoint = scratch_path(spark, "latest")
    arrivals.add([(1, 5, 7, "view"), (2, 1, 7, "old"), (3, 0, 8, "view"), (4, 0, 8, "same instant"), (5, 1, None, "nobody"), (6, None, 7, "never")])
    arrivals.add([(7, 4, 7, "late"), (8, 9, 8, "new")])
    before, T.COMPACT = T.COMPACT, 1
    try:
        assert newest(arrivals, checkpoint, None) == {7: "view", 8: "new"}
    finally:
        T.COMPACT = before
    arrivals.add([(9, 3, 7, "later still"), (10, 9, 8, "greater id"), (11, 0, 9, "first")])
    # Job 7 was not renewed by an older update, so the second run does not tell it.
    assert newest(arrivals, checkpoint, None) == {8: "greater id", 9: "first"}


def test_latest_state_expires(spark, arrivals):
    checkpoint = scratch_path(spark, "expiring")
    arrivals.add([(1, 50, 7, "newest"), (2, 50, 8, "newest")])
    assert newest(arrivals, checkpoint, "8 seconds") == {7: "newest", 8: "newest"}
    time.sleep(9)
    arrivals.add([(3, 10, 7, "older, but all that is known")])
    assert newest(arrivals, checkpoint, "8 seconds") == {7: "older, but all that is known"}
    held = spark.read.format("statestore").option("stateVarName", "newest").load(checkpoint)
    assert [r["key"]["job"] for r in held.collect()] == [7]


def brute_stuck(rows, gap, until):
    """Updates that none of the same job follows within the gap, running, and over by ``until``."""
    out = set()
    for i, m, user, status in rows:
        followed = any(u == user and (m, i) < (n, j) and n <= m + gap for j, n, u, _ in rows)
        if not followed and status in ("view", "click") and m + gap <= until:
            out.add((user, START + dt.timedelta(minutes=m)))
    return out


def stuck(df):
    return {(r["user_id"], r["last_update"]) for r in df.collect()}


def test_stuck_jobs_timers(spark, arrivals):
    """A timer reports, an update sets it anew, a finished job clears it; the second run still holds the timers."""
    checkpoint = scratch_path(spark, "stuck")
    arrivals.add([(1, 0, 7, "view"), (2, 0, 8, "view"), (3, 3, 8, "purchase"), (4, 0, 9, "click"), (5, 0, 10, "view")])
    # Job 9 goes on; job 10's update comes late and in front of a later one.
    arrivals.add([(6, 4, 9, "click"), (7, 9, 10, "view"), (8, 4.5, 10, "click")])
    seen, _ = T.run_counting_late(K.stuck_jobs(arrivals.stream(), "user_id", ("view", "click")), checkpoint)
    assert stuck(seen) == set()
    arrivals.add([(9, 19.5, 11, "view")])
    seen, _ = T.run_counting_late(K.stuck_jobs(arrivals.stream(), "user_id", ("view", "click")), checkpoint)
    at = lambda m: START + dt.timedelta(minutes=m)
    # The watermark stands at 9:30 past: only the updates of minutes 0 and 4 are over.
    assert stuck(seen) == {(7, at(0)), (9, at(4))}
    arrivals.add([(10, 100, 12, "view"), (11, 12, 10, "view")])
    arrivals.add([(12, 1, 7, "view")])
    seen, late = T.run_counting_late(K.stuck_jobs(arrivals.stream(), "user_id", ("view", "click")), checkpoint)
    assert stuck(seen) == {(10, at(12)), (11, at(19.5))} and late == 1


def test_stuck_jobs_against_brute_force(arrivals):
    rng = random.Random(6)
    rows = [(i, i * 0.37 + rng.choice([0, 0, -2, 3, 4]), rng.choice([1, 1, 1, 2, 3, 4, 5]) if i % 3 else 1, rng.choice(["view", "click", "purchase"])) for i in range(1, 600)]
    for begin in range(0, len(rows), 200):
        part = rows[begin : begin + 200]
        rng.shuffle(part)
        arrivals.add(part)
    end = max(m for _, m, _, _ in rows)
    found = stuck(T.run_to_table(K.stuck_jobs(arrivals.stream(), "user_id", ("view", "click"))))
    assert found == brute_stuck(rows, 5, end - 10) and found


class CountingHandle:
    """A store of one key that counts what it is asked."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, name, schema, ttl=None):
        return self

    def _called(self):
        self.calls += 1

    def get(self):
        self._called()
        return self.value

    def update(self, value):
        self._called()
        self.value = value

    def clear(self):
        self._called()
        self.value = None

    def registerTimer(self, at):
        self._called()
        self.timers.add(at)

    def deleteTimer(self, at):
        self._called()
        self.timers.remove(at)


def test_stuck_jobs_ask_the_store_little():
    """Three calls for a new job, however many bursts it has; the timer stands at the end of its first burst."""
    handle, minute = CountingHandle(), 60_000_000
    processor = K._Stuck(5 * 60_000, ("view",))
    processor.init(handle)
    row = lambda m, i: (7, m * minute, m * minute, i, "view", None)
    assert list(processor.handleInputRows((7,), iter([row(m, m) for m in range(10, 2000, 10)]), None)) == []
    assert handle.calls <= 3 and handle.timers == {15 * 60_000}
    # A late update in front moves the timer.
    list(processor.handleInputRows((7,), iter([row(2, 1)]), None))
    assert handle.calls <= 7 and handle.timers == {7 * 60_000}
    handle.timers.clear()
    clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self: 25 * 60_000})()
    told = list(processor.handleExpiredTimer((7,), clock, None))
    assert [r["micros"] // minute for r in told] == [2, 10, 20] and handle.timers == {35 * 60_000}
