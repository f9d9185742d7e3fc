"""Keyed state and timers over job events: the last state of each key, and jobs that stopped reporting.

Both run on ``transformWithState`` (with pandas for the last state) and the RocksDB state store. Before the shuffle each Arrow batch is
cut down to the rows that can still matter, so that a key with a third of all rows sends a few per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


class _Newest(StatefulProcessor):
    """Holds the newest ``(order …, value)`` of a key and tells it when it changes."""

    def __init__(self, width: int, ttl_ms: int | None):
        self.width, self.ttl_ms = width, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        spots = ", ".join(f"o{i} long" for i in range(self.width))
        self.held = handle.getValueState("newest", f"{spots}, state string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [f"o{i}" for i in range(self.width)]
        known = self.held.get() if self.held.exists() else None
        best = None if known is None else tuple(known)
        for frame in rows:
            for row in frame[[*names, "state"]].itertuples(index=False, name=None):
                row = (*map(int, row[:-1]), row[-1])
                if best is None or row[:-1] > best[:-1]:
                    best = row
        # Also when nothing is newer the value is written: an update keeps a key alive.
        self.held.update(best)
        if best != known:
            yield pd.DataFrame([(key[0], *best)], columns=["job", *names, "state"])

    def close(self) -> None:
        pass


def _newest_per_batch(width: int):
    names = [f"o{i}" for i in range(width)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.sort_values(names, kind="stable").drop_duplicates("job", keep="last")

    return run


def latest_state(
    events: DataFrame, key: str, order: list[str], value: str, ttl: str | None = None
) -> DataFrame:
    """A stream of ``key, state, updated_at``: one row whenever a key's newest value changes.

    ``order`` names the columns that decide, an event time first and numbers after it; rows that come late or out
    of order never replace a newer one. A key that gets no update for ``ttl`` (processing time, such as
    ``30 days``) is forgotten, so that state grows with the live keys only; what comes later starts it anew.
    Rows without a time or without a key have no place in the order and are left out.
    """
    spark = events.sparkSession
    spark.conf.set(STATE_STORE, ROCKSDB)
    spots = [F.unix_micros(order[0]), *[F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 63))) for c in order[1:]]]
    width, kind = len(order), events.schema[key].dataType.simpleString()
    slim = events.filter(F.col(order[0]).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("job"), *[s.alias(f"o{i}") for i, s in enumerate(spots)], F.col(value).cast("string").alias("state")
    )
    schema = f"job {kind}, " + ", ".join(f"o{i} long" for i in range(width)) + ", state string"
    fewer = slim.mapInPandas(_newest_per_batch(width), schema)
    ttl_ms = None if ttl is None else int(pd.Timedelta(ttl).total_seconds() * 1000)
    out = fewer.groupBy("job").transformWithStateInPandas(
        _Newest(width, ttl_ms), schema, "Update", "None" if ttl_ms is None else "ProcessingTime"
    )
    return out.select(F.col("job").alias(key), "state", F.timestamp_micros("o0").alias("updated_at"))


def _bursts(rows: list[tuple], gap: int) -> list[tuple]:
    """Join what lies within ``gap`` of one another: ``(start, end, id, status)`` with the last update's id and status."""
    out: list[tuple] = []
    for start, end, number, status in sorted(rows, key=lambda r: r[:3]):
        if out and start <= out[-1][1] + gap:
            last = max(out[-1][1:], (end, number, status), key=lambda u: u[:2])
            out[-1] = (out[-1][0], *last)
        else:
            out.append((start, end, number, status))
    return out


class _Stuck(StatefulProcessor):
    """A timer per job: set by its last update, set anew by the next, and reporting when it fires.

    State holds bursts of updates, more than the gap apart, so its size does not grow with the rate of updates. A
    late update joins the bursts around it. A finished job's burst stays until its timer fires, so that late updates
    still find it, and reports nothing.
    """

    def __init__(self, gap_ms: int, running: tuple[str, ...]):
        self.gap, self.running = gap_ms * 1000, running

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value holds all bursts of a job, so a key costs few calls to the store.
        self.held = handle.getValueState("bursts", "start array<long>, micros array<long>, id array<long>, status array<string>")

    def _due(self, bursts: list[tuple]) -> int | None:
        """When the timer of a job with these bursts goes off; it follows from them, so it need not be asked for."""
        return -(-(bursts[0][1] + self.gap) // 1000) if bursts else None

    def _known(self) -> list[tuple]:
        held = self.held.get()
        return [] if held is None else list(zip(*held))

    def _hold(self, bursts: list[tuple]) -> None:
        if bursts:
            self.held.update(tuple(map(list, zip(*bursts))))
        else:
            self.held.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self._known()
        bursts = _bursts([*known, *((r[1], r[2], r[3], r[4]) for r in rows)], self.gap)
        self._hold(bursts)
        armed, due = self._due(known), self._due(bursts)
        if armed != due:
            if armed is not None:
                self.handle.deleteTimer(armed)
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        bursts = self._known()
        left = [b for b in bursts if b[1] + self.gap > now]
        self._hold(left)
        # Spark deletes the timer that went off.
        if left:
            self.handle.registerTimer(self._due(left))
        return iter([Row(job=key[0], micros=b[1]) for b in bursts if b[1] + self.gap <= now and b[3] in self.running])

    def close(self) -> None:
        pass


def _bursts_per_batch(gap: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame = frame.sort_values(["job", "micros", "id"], kind="stable")
            opens = (frame["job"] != frame["job"].shift()) | (frame["micros"] > frame["micros"].shift() + gap)
            ends = opens.shift(-1, fill_value=True)
            starts = frame["micros"][opens].to_numpy()
            yield frame[ends].assign(start=starts)[["job", "start", "micros", "id", "status"]]

    return run


def stuck_jobs(
    events: DataFrame, key: str, running: tuple[str, ...], gap: str = "5 minutes", delay: str = "10 minutes",
    ts: str = "ts", id: str = "event_id", status: str = "event_type",
) -> DataFrame:
    """A stream of ``key, last_update, stuck_since``: jobs whose last status is a running one, ``gap`` after it.

    The event-time timer fires when the watermark, ``delay`` behind the newest event, has passed the gap. Of
    updates of one instant the greater ``id`` is the last. Rows behind the watermark are dropped.
    """
    spark = events.sparkSession
    spark.conf.set(STATE_STORE, ROCKSDB)
    gap_ms = int(pd.Timedelta(gap).total_seconds() * 1000)
    kind = events.schema[key].dataType.simpleString()
    slim = events.filter(F.col(ts).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("job"), F.unix_micros(ts).alias("micros"), F.coalesce(F.col(id).cast("long"), F.lit(-(1 << 63))).alias("id"),
        F.col(status).alias("status"),
    )
    fewer = slim.mapInPandas(_bursts_per_batch(gap_ms * 1000), f"job {kind}, start long, micros long, id long, status string")
    # The time column is made here, because a column that went through Python is no longer known to carry the watermark.
    timed = fewer.withColumn("ts", F.timestamp_micros("micros")).withWatermark("ts", delay)
    out = timed.groupBy("job").transformWithState(
        _Stuck(gap_ms, running), f"job {kind}, micros long", "Append", "EventTime"
    )
    last = F.timestamp_micros("micros")
    return out.select(F.col("job").alias(key), last.alias("last_update"), F.timestamp_micros(F.col("micros") + gap_ms * 1000).alias("stuck_since"))
