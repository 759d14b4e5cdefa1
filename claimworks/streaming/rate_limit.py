"""Fixed windows anchored at a key's first request: batch and streaming.

A request opens a window if none is open at its time (now >= reset); within a window a request is
accepted while fewer than its action's limit have come. Rejected requests don't count and don't
extend it. Actions draw on budgets: those of one budget share a client's window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from claimworks.functions import lexicon as L

SCHEMA = "event_id long, user_id long, ts timestamp, ok boolean, retry_after int"
BY_ACTION = "event_id long, user_id long, action string, ts timestamp, ok boolean, retry_after int"


class Window:
    """An open window: when it ends (microseconds) and how many requests it has accepted."""

    def __init__(self, reset: int = 0, count: int = 0):
        self.reset, self.count = reset, count

    def take(self, at: int, limit: int, window_us: int) -> tuple[bool, int | None]:
        """Whether a request at that time is accepted, and the seconds to wait if it isn't."""
        if at >= self.reset:
            self.reset, self.count = at + window_us, 0
        if self.count < limit:
            self.count += 1
            return True, None
        return False, -(-(self.reset - at) // 1_000_000)


def _micros(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64")


def limited(requests: DataFrame, limit: int, window_s: int = 60) -> DataFrame:
    """requests(event_id, user_id, ts) -> its columns, ok, retry_after (seconds, null if accepted).
    Rows are dealt by user and sorted within a partition, and one pass carries a window's state, so
    a user's requests needn't fit in memory. Null users and times are left out."""
    rows = requests.select("event_id", "user_id", F.lit("").alias("budget"), F.lit(limit).alias("most"), "ts")
    return _limited(rows, window_s).select("event_id", "user_id", "ts", "ok", "retry_after")


def by_action(requests: DataFrame, actions: dict[str, tuple[str, int]] | None = None, window_s: int = 60) -> DataFrame:
    """requests(event_id, user_id, action, ts) -> its columns, ok, retry_after, with the budget and the
    limit of each action. Requests of other actions, and with null users or times, are left out."""
    return _limited(_budgets(requests, actions), window_s).join(F.broadcast(_names(requests, actions)), ["budget", "a"]).select("event_id", "user_id", "action", "ts", "ok", "retry_after")


def _names(requests: DataFrame, actions) -> DataFrame:
    """The actions, a few, with a number for each."""
    rows = [(b, i, a, n) for i, (a, (b, n)) in enumerate((actions or L.BUDGETS).items())]
    return requests.sparkSession.createDataFrame(rows, "budget string, a int, action string, most int")


def _budgets(requests: DataFrame, actions) -> DataFrame:
    return requests.select("event_id", "user_id", "action", "ts").join(F.broadcast(_names(requests, actions)), "action").drop("action")


def _limited(rows: DataFrame, window_s: int) -> DataFrame:
    extra = ["a"] if "a" in rows.columns else []
    rows = rows.select("event_id", "user_id", "budget", *extra, "most", "ts").filter("user_id is not null and ts is not null")
    rows = rows.repartition("user_id", "budget").sortWithinPartitions("user_id", "budget", "ts", "event_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, window = None, Window()
        for f in frames:
            out = []
            for user, budget, most, at in zip(f["user_id"], f["budget"], f["most"], _micros(f["ts"]), strict=True):
                if (user, budget) != key:
                    key, window = (user, budget), Window()
                out.append(window.take(at, most, window_s * 1_000_000))
            yield f.drop(columns="most").assign(ok=[o for o, _ in out], retry_after=pd.array([r for _, r in out], dtype="Int32"))

    columns = "".join(f"{c} int, " for c in extra)
    return rows.mapInPandas(run, f"event_id long, user_id long, budget string, {columns}ts timestamp, ok boolean, retry_after int")


class Limiter(StatefulProcessor):
    """One client's requests of one budget. Requests wait until the watermark has passed them, so they
    are judged in order of time however micro-batches mix them; an event-time timer wakes the key up
    for the earliest one that waits. State ends with its window."""

    def __init__(self, window_s: int):
        self.window_us = window_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "reset long, count long")
        self.waiting = handle.getListState("waiting", "at long, event_id long, action string, most int")

    def _wake(self, ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [x for f in rows for x in zip(_micros(f["ts"]).tolist(), f["event_id"].tolist(), f["action"].tolist(), f["most"].tolist(), strict=True)]
        self.waiting.appendList(new)
        first = min(x[0] for x in new) // 1000 + 1
        timers = list(self.handle.listTimers())
        if not timers or first < min(timers):
            self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        due, later = [x for x in waiting if x[0] < passed], [x for x in waiting if x[0] >= passed]
        window = Window(*self.window.get()) if self.window.exists() else Window()
        out = [(event, key[0], action, pd.Timestamp(at, unit="us"), *window.take(at, most, self.window_us)) for at, event, action, most in due]
        if later:
            self.waiting.put(later)
            self._wake(later[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        if window.reset > passed:
            self.window.update((window.reset, window.count))
            if not later:
                self._wake(window.reset // 1000 + 1)
        else:
            self.window.clear()
        if out:
            f = pd.DataFrame(out, columns=["event_id", "user_id", "action", "ts", "ok", "retry_after"])
            yield f.assign(retry_after=f["retry_after"].astype("Int32"))

    def close(self) -> None:
        pass


def limited_stream(requests: DataFrame, delay: str, actions: dict[str, tuple[str, int]] | None = None, window_s: int = 60) -> DataFrame:
    """by_action over a stream of requests(event_id, user_id, action, ts). A request is judged once the
    watermark, `delay` behind the latest time, has passed it; later ones are dropped by Spark. The
    session's state store must be RocksDB (spark.sql.streaming.stateStore.providerClass)."""
    rows = _keyed(requests, delay, actions)
    return rows.groupBy("user_id", "budget").transformWithStateInPandas(statefulProcessor=Limiter(window_s), outputStructType=BY_ACTION, outputMode="Append", timeMode="EventTime")


def _keyed(requests: DataFrame, delay: str, actions) -> DataFrame:
    """Requests with a watermark, and the budget and limit of their action."""
    rows = requests.select("event_id", "user_id", "action", "ts").filter("user_id is not null and ts is not null").withWatermark("ts", delay)
    return rows.join(F.broadcast(_names(requests, actions).drop("a")), "action").select("event_id", "user_id", "budget", "action", "most", "ts")
