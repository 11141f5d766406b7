"""Control of a running ingest from streams of resource samples: state and timers of each machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Decisions with which work goes on, and those that halve a batch.
SAFE, LESS = ("CONTINUE", "THROTTLE", "REDUCE"), ("THROTTLE", "REDUCE")
LEAST_BATCH = 5


def _stateful(rows: DataFrame, by: str, processor: StatefulProcessor, schema: str, timers: bool) -> DataFrame:
    """Run a processor for each key. State with timers needs the RocksDB store, which is set for the session."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows.groupBy(by).transformWithStateInPandas(processor, schema, "Append", "EventTime" if timers else "None")


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The rows of a key by time; without rows, as where only timers end, a table without columns."""
    parts = list(batches)
    return pd.concat(parts).sort_values("ts", kind="stable") if parts else pd.DataFrame()


def _ms(ts: pd.Timestamp) -> int:
    return int(ts.value // 1_000_000)


class _Latch(StatefulProcessor):
    """The batch size of a machine: halved by each decision for less, never raised again."""

    def __init__(self, start: int):
        self.start = start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.size = handle.getValueState("size", "size int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        decided = _in_order(rows)
        if decided.empty:
            return
        size, sizes = self.size.get()[0] if self.size.exists() else self.start, []
        for action in decided["action"]:
            size = max(LEAST_BATCH, size // 2) if action in LESS else size
            sizes.append(size)
        self.size.update((size,))
        yield pd.DataFrame({"machine": key[0], "ts": decided["ts"].to_numpy(), "action": decided["action"].to_numpy(), "batch": sizes})

    def close(self) -> None:
        pass


def latched_batches(decided: DataFrame, start: int = 30) -> DataFrame:
    """``machine, ts, action, batch``: the batch size after each decision (``machine, ts, action``), which halves down to
    ``LEAST_BATCH`` and stays there for as long as the stream's checkpoint lives."""
    return _stateful(decided, "machine", _Latch(start), "machine long, ts timestamp, action string, batch int", False)


class _Sampler(StatefulProcessor):
    """The last reading of a machine, told when its timer ends; the timer is then set again."""

    def __init__(self, every: int):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts long, value double")
        self.due = handle.getValueState("due", "due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        read = _in_order(rows)
        if read.empty:
            return
        last = self.last.get() if self.last.exists() else None
        due = self.due.get()[0] if self.due.exists() else None
        told = []
        for ts, value in zip(read["ts"], read["value"]):
            at = _ms(ts)
            if due is None:
                due = at + self.every
                self.handle.registerTimer(due)
            if at >= due:  # readings of one batch may pass several ends
                told.append((due, *last))
                self.handle.deleteTimer(due)
                due += (at - due) // self.every * self.every + self.every
                self.handle.registerTimer(due)
            if last is None or at >= last[0]:
                last = (at, None if pd.isna(value) else float(value))
        self.last.update(last)
        self.due.update((due,))
        yield self._rows(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        told = [(due, *self.last.get())]
        self.due.clear()  # the next reading sets the timer again: a machine that is silent is not told twice
        yield self._rows(key, told)

    @staticmethod
    def _rows(key, told) -> pd.DataFrame:
        ends, times, values = zip(*told) if told else ((), (), ())
        stamp = lambda ms: pd.to_datetime(pd.Series(ms, dtype="int64"), unit="ms")
        return pd.DataFrame({"machine": pd.Series([key[0]] * len(told), dtype="int64"), "due": stamp(list(ends)), "ts": stamp(list(times)), "value": pd.Series(list(values), dtype="float64")})

    def close(self) -> None:
        pass


def sampled(readings: DataFrame, every_ms: int, late: str = "0 seconds") -> DataFrame:
    """``machine, due, ts, value``: of the readings (``machine, ts, value``) of each machine the last one before each end of
    an interval. The first reading begins the intervals; after an interval without readings the next one begins them anew."""
    return _stateful(readings.select("machine", "ts", "value").withWatermark("ts", late), "machine", _Sampler(every_ms), "machine long, due timestamp, ts timestamp, value double", True)


class _Gate(StatefulProcessor):
    """Closed by a pause; opened by the next decision that is not one, or by a timer."""

    def __init__(self, timeout: int):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.closed = handle.getValueState("closed", "since long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        decided = _in_order(rows)
        if decided.empty:
            return
        since, told = self.closed.get()[0] if self.closed.exists() else None, []
        for ts, action in zip(decided["ts"], decided["action"]):
            at = _ms(ts)
            if since is not None and at >= since + self.timeout:  # the end of the wait lies before this decision
                told.append((since, since + self.timeout, "PAUSE", "timeout"))
                self.handle.deleteTimer(since + self.timeout)
                since = None
            if since is None and action == "PAUSE":
                since = at
                self.handle.registerTimer(since + self.timeout)
            elif since is not None and action in (*SAFE, "ABORT"):
                told.append((since, at, action, "decision"))
                self.handle.deleteTimer(since + self.timeout)
                since = None
        if since is None:
            self.closed.clear()
        else:
            self.closed.update((since,))
        yield self._rows(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        since = self.closed.get()[0]
        self.closed.clear()
        yield self._rows(key, [(since, expiredTimerInfo.getExpiryTimeInMs(), "PAUSE", "timeout")])

    @staticmethod
    def _rows(key, told) -> pd.DataFrame:
        since, until, actions, causes = zip(*told) if told else ((), (), (), ())
        stamp = lambda ms: pd.to_datetime(pd.Series(ms, dtype="int64"), unit="ms")
        return pd.DataFrame({"machine": pd.Series([key[0]] * len(told), dtype="int64"), "closed": stamp(list(since)), "opened": stamp(list(until)), "action": pd.Series(list(actions), dtype="object"), "cause": pd.Series(list(causes), dtype="object")})

    def close(self) -> None:
        pass


def safe_openings(decided: DataFrame, timeout_ms: int = 30_000, late: str = "0 seconds") -> DataFrame:
    """``machine, closed, opened, action, cause``: each wait of a machine that was told to pause (``machine, ts, action``).

    It ends with the next decision that lets work go on or aborts it, or after the timeout with the pause still told;
    who waits goes on in both cases but the abort. Times are those of the samples, so a replay gives the same rows.
    """
    return _stateful(decided.select("machine", "ts", "action").withWatermark("ts", late), "machine", _Gate(timeout_ms), "machine long, closed timestamp, opened timestamp, action string, cause string", True)
