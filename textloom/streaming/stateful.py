"""Streams with state of their own for each key: rolling windows of the last rows, and entries that expire.

Rows wait in state until the watermark has passed them and are then taken in
the order of (ts, event_id), so results don't depend on the order of arrival
and equal those of a batch over all rows that weren't late. Many waiting rows
of a key are kept as short sorted runs, which are merged a few at a time, so
that a task never holds all of them. State needs Spark's RocksDB store, which
`started` sets for its query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a key that wait in one value, and rows of a run; rows that are merged and handed on at a time.
RUN, SLICE = 512, 10_000
_ROW = np.dtype([("us", "<i8"), ("event_id", "<i8"), ("value", "<f8"), ("failed", "?")])
_ENDS = np.dtype([("number", "<i8"), ("first", "<i8")])
HEALTH = "component string, event_id long, ts timestamp, n long, p95_ms double, error_pct double"
LOOKUPS = "key string, event_id long, ts timestamp, hit boolean"


class Ordered(StatefulProcessor):
    """Hands rows on in the order of event time once none can come before them; subclasses say what becomes of them.

    A key's state is one value while few rows wait: the last `keep` rows that
    were handed on, the rows that wait, and where the sorted runs of further
    ones begin in time.
    """

    keep = 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("ordered", "last binary, waiting binary, ends binary")
        self.runs = handle.getMapState("runs", "number long", "rows binary")

    def _held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        last, waiting, ends = self.state.get() or (b"", b"", b"")
        return np.frombuffer(last, _ROW), np.frombuffer(waiting, _ROW), np.frombuffer(ends, _ENDS)

    def _hold(self, last: np.ndarray, waiting: np.ndarray, ends: np.ndarray) -> None:
        if len(waiting) > RUN:
            waiting = np.sort(waiting, order=["us", "event_id"])
            number = int(ends["number"].max()) + 1 if len(ends) else 0
            parts = [waiting[i : i + RUN] for i in range(0, len(waiting), RUN)]
            for i, part in enumerate(parts):
                self.runs.updateValue((number + i,), (part.tobytes(),))
            ends = np.concatenate([ends, np.array([(number + i, part["us"][0]) for i, part in enumerate(parts)], _ENDS)])
            waiting = waiting[:0]
        if len(last) or len(waiting) or len(ends):
            self.state.update((last.tobytes(), waiting.tobytes(), ends.tobytes()))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest, held = None, self._held()
        for pdf in rows:
            new = np.empty(len(pdf), _ROW)
            for c, empty in (("us", 0), ("event_id", 0), ("value", np.nan), ("failed", False)):
                new[c] = pdf[c].to_numpy() if pdf[c].dtype != object else pdf[c].fillna(empty).to_numpy(new[c].dtype)
            latest = max(new["us"].max(), new["us"].max() if latest is None else latest)
            last, waiting, ends = held
            waiting = np.concatenate([waiting, new])
            if len(waiting) > RUN:
                self._hold(last, waiting, ends)
                held = self._held()
            else:
                held = last, waiting, ends
        if latest is not None:
            self._hold(*held)
            self.handle.registerTimer(int(latest) // 1000 + 1)  # all of them are final when the watermark gets there
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        last, waiting, ends = self._held()
        due = np.sort(ends[ends["first"] < 1000 * now], order="first")
        parts, fresh = [waiting], len(waiting)
        for i in range(len(due) + 1):
            if i < len(due):
                number = (int(due["number"][i]),)
                parts.append(np.frombuffer(self.runs.getValue(number)[0], _ROW))
                self.runs.removeKey(number)
                fresh += len(parts[-1])
            if fresh < SLICE and i < len(due):
                continue
            rows, fresh = np.concatenate(parts), 0
            final = rows["us"] < (min(1000 * now, due["first"][i + 1]) if i + 1 < len(due) else 1000 * now)  # no run that is still to be read has earlier ones
            done, parts = np.sort(rows[final], order=["us", "event_id"]), [rows[~final]]
            for j in range(0, len(done), SLICE):
                some = done[j : j + SLICE]
                yield self.take(key[0], last, some)
                last = np.concatenate([last, some])[-self.keep :]
        self._hold(self.still(last, now), parts[0], ends[ends["first"] >= 1000 * now])

    def take(self, key, last: np.ndarray, rows: np.ndarray) -> pd.DataFrame:
        """What is made of rows that are final, with the last ones before them."""
        raise NotImplementedError

    def still(self, last: np.ndarray, now: int) -> np.ndarray:
        """The last rows, as far as later ones may ask for them."""
        return last

    def close(self) -> None:
        pass


class RollingHealth(Ordered):
    """At each trace, the p95 latency and the share of failures of the key's last n traces."""

    def __init__(self, n: int):
        self.n = n
        self.keep = max(1, n - 1)

    def take(self, key, last: np.ndarray, rows: np.ndarray) -> pd.DataFrame:
        before = last[len(last) - min(len(last), self.n - 1) :]
        every = np.concatenate([before, rows])
        n = np.minimum(np.arange(1, len(rows) + 1) + len(before), self.n)
        windows = lambda x, empty: sliding_window_view(np.concatenate([np.full(self.n - 1 - len(before), empty), x]), self.n)
        failed = windows(every["failed"].astype(np.float64), 0.0).sum(axis=1)
        values = np.sort(windows(every["value"], np.nan), axis=1)  # unknown ones come last
        known = self.n - np.isnan(values).sum(axis=1)
        at = 0.95 * np.maximum(known - 1, 0)
        low = at.astype(np.int64)
        a, b = (np.take_along_axis(values, np.minimum(x, self.n - 1)[:, None], 1)[:, 0] for x in (low, np.minimum(low + 1, np.maximum(known - 1, 0))))
        share = at - low
        p95 = np.where(share < 0.5, a + (b - a) * share, b - (b - a) * (1 - share))
        return pd.DataFrame({"component": key, "event_id": rows["event_id"], "ts": pd.to_datetime(rows["us"], unit="us"), "n": n, "p95_ms": p95, "error_pct": 100.0 * failed / n})


class Renewed(Ordered):
    """Each lookup of a key is a hit if the one before it is at most `ttl_ms` old; a miss stores the key, a hit renews it, and an entry that is too old for any hit leaves the state."""

    def __init__(self, ttl_ms: int):
        self.ttl_us = 1000 * ttl_ms

    def take(self, key, last: np.ndarray, rows: np.ndarray) -> pd.DataFrame:
        us = np.concatenate([last["us"], rows["us"]])
        hit = np.concatenate([np.zeros(1 - len(last), bool), np.diff(us) <= self.ttl_us])
        return pd.DataFrame({"key": key, "event_id": rows["event_id"], "ts": pd.to_datetime(rows["us"], unit="us"), "hit": hit})

    def still(self, last: np.ndarray, now: int) -> np.ndarray:
        if not len(last):
            return last
        end = (int(last["us"][-1]) + self.ttl_us) // 1000 + 2
        if end <= now:
            return last[:0]
        self.handle.registerTimer(end)
        return last


def _keyed(rows: DataFrame, key: str, value, failed, lateness: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    out = rows.select(F.col(key).cast("string").alias("key"), ts.alias("ts"), F.unix_micros(ts).alias("us"), F.col("event_id").cast("long").alias("event_id"), value.cast("double").alias("value"), failed.cast("boolean").alias("failed"))
    return out.where("key IS NOT NULL AND us IS NOT NULL").withWatermark("ts", lateness)


def rolling_health(traces: DataFrame, component: str = "component", n: int = 100, lateness: str = "10 minutes") -> DataFrame:
    """component, event_id, ts, n, p95_ms, error_pct at each trace of a stream (ts, event_id, latency_ms, failed), over its component's last n."""
    rows = _keyed(traces, component, F.col("latency_ms"), F.col("failed"), lateness)
    return rows.groupBy("key").transformWithStateInPandas(RollingHealth(n), HEALTH, "Append", "EventTime")


def renewed_lookups(lookups: DataFrame, ttl_seconds: int, key: str = "key", lateness: str = "10 minutes") -> DataFrame:
    """key, event_id, ts, hit at each lookup of a stream (ts, event_id, key) of a cache whose entries live `ttl_seconds` after their last use."""
    rows = _keyed(lookups, key, F.lit(0.0), F.lit(False), lateness)
    return rows.groupBy("key").transformWithStateInPandas(Renewed(1000 * ttl_seconds), LOOKUPS, "Append", "EventTime")


def started(frame: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Run a stateful stream over what is there and append its rows to the Parquet table `target`; a later run goes on from the checkpoint."""
    spark = frame.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return frame.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)
