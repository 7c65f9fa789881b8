"""Request windows that open at a client's first request, as keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strandlog.streaming.streams import route_template

MICROS = 1_000_000
DECIDED = "client string, route string, request_id long, opened long, allowed boolean, retry_after int"


class RequestWindows(StatefulProcessor):
    """For a client and route: a window opens at the first request after the last one has ended and lets the first
    ``limit`` requests through; to others it tells the whole seconds until it ends, plus one. A timer lets the window's state go
    when it has ended, so idle clients hold none."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.length = limit, seconds * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "opened long, n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.window.get() if self.window.exists() else None
        opened, n = held if held else (None, 0)
        was = opened
        for at, request in sorted((r.at, r.request_id) for r in rows):
            if opened is None or at - opened >= self.length:
                opened, n = at, 0
            allowed = n < self.limit
            n += allowed
            left = 0 if allowed else max(1, (self.length - (at - opened)) // MICROS + 1)
            yield Row(client=key[0], route=key[1], request_id=request, opened=opened, allowed=allowed, retry_after=int(left))
        self.window.update((opened, n))
        if was != opened:
            if was is not None:
                self.handle.deleteTimer((was + self.length) // 1000)
            self.handle.registerTimer((opened + self.length) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.window.clear()
        return iter([])

    def close(self) -> None:
        pass


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started within hold their state in RocksDB, which values, timers and their expiry need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def request_rate(requests: DataFrame, limit: int, seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """request_id, client, route, window_start, allowed, retry_after of a stream of requests (request_id, client, path, ts).

    Requests are ruled on as they come: those of a batch in order of ts and request_id, those of later batches after
    them. What is older than the watermark is dropped. Start the stream within ``keyed_state``."""
    d = requests.withWatermark("ts", late).select("client", route_template("path").alias("route"), "request_id", F.unix_micros("ts").alias("at"), "ts")
    ruled = d.groupBy("client", "route").transformWithState(RequestWindows(limit, seconds), DECIDED, "Append", "EventTime")
    return ruled.select("request_id", "client", "route", F.timestamp_micros("opened").alias("window_start"), "allowed", "retry_after")
