"""Applying a change stream to a table in micro-batches.

A target is a folder of Parquet versions; each batch reads the last version,
merges its changes and writes the next.  The version's name is the batch id, so
a batch that is run again writes the same version: with Spark's offsets, which
are committed after the batch, every change takes effect once.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.apply import merged_into
from ..plans.ddl import segments


class VersionedTable:
    """A table kept as whole versions ``v=<batch id>`` under one folder."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keep: int = 2):
        self.spark, self.path, self.schema, self.keep = spark, path, schema, keep

    def _fs(self):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Finished versions; the success mark is written last."""
        target, fs = self._fs()
        if not fs.exists(target):
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        found = [s.getPath() for s in fs.listStatus(target) if s.getPath().getName().startswith("v=")]
        return sorted(int(p.getName()[2:]) for p in found if fs.exists(path(p, "_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame:
        known = [v for v in self.versions() if before is None or v < before]
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={known[-1]}")

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        _, fs = self._fs()
        for old in [v for v in self.versions() if v < version][: -self.keep + 1 or None]:
            fs.delete(path(f"{self.path}/v={old}"), True)


def retry(action: Callable[[], object], attempts: int = 3, first: float = 0.1, factor: float = 2.0, most: float = 10.0, jitter: float = 0.0, retryable: tuple[type[Exception], ...] = (Exception,), sleep: Callable[[float], None] = time.sleep):
    """Runs an action, again after growing pauses; the last error is raised."""
    pause = first
    for attempt in range(1, attempts + 1):
        try:
            return action()
        except retryable:
            if attempt == attempts:
                raise
            sleep(min(most, pause) * (1 + random.random() * jitter))
            pause *= factor


@dataclass
class CircuitBreaker:
    """Stops calls after ``failures`` in a row; lets one probe through after ``reset`` seconds."""

    failures: int = 5
    reset: float = 30.0
    clock: Callable[[], float] = time.monotonic
    state: str = "closed"
    count: int = 0
    opened: float = 0.0

    def call(self, action: Callable[[], object]):
        if self.state == "open":
            if self.clock() - self.opened < self.reset:
                raise RuntimeError("circuit is open")
            self.state = "half-open"
        elif self.state == "half-open":
            raise RuntimeError("a probe is running")
        try:
            result = action()
        except Exception:
            self.count += 1
            if self.state == "half-open" or self.count >= self.failures:
                self.state, self.opened = "open", self.clock()
            raise
        self.state, self.count = "closed", 0
        return result


@dataclass
class Backpressure:
    """running, warning or paused, by fill percent and latency, with hysteresis."""

    high: float = 80.0
    low: float = 50.0
    latency: float = 5.0
    state: str = "running"

    def observe(self, used: float, seconds: float = 0.0) -> str:
        if used >= self.high or seconds > self.latency:
            self.state = "paused"
        elif self.state == "paused":
            if used <= self.low:
                self.state = "running"
        else:
            self.state = "warning" if used >= self.low else "running"
        return self.state


@dataclass
class RateLimit:
    """A token bucket: ``rate`` per second, up to ``burst`` at once."""

    rate: float
    burst: float
    clock: Callable[[], float] = time.monotonic
    held: float = field(default=-1.0)
    at: float = 0.0

    def wait(self, n: float) -> float:
        """Takes n tokens and tells for how long the caller must wait."""
        now = self.clock()
        if self.held < 0:
            self.held, self.at = self.burst, now
        self.held = min(self.burst, self.held + (now - self.at) * self.rate)
        self.at = now
        self.held -= n
        return 0.0 if self.held >= 0 else -self.held / self.rate


def apply_stream(
    stream: DataFrame, target: VersionedTable, checkpoint: str, keys: Sequence[str], order: Sequence[str], values: Sequence[str],
    op: str = "op", strategy: str = "upsert", on_ddl: Callable[[DataFrame, int], None] | None = None, attempts: int = 3, available_now: bool = True, trigger: str = "10 seconds",
) -> StreamingQuery:
    """Starts a query that keeps ``target`` in the state of the stream.

    Heartbeats are dropped.  A batch with DDL events is cut at them: each segment
    is merged under the definition before it, then ``on_ddl`` gets the DDL row.
    A batch that fails is retried, then fails the query; nothing is skipped.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.filter(F.col(op) != "heartbeat").persist()
        try:
            if batch_id in target.versions():
                return
            now = target.read(before=batch_id)
            for at, rows in segments(batch, order[-1], op):
                if at is not None and on_ddl is not None:
                    on_ddl(batch.filter((F.col(op) == "ddl") & (F.col(order[-1]) == at)), batch_id)
                now = merged_into(now, rows.filter(F.col(op).isin("insert", "update", "delete")), keys, order, values, op, strategy)
            retry(lambda: target.write(now, batch_id), attempts)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)).start()


def fan_out(stream: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, sink_col: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Writes each batch to several sinks: all rows, or those routed to each by ``sink_col``.

    The batch is kept once for all sinks.  An error of one fails the batch.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for name, write in sinks.items():
                write(batch if sink_col is None else batch.filter(F.col(sink_col) == name), batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ordered_writers(batch: DataFrame, writers: int, worker: str, order: Sequence[str], write: Callable) -> None:
    """Deals rows to writers by ``worker`` and hands each partition on in order."""
    batch.repartition(writers, worker).sortWithinPartitions(*order).foreachPartition(write)


def deduplicated(stream: DataFrame, ts: str, late: str, keys: Sequence[str]) -> DataFrame:
    """Drops repeats of an event id; the state is bounded by the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))
