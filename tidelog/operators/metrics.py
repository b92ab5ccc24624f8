"""Operational aggregates over events, spills, nodes and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def event_counts(events: DataFrame, by: Sequence[str], size: Column | None = None) -> DataFrame:
    """Events, and bytes where a size is given, by labels."""
    aggregates = [F.count("*").alias("events")]
    if size is not None:
        aggregates.append(F.sum(size).cast("bigint").alias("bytes"))
    return events.groupBy(*by).agg(*aggregates)


def lag_seconds(now: Column, ts: Column) -> Column:
    """Seconds from an event to now, not below 0."""
    return F.greatest(F.lit(0).cast("bigint"), F.unix_timestamp(now) - F.unix_timestamp(ts))


def spill_stat(spill: DataFrame, tx: str = "tx_id", ts: str = "ts", size: str | None = None) -> DataFrame:
    """One row: events, transactions (empty ids aside), first and last time, bytes."""
    out = [F.count("*").alias("events"), F.count_distinct(F.nullif(F.col(tx), F.lit(""))).alias("transactions"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")]
    if size:
        out.append(F.sum(size).cast("bigint").alias("bytes"))
    return spill.agg(*out)


def histogram(rows: DataFrame, value: str, bounds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(le, n): rows at or under each bound, cumulative, the last bound open."""
    over = F.array(*[F.struct(F.lit(float(b)).alias("le"), (F.col(value) <= b).cast("bigint").alias("hit")) for b in [*bounds, float("inf")]])
    return rows.filter(F.col(value).isNotNull()).select(*by, F.explode(over).alias("h")).groupBy(*by, F.col("h.le").alias("le")).agg(F.sum("h.hit").alias("n"))


def alive_nodes(nodes: DataFrame, now: Column, seconds: int = 30) -> DataFrame:
    """Nodes that were seen in the last ``seconds``."""
    return nodes.filter(F.unix_timestamp(now) - F.unix_timestamp("last_seen") <= seconds)


def least_loaded(nodes: DataFrame, most: int = 10) -> DataFrame:
    """One row: the node with the fewest tasks, under ``most``; ties to the smaller id."""
    return nodes.filter(F.col("tasks") < most).agg(F.min(F.struct("tasks", "node_id")).alias("m")).select("m.node_id", "m.tasks").filter("node_id IS NOT NULL")


def sink_totals(stats: DataFrame) -> DataFrame:
    """Written, failed and retried events summed over writers."""
    return stats.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("written", "failed", "retried")])


def greatest_lsn(rows: DataFrame, lsn: str) -> DataFrame:
    """The greatest fixed-width hex position."""
    return rows.agg(F.max(F.lower(F.col(lsn))).alias("max_lsn"))


def windowed_counts(events: DataFrame, ts: str, width: str, by: Sequence[str], late: str | None = None, slide: str | None = None) -> DataFrame:
    """Events per time window and labels; with ``late`` a watermark bounds the
    state of a stream (ts must be a timestamp with zone)."""
    source = events.withWatermark(ts, late) if late else events
    found = source.groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), *by).agg(F.count("*").alias("events"))
    return found.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "events")
