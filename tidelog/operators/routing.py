"""Destinations of events: table routes, partitions and dispatch to sinks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.hashing import fnv32
from ..functions.keys import image, table_name
from ..functions.storage import written

#: Routes up to which a lookup is an expression; more are joined.
INLINE_ROUTES = 1000


def table_route(routes: Mapping[str, str], default: str, database: Column, table: Column) -> Column:
    """The sink of ``db.table``, or the default (it may be empty)."""
    if len(routes) > INLINE_ROUTES:
        raise ValueError(f"over {INLINE_ROUTES} routes: join a route table instead")
    if not routes:
        return F.lit(default)
    lookup = F.create_map(*[F.lit(x) for pair in routes.items() for x in pair])
    return F.coalesce(F.element_at(lookup, table_name(database, table)), F.lit(default))


def route_by_table(events: DataFrame, routes: DataFrame, default: str) -> DataFrame:
    """As :func:`table_route` for a table of routes (name, sink) of any size."""
    named = events.withColumn("__name", table_name(F.col("database"), F.col("table")))
    unique = routes.groupBy(F.col("name").alias("__name")).agg(F.min("sink").alias("__sink"))
    return named.join(unique, "__name", "left").withColumn("sink", F.coalesce("__sink", F.lit(default))).drop("__name", "__sink")


def partition_key(strategy: str, database: Column, table: Column, before: Column | None = None, after: Column | None = None, fields: Iterable[str] = ()) -> Column:
    """What a partition is hashed from: the table's name, or the values of key
    fields, each followed by a bar.  A delete takes its before image; missing
    fields are skipped; unknown strategies hash the empty text."""
    if strategy == "table":
        return table_name(database, table)
    if strategy in ("pk", "field"):
        row = image(before, after)
        values = [F.coalesce(F.concat(F.element_at(row, f), F.lit("|")), F.lit("")) for f in fields]
        return F.concat(*values) if values else F.lit("")
    return F.lit("")


def partition(key: Column, count: int) -> Column:
    """FNV-1a of the key modulo ``count``, as text."""
    if count < 1:
        raise ValueError("at least one partition")
    return F.pmod(fnv32(key), F.lit(count)).cast("string")


def random_partition(count: int, seed: int) -> Column:
    return F.floor(F.rand(seed) * count).cast("string")


def round_robin(events: DataFrame, order: Iterable[str], sinks: int, out: str = "sink") -> DataFrame:
    """The sink number of each event in turn, by a global order.

    The turn is a rank over everything.  Events are range-partitioned, sorted and
    written once; ranks are counted within the partitions and shifted by the
    sizes of the partitions before, so no task sees all rows.
    """
    order = list(order)
    placed = events.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = written(placed, "round-robin").withColumn("__part", F.shiftright("__id", 33)).withColumn("__at", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))  # a row per partition
    before = sizes.withColumn("__first", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "__first")
    return placed.join(before, "__part").withColumn(out, F.pmod(F.col("__first") + F.col("__at"), F.lit(sinks))).drop("__id", "__part", "__at", "__first")


def hash_dispatch(value: Column, table: Column, sinks: int) -> Column:
    """The sink number of a field value: hashed, written in decimal, hashed again;
    a missing value takes the table's name."""
    return F.pmod(fnv32(fnv32(F.coalesce(value.cast("string"), table)).cast("string")), F.lit(sinks))


def writer(hash_key: Column, has_key: Column, table_key: Column, workers: int, keyless: str = "single") -> Column:
    """The worker of a row: equal keys meet in one; keyless rows go to worker 0,
    or to one worker per table."""
    other = F.lit(0).cast("bigint") if keyless == "single" else F.pmod(fnv32(table_key), F.lit(workers))
    return F.when(has_key, F.pmod(fnv32(hash_key), F.lit(workers))).otherwise(other)


def dispatch(kind: str = "round_robin"):
    """The dispatch function of a name."""
    known = {"round_robin": round_robin, "hash": hash_dispatch, "broadcast": broadcast}
    if kind not in known:
        raise ValueError(f"unknown dispatch {kind!r}")
    return known[kind]


def broadcast(events: DataFrame, sinks: Iterable[str]) -> DataFrame:
    """Every event once for each sink."""
    return events.withColumn("sink", F.explode(F.array(*[F.lit(s) for s in sinks])))
