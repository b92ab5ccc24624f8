"""Applying change logs: current state, history, pairing, catch-up, as-of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last event of every key.

    One aggregate with map-side combine: a key of very many events is one row per
    task before the shuffle, which a ranking window would not do.  Only ``order``
    is compared, so the other columns may be of any type; it should be total.
    """
    rest = [c for c in log.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__best")
    return log.groupBy(*keys).agg(best).select(*keys, "__best.*").select(*log.columns)


def current_state(log: DataFrame, keys: Sequence[str], order: Sequence[str], op: str = "op") -> DataFrame:
    """The last event of every key that is not deleted."""
    return latest(log, keys, order).filter(F.col(op) != "delete")


def versions(log: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str]) -> DataFrame:
    """Every event with ``valid_to``, the time of the key's next one (null if last)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return log.withColumn("valid_to", F.lead(ts).over(w))


def in_order(log: DataFrame, keys: Sequence[str], order: Sequence[str], arrival: str) -> DataFrame:
    """Every event with ``ordered``: not before the key's event that arrived last."""
    now = F.struct(*order)
    return log.withColumn("ordered", F.coalesce(F.lag(now).over(Window.partitionBy(*keys).orderBy(arrival)) <= now, F.lit(True)))


def transaction_places(log: DataFrame, txn: str, order: Sequence[str]) -> DataFrame:
    """``txn_idx`` from 0, ``txn_total``, and whether an event begins or ends its transaction."""
    w = Window.partitionBy(txn)
    out = log.withColumn("txn_idx", (F.row_number().over(w.orderBy(*order)) - 1).cast("bigint")).withColumn("txn_total", F.count("*").over(w))
    return out.withColumn("txn_begin", F.col("txn_idx") == 0).withColumn("txn_end", F.col("txn_idx") == F.col("txn_total") - 1)


def forward_filled(log: DataFrame, column: str, partition: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The column with nulls replaced by the last value before, in each partition."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn(column, F.last(column, ignorenulls=True).over(w))


def changed(log: DataFrame, column: str, partition: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The events at which the column differs from the one before (or is the first)."""
    before = F.lag(column).over(Window.partitionBy(*partition).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) == 1
    return log.withColumn("__changed", first | ~F.col(column).eqNullSafe(before)).filter("__changed").drop("__changed")


def paired_rows(rows: DataFrame, partition: Sequence[str], place: str, value: str) -> DataFrame:
    """Consecutive (before, after) pairs of an update's rows; an odd tail goes.

    ``place`` counts from 0 within the partition, so a pair is a group.
    """
    pair = F.floor(F.col(place) / 2).alias("pair")
    half = lambda k: F.max(F.when(F.col(place) % 2 == k, F.struct(value)))
    found = rows.groupBy(*partition, pair).agg(half(0).alias("b"), half(1).alias("a")).filter("a IS NOT NULL AND b IS NOT NULL")
    return found.select(*partition, "pair", F.col(f"b.{value}").alias("before"), F.col(f"a.{value}").alias("after"))


def paired_images(rows: DataFrame, instance: str, lsn: str, operation: str, image: str) -> DataFrame:
    """Operations 1 delete, 2 insert, 3 before image and 4 update of change tables
    as events; an update takes the image of operation 3 right before it in its LSN."""
    w = Window.partitionBy(instance, lsn).orderBy("seqval", operation)
    held = F.lag(F.struct(F.col(operation).alias("op"), F.col(image).alias("image"))).over(w)
    out = rows.withColumn("__held", held).filter(F.col(operation) != 3)
    kind = F.when(F.col(operation) == 1, "delete").when(F.col(operation) == 2, "insert").otherwise("update")
    before = F.when(F.col(operation) == 1, F.col(image)).when((F.col(operation) == 4) & (F.col("__held.op") == 3), F.col("__held.image"))
    return out.withColumn("op", kind).withColumn("before", before).withColumn("after", F.when(F.col(operation) != 1, F.col(image))).drop("__held")


def snapshot_and_log(snapshot: DataFrame, log: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], op: str = "op") -> DataFrame:
    """Snapshot rows overtaken by the last change of their key; deletes remove.

    Returns keys, values and ``origin`` (log or snapshot).
    """
    last = latest(log, keys, order)
    joined = snapshot.alias("s").join(last.alias("l"), [F.col(f"s.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys], "full")
    changed_ = F.col(f"l.{op}").isNotNull()
    pick = lambda c: F.when(changed_, F.col(f"l.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
    kept = joined.filter(~changed_ | (F.col(f"l.{op}") != "delete"))
    return kept.select(*[F.coalesce(f"l.{k}", f"s.{k}").alias(k) for k in keys], *[pick(v) for v in values], F.when(changed_, "log").otherwise("snapshot").alias("origin"))


def replay_from(spill: DataFrame, tx: str, seq: int = 0, tx_col: str = "tx_id", seq_col: str = "seq") -> DataFrame:
    """Spilled events from (tx, seq) on, inclusive; an empty tx is all of them.

    Events carry ``place``, their order in the spill; an unknown tx gives none.
    """
    if not tx:
        return spill
    start = spill.filter((F.col(tx_col) == tx) & (F.col(seq_col) >= seq)).agg(F.min("place").alias("__start"))
    return spill.join(F.broadcast(start), F.col("place") >= F.col("__start")).drop("__start")  # one row


def as_of(events: DataFrame, history: DataFrame, at: str, valid_from: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Every event with the history value in force at its time (null before the first).

    Both sides are put in one order and the last value is carried along, so
    there is no range join; within ``by`` the history needs no size bound.
    Without ``by`` the history is expected short and becomes a sorted array,
    which travels with a broadcast of one row.
    """
    if not by:
        entries = F.array_sort(F.collect_list(F.struct(F.col(valid_from).alias("f"), F.col(value).alias("v"))))
        listed = history.agg(entries.alias("__history"))
        upto = F.filter("__history", lambda h: h["f"] <= F.col(at))
        return events.crossJoin(F.broadcast(listed)).withColumn(value, F.try_element_at(upto, F.lit(-1))["v"]).drop("__history")
    columns = events.columns
    marked = events.select(*by, F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(dict(history.dtypes)[value]).alias("__value"), F.struct(*columns).alias("__row"))
    points = history.select(*by, F.col(valid_from).alias("__at"), F.lit(0).alias("__kind"), F.col(value).alias("__value"), F.lit(None).cast(marked.schema["__row"].dataType).alias("__row"))
    w = Window.partitionBy(*by).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    carried = marked.unionByName(points).withColumn("__value", F.last("__value", ignorenulls=True).over(w)).filter("__kind = 1")
    return carried.select("__row.*", F.col("__value").alias(value))


def with_lookup(events: DataFrame, table: DataFrame, keys: Sequence[str], fallback: dict[str, Column]) -> DataFrame:
    """Events with the columns of their table's row; ``fallback`` fills what is missing."""
    found = events.join(table, list(keys), "left")
    return found.withColumns({c: F.coalesce(F.col(c), v) for c, v in fallback.items()})


def unblocked(events: DataFrame, blocked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events of tables that no pending DDL blocks."""
    return events.join(blocked.select(*keys).distinct(), list(keys), "left_anti")


def merged_into(target: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], op: str = "op", strategy: str = "upsert") -> DataFrame:
    """The target after a batch of changes: upsert, insert or update-only.

    ``replace`` is upsert; ``insert`` keeps existing rows (insert if absent).
    """
    last = latest(changes, keys, order)
    upserts = last.filter(F.col(op) != "delete").select(*keys, *values)
    if strategy in ("upsert", "replace"):
        return target.join(last.select(*keys), list(keys), "left_anti").select(*keys, *values).unionByName(upserts)
    if strategy == "insert":
        return target.select(*keys, *values).unionByName(upserts.join(target.select(*keys), list(keys), "left_anti"))
    if strategy == "update":
        return target.join(last.select(*keys), list(keys), "left_anti").select(*keys, *values).unionByName(upserts.join(target.select(*keys), list(keys), "left_semi"))
    raise ValueError(f"unknown strategy {strategy!r}")


def moved_keys(changes: DataFrame, before_key: str, after_key: str, op: str = "op") -> DataFrame:
    """Updates that change the key become a delete of the old and an insert of the new."""
    moved = (F.col(op) == "update") & ~F.col(before_key).eqNullSafe(F.col(after_key))
    both = F.array(F.struct(F.lit("delete").alias("__op"), F.col(before_key).alias("__key")), F.struct(F.lit("insert").alias("__op"), F.col(after_key).alias("__key")))
    one = F.array(F.struct(F.col(op).alias("__op"), F.when(F.col(op) == "delete", F.col(before_key)).otherwise(F.col(after_key)).alias("__key")))
    return changes.withColumn("__e", F.explode(F.when(moved, both).otherwise(one))).withColumn(op, F.col("__e.__op")).withColumn("key", F.col("__e.__key")).drop("__e")


def known_objects(ddl: DataFrame, name: str, kind: str, order: Sequence[str]) -> DataFrame:
    """Objects whose last DDL is not a drop, sorted by name."""
    return latest(ddl, [name], order).filter(F.col(kind) != "drop").select(name).orderBy(name)
