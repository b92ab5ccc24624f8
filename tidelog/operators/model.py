"""The change-event envelope, typed change logs, and event predicates."""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.positions import POSITION

IMAGE = "map<string,string>"
SOURCE = "struct<connector:string,host:string,port:int,database:string,cluster:string,server:string,snapshot:boolean>"
TRANSACTION = "struct<id:string,total:bigint,idx:bigint,begin_time:timestamp,commit_time:timestamp>"
#: One row per change, any table.  Images map column names to text values.
ENVELOPE = (
    f"event_id string, source {SOURCE}, op string, position {POSITION}, `database` string, `schema` string, `table` string, pk_cols array<string>, uk_cols array<string>, "
    f"before {IMAGE}, after {IMAGE}, event_ts timestamp, txn {TRANSACTION}, metadata map<string,string>"
)


class Op(StrEnum):
    """Kinds of events."""

    INSERT = "insert"
    UPDATE = "update"
    DELETE = "delete"
    TRUNCATE = "truncate"
    DDL = "ddl"
    HEARTBEAT = "heartbeat"
    TOMBSTONE = "tombstone"


DATA_OPS = (Op.INSERT, Op.UPDATE, Op.DELETE)


def is_data(op: Column) -> Column:
    return op.isin(*DATA_OPS)


def is_ddl(op: Column) -> Column:
    return op == Op.DDL


def is_heartbeat(op: Column) -> Column:
    return op == Op.HEARTBEAT


def is_snapshot(source: Column) -> Column:
    return F.coalesce(source["snapshot"], F.lit(False))


def txn_begins(txn: Column) -> Column:
    return txn["idx"] == 0


def txn_ends(txn: Column) -> Column:
    return txn["idx"] == txn["total"] - 1


def txn_single(txn: Column) -> Column:
    return txn["total"] == 1


def as_image(*columns: str, cast: str = "string") -> Column:
    """A map image of typed columns."""
    return F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast(cast))])


def typed(envelope: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The typed tier of one table: both images as structs of ``columns`` (name to type)."""
    row = lambda side: F.when(F.col(side).isNotNull(), F.struct(*[F.element_at(side, c).try_cast(t).alias(c) for c, t in columns.items()]))
    return envelope.select("op", F.col("event_ts").alias("commit_ts"), F.col("position.seq").alias("seq"), row("before").alias("before"), row("after").alias("after"))


def change_log(rows: DataFrame, key: str, ts: str, fields: dict[str, str], updated: dict[str, Column], update_when: Column, delete_when: Column) -> DataFrame:
    """A change log of a table's rows.

    Every row is inserted at ``ts``; rows of ``update_when`` are updated a day
    later to the values ``updated``; rows of ``delete_when`` are deleted after
    two days.  ``fields`` names the image columns: out name to input column.
    One pass over the rows: the events of a row are an array that is exploded.
    Returns seq, op, commit_ts, pk, and b_<name>, a_<name> of every field.
    """
    first = {n: F.col(c) for n, c in fields.items()}
    last = {n: F.when(update_when, updated[n]).otherwise(first[n]) if n in updated else first[n] for n in fields}
    second = {n: updated.get(n, first[n]) for n in fields}
    none = {n: F.lit(None) for n in fields}
    types = dict(rows.dtypes)

    def event(place: int, op: Op, days: int, before: dict, after: dict) -> Column:
        pick = lambda side, values: [values[n].cast(types[c]).alias(f"{side}_{n}") for n, c in fields.items()]
        return F.struct(
            (F.col(key) * 10 + place).alias("seq"), F.lit(str(op)).alias("op"), (F.col(ts) + F.expr(f"INTERVAL {days} DAYS")).alias("commit_ts"),
            F.col(key).alias("pk"), *pick("b", before), *pick("a", after),
        )

    events = F.array(
        event(0, Op.INSERT, 0, none, first),
        F.when(update_when, event(1, Op.UPDATE, 1, first, second)),
        F.when(delete_when, event(2, Op.DELETE, 2, last, none)),
    )
    return rows.select(F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("e.*")
