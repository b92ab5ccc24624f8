"""Records of events for each kind of sink, as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import table_name
from ..functions.text import quoted


def _cell(row: Column, name: str) -> Column:
    return F.element_at(row, name)


# -- message topics ------------------------------------------------------------


def message_topic(base: str, strategy: str, database: Column, table: Column) -> Column:
    """``base``, ``base.table`` or ``base.database``."""
    extra = {"default": None, "table": table, "database": database}
    if strategy not in extra:
        raise ValueError(f"unknown topic strategy {strategy!r}")
    return F.lit(base) if extra[strategy] is None else F.concat_ws(".", F.lit(base), extra[strategy])


def message_key(field: str, database: Column, table: Column, before: Column, after: Column, form: str = "plain") -> Column:
    """The key field of after, else before, else ``db.table``; ``json`` wraps it."""
    key = F.coalesce(_cell(after, field), _cell(before, field), table_name(database, table))
    return F.to_json(F.struct(database.alias("database"), table.alias("table"), key.alias("key"))) if form == "json" else key


def message_headers(op: Column, database: Column, table: Column, ts: Column, event_id: Column, binlog_file: Column | None = None) -> Column:
    pairs = [("event_type", op), ("database", database), ("table", table), ("timestamp", ts.cast("string")), ("event_id", event_id)]
    if binlog_file is not None:
        pairs.append(("binlog_file", binlog_file))
    headers = F.array(*[F.struct(F.lit(k).alias("key"), F.encode(v, "UTF-8").alias("value")) for k, v in pairs])
    return F.filter(headers, lambda h: h["value"].isNotNull())


def messages(envelope: DataFrame, base: str, strategy: str = "default", field: str = "id", form: str = "plain") -> DataFrame:
    """topic, key, value (JSON) and headers, as Spark's Kafka writer takes them."""
    c = F.col
    return envelope.select(
        message_topic(base, strategy, c("database"), c("table")).alias("topic"),
        message_key(field, c("database"), c("table"), c("before"), c("after"), form).alias("key"),
        F.to_json(F.struct(*envelope.columns)).alias("value"),
        message_headers(c("op"), c("database"), c("table"), c("event_ts"), c("event_id")).alias("headers"),
    )


# -- search index --------------------------------------------------------------


def search_action(op: Column) -> Column:
    """index, update or delete; null for other events."""
    return F.when(op == "insert", "index").when(op == "update", "update").when(op == "delete", "delete")


def joined_key(row: Column, keys: Sequence[str], separator: str = "_") -> Column:
    """Key values in order, joined; missing ones are skipped."""
    return F.array_join(F.filter(F.array(*[_cell(row, k) for k in keys]), lambda v: v.isNotNull()), separator) if keys else F.lit("")


def search_index(pattern: str, database: Column, table: Column, prefix: str = "") -> Column:
    filled = F.replace(F.replace(F.lit(pattern), F.lit("{database}"), F.lower(database)), F.lit("{table}"), F.lower(table))
    return F.concat(F.lit(prefix), filled)


def bulk_lines(action: Column, index: Column, doc_id: Column, document: Column, retries: int = 3) -> Column:
    """The newline-delimited lines of a bulk request: action, then document."""
    meta = F.struct(index.alias("_index"), doc_id.alias("_id"))
    update = F.struct(index.alias("_index"), doc_id.alias("_id"), F.lit(retries).alias("retry_on_conflict"))
    plain = lambda name: F.to_json(F.struct(meta.alias(name)))
    body = F.to_json(document)
    return (
        F.when(action == "delete", F.concat(plain("delete"), F.lit("\n")))
        .when(action == "update", F.concat(F.to_json(F.struct(update.alias("update"))), F.lit('\n{"doc":'), body, F.lit(',"doc_as_upsert":true}\n')))
        .when(action == "index", F.concat(plain("index"), F.lit("\n"), body, F.lit("\n")))
    )


# -- key-value store -----------------------------------------------------------


def store_key(pattern: str, database: Column, table: Column, op: Column, before: Column, after: Column, keys: Sequence[str]) -> Column:
    """The pattern with database, table and the joined key of before (deletes) or after."""
    row = F.when(op == "delete", before).otherwise(after)
    filled = F.lit(pattern)
    for name, value in (("{database}", database), ("{table}", table), ("{pk}", joined_key(row, keys))):
        filled = F.replace(filled, F.lit(name), value)
    return filled


def store_command(op: Column, form: str = "hash") -> Column:
    """DEL for deletes, else HSET (all fields) or SET (one JSON text)."""
    return F.when(op == "delete", "DEL").when(op.isin("insert", "update"), "HSET" if form == "hash" else "SET")


def store_records(envelope: DataFrame, pattern: str, keys: Sequence[str], form: str = "hash", ttl: int = 0) -> DataFrame:
    c = F.col
    return envelope.select(
        store_command(c("op"), form).alias("command"),
        store_key(pattern, c("database"), c("table"), c("op"), c("before"), c("after"), keys).alias("key"),
        F.when(c("op") != "delete", c("after")).alias("fields"),
        F.when((c("op") != "delete") & F.lit(form != "hash"), F.to_json("after")).alias("value"),
        F.lit(ttl).alias("ttl"),
    ).filter("command IS NOT NULL")


# -- document store ------------------------------------------------------------


def document_id(metadata: Column, before: Column, after: Column, keys: Sequence[str]) -> Column:
    """``_id`` of the metadata, then of after, then the first key of after, then of before."""
    first = [x for k in keys[:1] for x in (_cell(after, k), _cell(before, k))]
    return F.coalesce(_cell(metadata, "_id"), _cell(after, "_id"), *first, _cell(before, "_id"))


def document_write(op: Column, mode: str = "upsert") -> Column:
    """The write model: insert, replace or $set upsert; $set for updates; delete."""
    insert = {"insert": "insertOne", "replace": "replaceOne(upsert)", "upsert": "updateOne($set,upsert)"}
    if mode not in insert:
        raise ValueError(f"unknown write mode {mode!r}")
    return F.when(op == "insert", insert[mode]).when(op == "update", "updateOne($set)").when(op == "delete", "deleteOne")


# -- SQL -----------------------------------------------------------------------


def _literal(value: Column) -> Column:
    return F.when(value.isNull(), "NULL").otherwise(F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'")))


def sql_statement(dialect: str, op: Column, table: Column, before: Column, after: Column, columns: Sequence[str], keys: Sequence[str], strategy: str = "upsert") -> Column:
    """The statement that applies an event to a table of a SQL dialect.

    Updates and deletes address the row by its key before the change.  Without a
    key they have no statement (null), and upserts are plain inserts.
    """
    name = lambda c: quoted(F.lit(c), dialect)
    row = lambda image: F.concat_ws(", ", *[_literal(_cell(image, c)) for c in columns])
    listed = F.concat_ws(", ", *[name(c) for c in columns])
    target = quoted(table, dialect)
    insert = F.concat(F.lit("INSERT INTO "), target, F.lit(" ("), listed, F.lit(") VALUES ("), row(after), F.lit(")"))
    others = [c for c in columns if c not in keys]
    if dialect == "mysql" and strategy == "replace":
        insert = F.concat(F.lit("REPLACE INTO "), target, F.lit(" ("), listed, F.lit(") VALUES ("), row(after), F.lit(")"))
    elif dialect == "mysql" and strategy == "upsert":
        sets = F.concat_ws(", ", *[F.concat(name(c), F.lit(" = VALUES("), name(c), F.lit(")")) for c in columns])
        insert = F.concat(insert, F.lit(" ON DUPLICATE KEY UPDATE "), sets)
    elif dialect == "postgres" and strategy == "upsert" and keys:
        sets = F.concat_ws(", ", *[F.concat(name(c), F.lit(" = EXCLUDED."), name(c)) for c in others])
        action = F.concat(F.lit("DO UPDATE SET "), sets) if others else F.lit("DO NOTHING")
        insert = F.concat(insert, F.lit(" ON CONFLICT ("), F.concat_ws(", ", *[name(k) for k in keys]), F.lit(") "), action)
    if not keys:
        return F.when(op == "insert", insert)
    found = F.concat_ws(" AND ", *[F.concat(name(k), F.lit(" = "), _literal(_cell(before, k))) for k in keys])
    known = F.lit(True)
    for k in keys:
        known = known & _cell(before, k).isNotNull()
    update = F.concat(F.lit("UPDATE "), target, F.lit(" SET "), F.concat_ws(", ", *[F.concat(name(c), F.lit(" = "), _literal(_cell(after, c))) for c in columns]), F.lit(" WHERE "), found)
    delete = F.concat(F.lit("DELETE FROM "), target, F.lit(" WHERE "), found)
    return F.when(op == "insert", insert).when((op == "update") & known, update).when((op == "delete") & known, delete)


def ddl_decision(policy: str, op: Column) -> Column:
    """ignore, error or apply for DDL events; null for others."""
    if policy not in ("ignore", "error", "apply"):
        raise ValueError(f"unknown DDL policy {policy!r}")
    return F.when(op == "ddl", policy)
