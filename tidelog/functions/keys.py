"""Names, row identifiers and sizes of change events.

Images are maps of column name to text; a null map is an absent image.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: how an absent value reads in keys and in pattern tests.
ABSENT = "<nil>"


def table_name(database: Column, table: Column, schema: Column | None = None) -> Column:
    """``db.table``, or ``db.schema.table`` where a schema is given."""
    if schema is None:
        return F.concat_ws(".", database, table)
    return F.when(F.coalesce(schema, F.lit("")) == "", F.concat_ws(".", database, table)).otherwise(F.concat_ws(".", database, schema, table))


def split_table_name(name: Column) -> Column:
    """struct(database, table): a name is cut at its first dot."""
    parts = F.split(name, r"\.", 2)
    return F.struct(parts[0].alias("database"), F.coalesce(F.get(parts, 1), F.lit("")).alias("table"))


def key_columns(primary: Column, unique: Column) -> Column:
    """The primary key's columns, or else the unique key's."""
    return F.when(F.size(F.coalesce(primary, F.array().cast("array<string>"))) > 0, primary).otherwise(unique)


def image(before: Column, after: Column) -> Column:
    """The image that identifies a row: after, or before if after is empty."""
    return F.when(F.size(F.coalesce(after, F.create_map().cast("map<string,string>"))) > 0, after).otherwise(before)


def row_identifier(primary: Column, unique: Column, before: Column, after: Column) -> Column:
    """``column=value,...`` over the key, or over all columns by name if there is none."""
    row = image(before, after)
    keys = key_columns(primary, unique)
    named = F.when(F.size(F.coalesce(keys, F.array().cast("array<string>"))) > 0, keys).otherwise(F.array_sort(F.map_keys(row)))
    return F.array_join(F.transform(named, lambda c: F.concat(c, F.lit("="), F.coalesce(F.element_at(row, c), F.lit(ABSENT)))), ",")


def identifier_kind(primary: Column, unique: Column) -> Column:
    has = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    return F.when(has(primary), "pk").when(has(unique), "uk").otherwise("fullrow")


def hash_key(schema: Column, database: Column, table: Column, identifier: Column) -> Column:
    """``schema.database.table:identifier``, by which rows are dealt to writers."""
    return F.format_string("%s.%s.%s:%s", schema, database, table, identifier)


def debug_key(schema: Column, database: Column, table: Column, kind: Column, identifier: Column) -> Column:
    return F.format_string("%s.%s.%s[%s:%s]", schema, database, table, kind, identifier)


def event_id(connector: Column, database: Column, ts: Column, seq: Column) -> Column:
    """``connector:database:yyyyMMddHHmmss.SSS:seq``."""
    return F.concat_ws(":", connector, database, F.date_format(ts, "yyyyMMddHHmmss.SSS"), seq.cast("string"))


def heartbeat_id(connector: Column, nanos: Column) -> Column:
    return F.concat_ws(":", connector, F.lit("heartbeat"), nanos.cast("string"))


def image_size(row: Column) -> Column:
    """Bytes of names and values; an absent image is 0."""
    sizes = F.transform(F.map_entries(row), lambda e: F.octet_length(e["key"]) + F.coalesce(F.octet_length(e["value"]), F.lit(0)))
    return F.coalesce(F.aggregate(sizes, F.lit(0), lambda a, b: a + b), F.lit(0))


def event_size(source_database: Column, database: Column, table: Column, before: Column, after: Column) -> Column:
    """Names, a fixed 64 bytes, and both images."""
    names = F.octet_length(source_database) + F.octet_length(database) + F.octet_length(table)
    return names + F.lit(64) + image_size(before) + image_size(after)
