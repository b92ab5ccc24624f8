"""Raw log records of each kind of database to change events, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.apply import forward_filled, paired_images, paired_rows

# -- binlogs -------------------------------------------------------------------


def named_row(columns: Column, values: Column) -> Column:
    """A map of column names to values; it stops at the shorter of the two."""
    n = F.least(F.size(columns), F.size(values))
    return F.map_from_arrays(F.slice(columns, F.lit(1), n), F.slice(values, F.lit(1), n))


def binlog_events(rows: DataFrame) -> DataFrame:
    """Row events (file, pos, kind, columns, rows) to (file, pos, op, place, before, after).

    ``rows`` is an array of value arrays: single rows for inserts and deletes,
    consecutive (before, after) pairs for updates; an odd last row is dropped.
    """
    one = rows.filter(F.col("kind") != "update").select("file", "pos", F.col("kind").alias("op"), "columns", F.posexplode("rows").alias("place", "values"))
    row = named_row(F.col("columns"), F.col("values"))
    single = one.select("file", "pos", "op", F.col("place").cast("bigint").alias("place"), F.when(F.col("op") == "delete", row).alias("before"), F.when(F.col("op") == "insert", row).alias("after"))
    halves = rows.filter(F.col("kind") == "update").select("file", "pos", "columns", F.posexplode("rows").alias("place", "values"))
    halves = halves.select("file", "pos", "place", named_row(F.col("columns"), F.col("values")).alias("image"))
    # maps cannot be aggregated: pairs travel as entries
    entries = halves.withColumn("image", F.map_entries("image"))
    pairs = paired_rows(entries, ["file", "pos"], "place", "image")
    both = pairs.select("file", "pos", F.lit("update").alias("op"), F.col("pair").cast("bigint").alias("place"), F.map_from_entries("before").alias("before"), F.map_from_entries("after").alias("after"))
    return single.unionByName(both)


def with_binlog_file(log: DataFrame, rotate: str = "next_file", order: str = "seq", server: str = "server") -> DataFrame:
    """Every record with the file that the last rotate event before it named."""
    return forward_filled(log.withColumn("binlog_file", F.col(rotate)), "binlog_file", [server], [order])


# -- logical replication -------------------------------------------------------


def replication_kind(tag: Column) -> Column:
    """The op of a message tag; null for begin, commit, relation, type, origin."""
    return F.when(tag == "I", "insert").when(tag == "U", "update").when(tag == "D", "delete").when(tag == "T", "truncate")


def truncated_tables(messages: DataFrame, relations: str = "relations") -> DataFrame:
    """A truncate message as one event per relation."""
    return messages.withColumn("relation", F.explode(relations)).drop(relations)


def tuple_value(kind: Column, text: Column, oid: Column, raw: Column | None = None) -> Column:
    """A tuple cell: n is null, t its text, b decoded by type number.

    Binary numbers are big-endian; a float's bits are read as the float they are.
    """
    if raw is None:
        return F.when(kind == "t", text)
    bits = F.hex(raw)
    unsigned = F.conv(bits, 16, 10).cast("decimal(20,0)")

    def signed(width: int) -> Column:
        top, all_of = (F.lit(str(1 << k)).cast("decimal(20,0)") for k in (width - 1, width))
        return F.when(unsigned >= top, unsigned - all_of).otherwise(unsigned).cast("bigint")

    return (
        F.when(kind == "t", text)
        .when((kind == "b") & (oid == 16), F.when(bits == "01", "true").otherwise("false"))
        .when((kind == "b") & (oid == 21), signed(16).cast("string"))
        .when((kind == "b") & (oid == 23), signed(32).cast("string"))
        .when((kind == "b") & (oid == 20), signed(64).cast("string"))
        .when((kind == "b") & (oid == 700), _ieee(F.conv(F.substring(bits, 1, 8), 16, 10).cast("bigint"), 8, 23).cast("float").cast("string"))
        .when((kind == "b") & (oid == 701), _ieee64(bits).cast("string"))
        .when((kind == "b") & oid.isin(25, 1043, 1042, 114), F.decode(raw, "UTF-8"))
        .when(kind == "b", F.lower(bits))
    )


def _ieee(bits: Column, exponent: int, fraction: int) -> Column:
    """The value of IEEE-754 bits held in a non-negative bigint."""
    sign = F.when(F.shiftright(bits, exponent + fraction).bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0)
    power = F.shiftright(bits, fraction).bitwiseAND(F.lit((1 << exponent) - 1))
    part = bits.bitwiseAND(F.lit((1 << fraction) - 1)) / F.lit(float(1 << fraction))
    bias = (1 << (exponent - 1)) - 1
    normal = sign * (part + 1) * F.pow(F.lit(2.0), power - bias)
    top = F.when(part == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return F.when(power == 0, sign * part * F.pow(F.lit(2.0), F.lit(float(1 - bias)))).when(power == (1 << exponent) - 1, top).otherwise(normal)


def _ieee64(hexed: Column) -> Column:
    """A double from 16 hex digits; the sign is taken off, as bigints are signed."""
    negative = F.conv(F.substring(hexed, 1, 1), 16, 10).cast("int") >= 8
    first = F.hex((F.conv(F.substring(hexed, 1, 1), 16, 10).cast("bigint")) % 8)
    bits = F.conv(F.concat(first, F.substring(hexed, 2, 15)), 16, 10).cast("bigint")
    return F.when(negative, -_ieee(bits, 11, 52)).otherwise(_ieee(bits, 11, 52))


def schema_changes(relations: DataFrame) -> DataFrame:
    """Relation messages (relation, lsn, columns) whose columns differ from the last known."""
    from ..operators.apply import changed

    return changed(relations.withColumn("__text", F.to_json("columns")), "__text", ["relation"], ["lsn"]).drop("__text")


# -- document change streams ---------------------------------------------------

#: Stream operations that change definitions.
DOCUMENT_DDL = ("drop", "dropDatabase", "create", "createIndexes", "rename", "invalidate", "dropIndexes", "modify")


def document_op(kind: Column) -> Column:
    """insert, update (also replace), delete or ddl; unknown kinds are null, not inserts."""
    return F.when(kind == "insert", "insert").when(kind.isin("update", "replace"), "update").when(kind == "delete", "delete").when(kind.isin(*DOCUMENT_DDL), "ddl")


def document_fields(document: Column) -> Column:
    """A JSON document as a map of top-level fields to JSON texts."""
    return F.from_json(document, "map<string,string>")


def document_key(document_key_json: Column) -> Column:
    """``_id``, of an object id its digits."""
    return F.coalesce(F.get_json_object(document_key_json, "$._id.$oid"), F.get_json_object(document_key_json, "$._id"))


# -- redo logs and change tables -----------------------------------------------


def redo_op(operation: Column) -> Column:
    """1 insert, 2 delete, 3 update, 5 ddl."""
    return F.when(operation == 1, "insert").when(operation == 2, "delete").when(operation == 3, "update").when(operation == 5, "ddl")


def redo_batch(log: DataFrame, after_scn: int, limit: int) -> DataFrame:
    """The next records after a position, in order; read on from the greatest
    position *read*, which skips nothing.  Records of the last position that the
    limit would cut are all returned."""
    wanted = log.filter((F.col("scn") > after_scn) & F.col("operation").isin(1, 2, 3, 5))
    last = wanted.orderBy("scn").limit(limit).agg(F.max("scn").alias("__last"))
    return wanted.join(F.broadcast(last), F.col("scn") <= F.col("__last")).drop("__last")


def merged_update(old: Column, new: Column) -> Column:
    """An update's after image: WHERE columns that SET does not name are carried over."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def change_table_events(rows: DataFrame) -> DataFrame:
    """Change-table rows (instance, lsn, seqval, operation, image) to events.

    Meta columns (``__$...``) leave the image.
    """
    image = F.map_filter("image", lambda k, _: ~k.startswith("__$"))
    clean = rows.withColumn("image", image)
    return paired_images(clean, "instance", "lsn", "operation", "image").drop("operation", "image")
