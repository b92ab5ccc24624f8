"""Type names, literals and small text rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Coarse MySQL classes, tested in this order by containment.
MYSQL_CLASSES = (
    ("number", ("int", "decimal", "numeric", "float", "double", "real")),
    ("datetime", ("date", "time", "year")),
    ("string", ("char", "text", "blob", "binary", "enum", "set", "json")),
    ("bit", ("bit",)),
    ("geometry", ("geometry", "point", "linestring", "polygon")),
)
# PostgreSQL's type numbers.
POSTGRES_TYPES = {
    16: "bool", 17: "bytea", 18: "char", 19: "name", 20: "int8", 21: "int2", 23: "int4", 25: "text", 26: "oid", 114: "json", 142: "xml",
    700: "float4", 701: "float8", 790: "money", 829: "macaddr", 869: "inet", 1042: "bpchar", 1043: "varchar", 1082: "date", 1083: "time",
    1114: "timestamp", 1184: "timestamptz", 1186: "interval", 1266: "timetz", 1560: "bit", 1562: "varbit", 1700: "numeric", 2950: "uuid", 3802: "jsonb",
}
#: Native type to Spark type; others are strings.
SPARK_TYPES = {
    "bool": "boolean", "boolean": "boolean", "int2": "smallint", "smallint": "smallint", "tinyint": "tinyint", "int4": "int", "int": "int", "integer": "int", "mediumint": "int",
    "int8": "bigint", "bigint": "bigint", "float4": "float", "float": "float", "real": "float", "float8": "double", "double": "double", "date": "date", "timestamp": "timestamp_ntz",
    "datetime": "timestamp_ntz", "datetime2": "timestamp_ntz", "timestamptz": "timestamp", "bytea": "binary", "blob": "binary", "binary": "binary", "varbinary": "binary",
}


def parse_type(text: Column) -> Column:
    """struct(base, length, scale) of ``DECIMAL(10,2)`` and the like; unset numbers are 0."""
    number = lambda k: F.coalesce(F.regexp_extract(text, r"\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", k).try_cast("int"), F.lit(0))
    return F.struct(F.upper(F.trim(F.regexp_extract(text, r"^([^(]*)", 1))).alias("base"), number(1).alias("length"), number(2).alias("scale"))


def parse_type_text(text: str) -> tuple[str, int, int]:
    """:func:`parse_type` on the driver."""
    m = re.search(r"\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", text)
    return re.match(r"[^(]*", text)[0].strip().upper(), int(m[1]) if m else 0, int(m[2] or 0) if m else 0


def spark_type(native: str) -> str:
    """The Spark type of a native column type."""
    base, length, scale = parse_type_text(native)
    if base in ("DECIMAL", "NUMERIC", "NUMBER"):
        return f"decimal({min(length, 38)},{min(scale, 38)})" if length else "decimal(38,18)"
    return SPARK_TYPES.get(base.lower(), "string")


def mysql_class(native: Column) -> Column:
    """number, datetime, string, bit, geometry or unknown, by ordered containment."""
    low = F.lower(native)
    out = None
    for name, parts in MYSQL_CLASSES:
        test = low.rlike("|".join(parts))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("unknown")


def postgres_type(oid: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in POSTGRES_TYPES.items() for x in pair])
    return F.coalesce(F.element_at(names, oid.cast("int")), F.lit("unknown"))


def json_type(value: Column) -> Column:
    """The document field type of a JSON text: null, string, int, double, bool, object id, date or object."""
    v = F.trim(value)
    return (
        F.when(v.isNull() | (v == "null"), "null").when(v.isin("true", "false"), "bool").when(v.rlike(r'^"'), "string")
        .when(v.rlike(r"^-?\d+$"), "int").when(v.rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"), "double")
        .when(v.rlike(r'^\{\s*"\$oid"'), "objectId").when(v.rlike(r'^\{\s*"\$date"'), "date").when(v.rlike(r'^\{\s*"\$binary"'), "binary").otherwise("object")
    )


def sql_literal(text: Column) -> Column:
    """The value of a SQL literal as text: NULL is null, quotes come off, doubled quotes are one."""
    t = F.trim(text)
    quoted = t.rlike(r"(?s)^'.*'$") & (F.length(t) >= 2)
    return F.when(F.upper(t) == "NULL", None).when(quoted, F.replace(F.substring(t, F.lit(2), F.length(t) - 2), F.lit("''"), F.lit("'"))).otherwise(t)


def sql_literal_type(text: Column) -> Column:
    t = F.trim(text)
    return F.when(F.upper(t) == "NULL", "null").when(t.rlike(r"(?s)^'.*'$"), "string").when(t.try_cast("bigint").isNotNull(), "int").when(t.try_cast("double").isNotNull(), "double").otherwise("raw")


def is_blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def default_text(text: Column, default: str) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", default).otherwise(text)


def truncated(text: Column, n: int) -> Column:
    """At most ``n`` characters; three of them are dots if it was longer and n > 3."""
    if n <= 0:
        return F.lit("")
    short = F.concat(F.left(text, F.lit(n - 3)), F.lit("...")) if n > 3 else F.left(text, F.lit(n))
    return F.when(F.char_length(text) > n, short).otherwise(text)


def file_name(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z0-9_]", "_")


def is_ddl(statement: Column) -> Column:
    return F.upper(F.trim(statement)).rlike("^(CREATE|ALTER|DROP|TRUNCATE|RENAME) ")


def ddl_class(old: Column, new: Column) -> Column:
    """DROP without a new table, ALTER with an old one, else CREATE."""
    return F.when(new.isNull(), "DROP").when(old.isNotNull(), "ALTER").otherwise("CREATE")


def parse_size(text: str, disk_bytes: int = 0) -> int:
    """Bytes of ``80%`` of a disk, or of a number with TB, GB, MB or KB (1024-based)."""
    t = text.strip().upper()
    if m := re.fullmatch(r"(\d+(?:\.\d+)?)\s*%", t):
        share = float(m[1])
        if not 0 < share <= 100:
            raise ValueError(f"size {text!r} is no share")
        return int(disk_bytes * share / 100)
    if not (m := re.fullmatch(r"(\d+(?:\.\d+)?)\s*([TGMK]B)", t)) or float(m[1]) <= 0:
        raise ValueError(f"size {text!r} is not understood")
    return int(float(m[1]) * 1024 ** (" KMGT".index(m[2][0])))


def cache_level(used: Column, limit: Column) -> Column:
    """full, pause_scheduling, warning or normal, by the share that is used."""
    share = used / limit
    return F.when(limit <= 0, "full").when(share >= 1.0, "full").when(share >= 0.9, "pause_scheduling").when(share >= 0.8, "warning").otherwise("normal")


def quoted(name: Column, dialect: str) -> Column:
    """An identifier quoted for a SQL dialect."""
    left, right = {"mysql": "``", "sqlserver": "[]"}.get(dialect, '""')
    return F.concat(F.lit(left), F.replace(name, F.lit(right), F.lit(right * 2)), F.lit(right))


def wildcard_regex(pattern: str) -> str:
    """The anchored expression of a pattern with ``*`` and ``?``."""
    return r"(?s)\A" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + r"\z"


def wildcard(pattern: str, text: Column) -> Column:
    return text.rlike(wildcard_regex(pattern))
