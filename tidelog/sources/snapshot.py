"""Snapshot planning: whether, in which chunks, and how many at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.hashing import fnv32

CHUNK_ROWS = 100_000
PARALLEL_ROWS = 100_000


def should_snapshot(mode: str, has_position: bool) -> bool:
    """always: yes; initial and when_needed: if no position is saved; else no."""
    return mode == "always" or mode in ("initial", "when_needed") and not has_position


def chunk_bounds(low: int | None, high: int | None, size: int = CHUNK_ROWS) -> list[tuple[int, int]]:
    """Inclusive ranges that cover [low, high]; the last is clipped."""
    if low is None or high is None or high < low:
        return []
    return [(at, min(at + size - 1, high)) for at in range(low, high + 1, size)]


def range_chunk(key: Column, low: Column, size: int) -> Column:
    """The number of a key's range chunk."""
    return F.floor((key - low) / size).cast("bigint")


def range_chunks(table: DataFrame, key: str, size: int) -> DataFrame:
    """(chunk, n, low, high) of a table; the least key is one aggregated row."""
    least = table.agg(F.min(key).alias("__least"))
    chunk = range_chunk(F.col(key), F.col("__least"), size).alias("chunk")
    return table.select(key).crossJoin(F.broadcast(least)).groupBy(chunk).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))


def hash_chunk(keys: list[Column], chunks: int) -> Column:
    """The chunk of a row by the FNV hash of its key's text."""
    return F.pmod(fnv32(F.concat_ws("|", *[k.cast("string") for k in keys])), F.lit(chunks))


def hash_predicate(dialect: str, keys: list[str], chunk: int, chunks: int) -> str:
    """The predicate that a source database evaluates; empty for unknown ones."""
    listed = ", ".join(keys)
    forms = {
        "mysql": f"MOD(CRC32(CONCAT({listed})), {chunks}) = {chunk}", "mariadb": f"MOD(CRC32(CONCAT({listed})), {chunks}) = {chunk}",
        "postgres": f"MOD(ABS(HASHTEXT(CONCAT({listed}))), {chunks}) = {chunk}", "oracle": f"MOD(ORA_HASH({' || '.join(keys)}), {chunks}) = {chunk}",
        "sqlserver": f"ABS(CHECKSUM({listed})) % {chunks} = {chunk}",
    }
    return forms.get(dialect, "")


def plan(tables: DataFrame, parallel: bool = True, threshold: int = PARALLEL_ROWS) -> DataFrame:
    """Tables with ``plan``: chunk-parallel if enabled and large enough, else single."""
    return tables.withColumn("plan", F.when(F.lit(parallel) & (F.col("rows") >= threshold), "chunk-parallel").otherwise("single"))


def read_range_chunks(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, size: int = CHUNK_ROWS, **options: str) -> DataFrame:
    """A JDBC read with one partition per range chunk."""
    chunks = chunk_bounds(low, high, size)
    return spark.read.options(**options).jdbc(url, table, predicates=[f"{key} BETWEEN {a} AND {b}" for a, b in chunks] or ["1 = 0"])


def read_hash_chunks(spark: SparkSession, url: str, table: str, keys: list[str], dialect: str, chunks: int, **options: str) -> DataFrame:
    """A JDBC read with one partition per hash chunk."""
    if not hash_predicate(dialect, keys, 0, chunks):
        return spark.read.options(**options).jdbc(url, table)
    return spark.read.options(**options).jdbc(url, table, predicates=[hash_predicate(dialect, keys, k, chunks) for k in range(chunks)])


#: Catalogue queries for columns and keys, by dialect.
CATALOG_QUERIES = {
    "mysql": "SELECT column_name, column_type, is_nullable, column_key = 'PRI' AS is_key FROM information_schema.columns WHERE table_schema = '{schema}' AND table_name = '{table}' ORDER BY ordinal_position",
    "postgres": (
        "SELECT c.column_name, c.data_type AS column_type, c.is_nullable, k.column_name IS NOT NULL AS is_key FROM information_schema.columns c LEFT JOIN "
        "(SELECT u.table_schema, u.table_name, u.column_name FROM information_schema.table_constraints t JOIN information_schema.key_column_usage u "
        "USING (constraint_schema, constraint_name) WHERE t.constraint_type = 'PRIMARY KEY') k USING (table_schema, table_name, column_name) "
        "WHERE c.table_schema = '{schema}' AND c.table_name = '{table}' ORDER BY c.ordinal_position"
    ),
    "oracle": (
        "SELECT c.column_name, c.data_type AS column_type, c.nullable AS is_nullable, CASE WHEN k.column_name IS NULL THEN 0 ELSE 1 END AS is_key FROM all_tab_columns c LEFT JOIN "
        "(SELECT n.owner, n.table_name, n.column_name FROM all_constraints s JOIN all_cons_columns n ON s.owner = n.owner AND s.constraint_name = n.constraint_name WHERE s.constraint_type = 'P') k "
        "ON c.owner = k.owner AND c.table_name = k.table_name AND c.column_name = k.column_name WHERE c.owner = '{schema}' AND c.table_name = '{table}' ORDER BY c.column_id"
    ),
    "sqlserver": (
        "SELECT c.name AS column_name, y.name AS column_type, c.is_nullable, ISNULL(i.is_primary_key, 0) AS is_key FROM sys.columns c JOIN sys.types y ON c.user_type_id = y.user_type_id "
        "JOIN sys.tables t ON t.object_id = c.object_id JOIN sys.schemas s ON s.schema_id = t.schema_id LEFT JOIN sys.index_columns x ON x.object_id = c.object_id AND x.column_id = c.column_id "
        "LEFT JOIN sys.indexes i ON i.object_id = x.object_id AND i.index_id = x.index_id AND i.is_primary_key = 1 WHERE s.name = '{schema}' AND t.name = '{table}' ORDER BY c.column_id"
    ),
}


def catalog_query(dialect: str, schema: str, table: str) -> str:
    for name in (schema, table):
        if "'" in name:
            raise ValueError(f"name {name!r}")
    return CATALOG_QUERIES["mysql" if dialect == "mariadb" else dialect].format(schema=schema, table=table)
