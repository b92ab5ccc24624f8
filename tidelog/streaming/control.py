"""Control tables: positions, lifecycles, DDL states and schema history.

Each is a :class:`VersionedTable` that is small by nature (a row per task or
table).  A save merges rows by key and writes the next version.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from .runner import VersionedTable

# The tables, their columns and keys.
TABLES = {
    "task_position": ("task string, position string, saved_at string", ("task",)),
    "committed_position": ("task string, sink string, position string, saved_at string", ("task", "sink")),
    "table_lifecycle": ("task string, table_id string, state string, previous string, retries int, last_error string", ("task", "table_id")),
    "ddl_state": ("task string, table_id string, statement string, status string, retries int, error string", ("task", "table_id")),
    "schema_history": ("task string, position bigint, database string, schema string, table_name string, definition string", ("task", "position", "database", "schema", "table_name")),
}


class ControlStore:
    """Save, load, list and delete rows of the control tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self._tables = {n: VersionedTable(spark, f"{path}/{n}", schema) for n, (schema, _) in TABLES.items()}

    def _write(self, name: str, df: DataFrame) -> None:
        known = self._tables[name].versions()
        self._tables[name].write(df, known[-1] + 1 if known else 0)

    def save(self, name: str, rows: Iterable[Mapping]) -> None:
        """Inserts or replaces rows by their key."""
        schema, keys = TABLES[name]
        columns = [c.split()[0] for c in schema.split(", ")]
        new = self.spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], schema)
        kept = self._tables[name].read().join(new.select(*keys), list(keys), "left_anti").select(*columns)
        self._write(name, kept.unionByName(new))

    def load(self, name: str, **where) -> DataFrame:
        df = self._tables[name].read()
        for column, value in where.items():
            df = df.filter(F.col(column).eqNullSafe(F.lit(value)))
        return df

    def delete(self, name: str, **where) -> None:
        """Removes the rows that have all the given values; without any, all rows."""
        df = self._tables[name].read()
        match = F.lit(True)
        for column, value in where.items():
            match = match & F.col(column).eqNullSafe(F.lit(value))
        self._write(name, df.filter(~match))
