"""The life of one DDL statement, and what a failed one blocks."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import StrEnum

from pyspark.sql import Column, DataFrame, functions as F

from .ddl import DDLError, SchemaRegistry


class DDLStatus(StrEnum):
    """States of a statement."""

    PENDING = "pending"
    APPLYING = "applying"
    COMPLETED = "completed"
    FAILED = "failed"
    SKIPPED = "skipped"


MOVES = {
    DDLStatus.PENDING: {DDLStatus.APPLYING, DDLStatus.SKIPPED}, DDLStatus.APPLYING: {DDLStatus.COMPLETED, DDLStatus.FAILED},
    DDLStatus.FAILED: {DDLStatus.APPLYING, DDLStatus.SKIPPED}, DDLStatus.COMPLETED: set(), DDLStatus.SKIPPED: set(),
}
MAX_RETRIES = 3


@dataclass(frozen=True)
class DDLRecord:
    """A statement at a position; moves return a new record."""

    database: str
    sql: str
    dialect: str
    position: int
    status: DDLStatus = DDLStatus.PENDING
    retries: int = 0
    error: str = ""

    def to(self, status: DDLStatus, error: str = "") -> DDLRecord:
        if status not in MOVES[self.status]:
            raise ValueError(f"a {self.status} statement cannot become {status}")
        again = self.status == DDLStatus.FAILED and status == DDLStatus.APPLYING
        return replace(self, status=status, error=error, retries=self.retries + again)

    @property
    def retryable(self) -> bool:
        return self.status == DDLStatus.FAILED and self.retries < MAX_RETRIES

    def run(self, registry: SchemaRegistry, sink=None) -> DDLRecord:
        """Applies the statement to the sink and then to the registry; a failure leaves both as they were."""
        now = self.to(DDLStatus.APPLYING)
        try:
            trial = SchemaRegistry()
            trial._tables, trial.history = dict(registry._tables), list(registry.history)
            trial.apply(self.sql, self.dialect, self.database, self.position)
            if sink is not None:
                sink(self.sql)
        except Exception as e:
            if not isinstance(e, DDLError | ValueError | RuntimeError | OSError):
                raise
            return now.to(DDLStatus.FAILED, str(e))
        registry._tables, registry.history = trial._tables, trial.history
        return now.to(DDLStatus.COMPLETED)


def blocks(status: Column, retries: Column) -> Column:
    """Whether a statement still holds back its table's rows; a failed one that may
    be tried again asks for a retry."""
    return F.when(status.isin("pending", "applying"), "block").when((status == "failed") & (retries < MAX_RETRIES), "retry").when(status == "failed", "block").otherwise("pass")


def ddl_gate(events: DataFrame, states: DataFrame, key: str = "table_id") -> DataFrame:
    """Events with the ``ddl_gate`` of their table; tables without a state pass."""
    worst = states.select(key, blocks(F.col("status"), F.col("retries")).alias("__gate")).groupBy(key)
    rank = F.max(F.when(F.col("__gate") == "block", 2).when(F.col("__gate") == "retry", 1).otherwise(0)).alias("__rank")
    gates = F.array(F.lit("pass"), F.lit("retry"), F.lit("block"))
    return events.join(worst.agg(rank), key, "left").withColumn("ddl_gate", F.get(gates, F.coalesce("__rank", F.lit(0)))).drop("__rank")
