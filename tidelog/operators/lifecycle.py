"""Table lifecycles: states, transitions, gates and positions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from enum import StrEnum

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class State(StrEnum):
    """States of a table."""

    PENDING = "pending"
    SNAPSHOTTING = "snapshotting"
    CATCHING_UP = "catching_up"
    STREAMING = "streaming"
    ERROR = "error"
    PAUSED = "paused"


#: Allowed moves; any state may also go to error.
MOVES = {
    State.PENDING: {State.SNAPSHOTTING}, State.SNAPSHOTTING: {State.CATCHING_UP}, State.CATCHING_UP: {State.STREAMING, State.PAUSED},
    State.STREAMING: {State.PAUSED}, State.ERROR: {State.PENDING}, State.PAUSED: {State.CATCHING_UP, State.STREAMING},
}
#: What happens to an event of a table in each state.
GATES = {State.SNAPSHOTTING: "spill", State.CATCHING_UP: "sink", State.STREAMING: "sink"}
MAX_RETRIES = 3


@dataclass(frozen=True)
class TableLifecycle:
    """One table's lifecycle; moves return a new one."""

    table_id: str
    state: State = State.PENDING
    previous: State | None = None
    retries: int = 0
    last_error: str = ""
    progress: float = 0.0

    def to(self, state: State, error: str = "") -> TableLifecycle:
        allowed = state == State.ERROR or state in MOVES[self.state]
        if self.state == State.PAUSED and state != State.ERROR and state != self.previous:
            allowed = False
        if not allowed:
            raise ValueError(f"{self.table_id}: {self.state} cannot become {state}")
        retries = self.retries + 1 if self.state == State.ERROR and state == State.PENDING else self.retries
        return replace(self, state=state, previous=self.state, retries=retries, last_error=error if state == State.ERROR else self.last_error)

    def resume(self) -> TableLifecycle:
        if self.state != State.PAUSED or self.previous is None:
            raise ValueError(f"{self.table_id} is not paused")
        return self.to(self.previous)


def skip_error(previous: Column) -> Column:
    """Where a table in error goes on: a table that had no stream catches up first."""
    return F.when(previous.isin("pending", "snapshotting"), "catching_up").otherwise("streaming")


def gate(state: Column) -> Column:
    """spill, sink or discard; unknown tables are discarded."""
    out = None
    for name, action in GATES.items():
        out = F.when(state == name, action) if out is None else out.when(state == name, action)
    return out.otherwise("discard")


def gated(events: DataFrame, lifecycles: DataFrame, key: str = "table_id") -> DataFrame:
    """Events with the ``action`` that their table's state asks for."""
    states = lifecycles.select(key, F.col("state").alias("__state"))
    return events.join(states, key, "left").withColumn("action", gate(F.col("__state"))).drop("__state")


def state_counts(lifecycles: DataFrame, states: Iterable[str] = tuple(State)) -> DataFrame:
    """(state, n) with a row for every state, zero or not."""
    spark: SparkSession = lifecycles.sparkSession
    named = spark.createDataFrame([(str(s),) for s in states], "state string")
    counted = lifecycles.groupBy("state").agg(F.count("*").alias("n"))
    return named.join(counted, "state", "left").select("state", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def effective_position(state: Column, snapshot: Column, stream: Column) -> Column:
    """The position from which a table would be read again; null for pending ones."""
    return F.when(state == "pending", None).when(state.isin("error", "snapshotting"), snapshot).otherwise(F.coalesce(stream, snapshot))


def least_position(lifecycles: DataFrame) -> DataFrame:
    """One row: the least effective position over all tables."""
    found = effective_position(F.col("state"), F.col("snapshot_position"), F.col("stream_position"))
    return lifecycles.agg(F.min(found).alias("min_position"))


def snapshot_progress(completed: Column, total: Column) -> Column:
    """Percent of the total; 0 if there is nothing."""
    return F.when(total > 0, completed * 100.0 / total).otherwise(F.lit(0.0))


class Scheduler:
    """Lifecycles of many tables, on the driver; their number is that of the tables."""

    def __init__(self, most_retries: int = MAX_RETRIES):
        self.tables: dict[str, TableLifecycle] = {}
        self.most_retries = most_retries

    def add(self, table_id: str) -> None:
        if table_id in self.tables:
            raise ValueError(f"{table_id} is known already")
        self.tables[table_id] = TableLifecycle(table_id)

    def _move(self, table_id: str, state: State, error: str = "") -> None:
        self.tables[table_id] = self.tables[table_id].to(state, error)

    def start_snapshot(self, table_id: str) -> None:
        self._move(table_id, State.SNAPSHOTTING)

    def snapshot_done(self, table_id: str) -> None:
        self._move(table_id, State.CATCHING_UP)

    def caught_up(self, table_id: str) -> None:
        self._move(table_id, State.STREAMING)

    def failed(self, table_id: str, error: str) -> None:
        self._move(table_id, State.ERROR, error)

    def pause(self, table_id: str) -> None:
        self._move(table_id, State.PAUSED)

    def resume(self, table_id: str) -> None:
        self.tables[table_id] = self.tables[table_id].resume()

    def retry(self, table_id: str) -> None:
        if self.tables[table_id].retries >= self.most_retries:
            raise ValueError(f"{table_id} was retried {self.most_retries} times")
        self._move(table_id, State.PENDING)

    def skip_error(self, table_id: str) -> None:
        table = self.tables[table_id]
        if table.state != State.ERROR:
            raise ValueError(f"{table_id} is not in error")
        early = table.previous in (State.PENDING, State.SNAPSHOTTING)
        self.tables[table_id] = replace(table, state=State.CATCHING_UP if early else State.STREAMING, previous=State.ERROR)

    def restart(self, table_id: str, force: bool = False) -> None:
        if self.tables[table_id].state == State.STREAMING and not force:
            raise ValueError(f"{table_id} is streaming; force its restart")
        self.tables[table_id] = TableLifecycle(table_id)

    def restart_schema(self, schema: str, force: bool = False) -> list[str]:
        found = [t for t in self.tables if t.startswith(f"{schema}.")]
        for t in found:
            self.restart(t, force)
        return found

    def errors(self) -> list[TableLifecycle]:
        return [t for t in self.tables.values() if t.state == State.ERROR]

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(t.table_id, str(t.state), str(t.previous or ""), t.retries, t.last_error) for t in self.tables.values()]
        return spark.createDataFrame(rows, "table_id string, state string, previous string, retries int, last_error string")
