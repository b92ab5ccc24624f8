"""Tasks: named streaming queries with states, pause and resume."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: Allowed moves between task states.
MOVES = {"created": {"running"}, "running": {"paused", "stopped", "error"}, "paused": {"running", "stopped"}, "stopped": {"running"}, "error": {"running", "stopped"}}


@dataclass
class Task:
    """A query that can be started again from its checkpoint."""

    name: str
    start_query: Callable[[], StreamingQuery]
    state: str = "created"
    query: StreamingQuery | None = field(default=None, repr=False)

    def _to(self, state: str) -> None:
        if state not in MOVES[self.state]:
            raise ValueError(f"task {self.name}: {self.state} cannot become {state}")
        self.state = state

    def start(self) -> None:
        self._to("running")
        self.query = self.start_query()

    resume = start

    def pause(self) -> None:
        """Stops the query; its checkpoint keeps the position."""
        self._to("paused")
        self.query.stop()

    def stop(self) -> None:
        self._to("stopped")
        if self.query is not None:
            self.query.stop()

    def wait(self) -> None:
        self.query.processAllAvailable() if self.query.isActive else self.query.awaitTermination()
        if self.query.exception() is not None:
            self._to("error")


class TaskManager:
    """Tasks by name."""

    def __init__(self):
        self._tasks: dict[str, Task] = {}

    def create(self, name: str, start_query: Callable[[], StreamingQuery]) -> Task:
        if name in self._tasks:
            raise ValueError(f"task {name} exists")
        self._tasks[name] = Task(name, start_query)
        return self._tasks[name]

    def get(self, name: str) -> Task:
        return self._tasks[name]

    def delete(self, name: str) -> None:
        if self._tasks[name].state == "running":
            raise ValueError(f"task {name} is running")
        del self._tasks[name]

    def list(self) -> list[tuple[str, str]]:
        return sorted((t.name, t.state) for t in self._tasks.values())


class ProgressMetrics(StreamingQueryListener):
    """Keeps the last figures of every query."""

    def __init__(self):
        self.last: dict[str, dict] = {}

    def onQueryStarted(self, event):
        self.last[str(event.id)] = {"rows": 0, "batches": 0, "rows_per_second": 0.0}

    def onQueryProgress(self, event):
        p = event.progress
        one = self.last.setdefault(str(p.id), {"rows": 0, "batches": 0, "rows_per_second": 0.0})
        one["rows"] += p.numInputRows
        one["batches"] += 1
        one["rows_per_second"] = p.processedRowsPerSecond or 0.0

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
