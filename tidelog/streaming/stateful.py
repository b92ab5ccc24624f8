"""Stateful stream operators: table lifecycles from their own events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lifecycle import State, TableLifecycle

OUT = "table_id string, seq bigint, from_state string, to_state string, ok boolean"


def lifecycle_stream(events: DataFrame) -> DataFrame:
    """Moves of each table's lifecycle, from events (table_id, seq, to_state).

    One small state per table.  A move that is not allowed is reported with
    ``ok`` false and changes nothing.  Events of a micro-batch are taken by seq.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, previous, retries = held.get if held.exists else ("pending", "", 0)
        now = TableLifecycle(key[0], State(state), State(previous) if previous else None, retries)
        out = []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples():
            before = now.state
            try:
                now, ok = now.to(State(row.to_state)), True
            except ValueError:
                ok = False
            out.append((key[0], row.seq, str(before), str(now.state), ok))
        held.update((str(now.state), str(now.previous or ""), now.retries))
        yield pd.DataFrame(out, columns=["table_id", "seq", "from_state", "to_state", "ok"])

    return events.groupBy("table_id").applyInPandasWithState(run, OUT, "state string, previous string, retries int", "append", GroupStateTimeout.NoTimeout)
