"""The replay machine on a stream: each key's state is kept between micro-batches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from tracewell.operators.trace import Machine


def replay(events: DataFrame, key: str, order: str, kind: str, fields: list[str], machine: dict) -> DataFrame:
    """As trace.replay, for a stream.  An event older than the last one of its key is refused (limit_exhausted), whatever batch brings it."""
    schema = events.select(key, order).schema.add("outcome", "string").add("transition", "string").add("state", "string")

    def run(name, frames, state):
        import pandas as pd

        now = Machine(machine, json.loads(state.get[0]) if state.exists else None)
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        out = []
        for row in rows.astype(object).where(rows.notna(), None).itertuples(index=False, name=None):
            own = dict(zip(rows.columns, row, strict=True))
            outcome, move = now.step(own[order], own[kind], own)
            out.append((own[key], own[order], outcome, move, now.s["at"]))
        state.update((json.dumps(now.s),))
        yield pd.DataFrame(out, columns=schema.names)

    names = list(dict.fromkeys([key, order, kind, *fields]))
    return events.select(*names).groupBy(key).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)
