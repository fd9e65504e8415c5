"""Per-process deltas over a stream: the last seen time of each process is its keyed state.

Within a micro-batch a process's rows are taken in row order, as in the batch operator; across
batches the state carries on. State of a process without events for ``idle`` is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "row_idx long, proc_exec_id string, event_time long, delta_t_prev_ns long, negative_delta boolean"


def stream_delta(events: DataFrame, idle_ms: int = 0) -> DataFrame:
    """``events`` (row_idx, proc_exec_id, event_time) with their deltas; rows without a process have none."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("row_idx")
        last = state.get[0] if state.exists else None
        t = rows["event_time"].astype("Int64")
        known = t.dropna()
        before = known.shift(1)
        if len(known) and last is not None:
            before.iloc[0] = last
        d = (known - before).reindex(t.index)
        if key[0] is None or pd.isna(key[0]):
            d = d.mask(np.ones(len(d), dtype=bool))
        negative = (d < 0).fillna(False).astype(bool)
        if len(known):
            state.update((int(known.iloc[-1]),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield rows.assign(event_time=t, delta_t_prev_ns=d.clip(lower=0), negative_delta=negative)[["row_idx", "proc_exec_id", "event_time", "delta_t_prev_ns", "negative_delta"]]

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    given = events.select("row_idx", "proc_exec_id", "event_time")
    return given.groupBy("proc_exec_id").applyInPandasWithState(step, OUT, "last long", "append", timeout)
