"""Memories with an end, as a stateful stream: the last value of each key, dropped when its time has come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "scope string, key string, value double, state string"


def memory_state(events: DataFrame, live: str = "5 days", late: str = "1 day") -> DataFrame:
    """events: scope, key, value, ts. Emits (scope, key, value, 'live') on each change and (.., 'expired') when nothing has
    been written to a key for `live` past its last time. State is one row a key and is removed with it."""
    keep = int(pd.Timedelta(live).total_seconds() * 1000)

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            value = state.get[0]
            state.remove()
            yield pd.DataFrame([(*key, value, "expired")], columns=["scope", "key", "value", "state"])
            return
        now, value = state.get[1] if state.exists else -1, state.get[0] if state.exists else None
        for part in rows:
            best = part.sort_values("at").iloc[-1]
            at = int(best["at"].timestamp() * 1000)
            if at >= now:
                now, value = at, float(best["value"])
        state.update((value, now))
        state.setTimeoutTimestamp(max(now + keep, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*key, value, "live")], columns=["scope", "key", "value", "state"])

    e = events.where("scope is not null and key is not null and value is not null").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).select("scope", "key", "value", "at")
    return e.groupBy("scope", "key").applyInPandasWithState(step, OUT, "value double, at bigint", "update", GroupStateTimeout.EventTimeTimeout)
