"""Sessions as streams: the last messages of each session, and running counts of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "session bigint, turn bigint, role string, text string"
STATE = "messages array<struct<turn: bigint, role: string, text: string>>"


def windowed_history(messages: DataFrame, most: int = 20) -> DataFrame:
    """The last `most` messages of a session, sent out whenever the session gets new ones.

    The state of a session is its window, so it stays bounded however long the
    session runs, and survives restarts with the checkpoint.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [tuple(m.values()) if isinstance(m, dict) else tuple(m) for m in state.get[0]] if state.exists else []
        for batch in batches:
            held += list(batch[["turn", "role", "text"]].itertuples(index=False, name=None))
        held = sorted(held, key=lambda m: m[0])[-most:]
        state.update(([{"turn": int(t), "role": r, "text": x} for t, r, x in held],))
        yield pd.DataFrame([(key[0], int(t), r, x) for t, r, x in held], columns=["session", "turn", "role", "text"])

    return messages.groupBy("session").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """(start, event_type, n, value) in tumbling windows of event time; rows later than `late` are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n", "value")
