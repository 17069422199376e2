"""The bounded workspace of each session, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def workspace(adds: DataFrame, capacity: int = 5) -> DataFrame:
    """(session, memory, added_at, rank) of adds(session, memory, added_at): the last `capacity` distinct memories.

    Adding again only refreshes the time; ties in time go to the smaller memory. The latest add of each memory
    is combined on the map side before a session meets in one place.
    """
    last = adds.groupBy("session", "memory").agg(F.max("added_at").alias("added_at"))
    w = Window.partitionBy("session").orderBy(F.desc("added_at"), "memory")
    return last.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= capacity)


def workspace_stream(events: DataFrame, capacity: int = 5) -> DataFrame:
    """The same as a stream of events(session, memory, added_at, op): the workspace of each touched session after each batch.

    op is "add", "remove" or "clear"; within a batch events apply in order of time. Output in update mode:
    (session, members), members newest first, joined by commas.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get)) if state.exists else {}
        pdf = pd.concat(list(batches)).sort_values(["added_at", "memory"], ascending=[True, False])
        for r in pdf.itertuples():
            if r.op == "clear":
                held.clear()
            elif r.op == "remove":
                held.pop(r.memory, None)
            else:
                held[r.memory] = r.added_at.value
                while len(held) > capacity:
                    held.pop(min(held, key=lambda m: (held[m], [-ord(c) for c in m])))
        names = sorted(held, key=lambda m: (-held[m], m))
        state.update((names, [held[m] for m in names]))
        yield pd.DataFrame({"session": [key[0]], "members": [",".join(names)]})

    return events.groupBy("session").applyInPandasWithState(
        step, "session string, members string", "names array<string>, times array<bigint>", "update", GroupStateTimeout.NoTimeout
    )


def activity(events: DataFrame, gap: str = "30 minutes", watermark: str = "10 minutes") -> DataFrame:
    """(session, start_us, end_us, n_events) of sessions that end after a gap; works on batches and streams."""
    e = events.withWatermark("added_at", watermark) if events.isStreaming else events
    return (
        e.groupBy("session", F.session_window("added_at", gap).alias("w")).agg(F.count("*").alias("n_events"))
        .select("session", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n_events")
    )
