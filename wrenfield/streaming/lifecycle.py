"""The lifecycle of records as a stream of runs."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_sightings(events: DataFrame, key: str, at: str, *, delay: str = "30 days") -> DataFrame:
    """Emit-once: the first event of each key, keys forgotten ``delay`` after their event. ``events`` is a stream or a table;
    rows without a time bypass the watermark's lateness only in a table."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def lifecycle(sightings: DataFrame, key: str, run: str, *, at: str | None = None, every: str = "7 days", delay: str = "0 seconds") -> DataFrame:
    """(key, status, run, misses): the state of each key after every micro-batch in which it came or its time ran out.

    Open while seen; a key that a run reports as not seen is stale after one run and closed after two. With the event time
    ``at`` a key that just stops coming goes stale once the watermark (``delay`` behind the newest event of all keys) is
    ``every`` past its last sighting, and closed after as long again; then its state is dropped. State per key is four
    numbers, kept in the state store; a key's rows reach it as an iterator.
    """
    timed = at is not None
    gap = int(pd.Timedelta(every).total_seconds() * 1000)

    def step(group: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, newest, seen_at, missed = state.get if state.exists else (-1, -1, -1, 0)
        if state.hasTimedOut:
            missed += 1
        else:
            for batch in batches:
                if batch["seen"].any():
                    last, missed = max(last, int(batch.loc[batch["seen"], "run"].max())), 0
                    seen_at = max(seen_at, int(batch.loc[batch["seen"], "ms"].max()))
                newest = max(newest, int(batch["run"].max()))
        misses = max(newest - last, missed)
        status = "open" if misses <= 0 else "stale" if misses == 1 else "closed"
        if timed and status == "closed":
            state.remove()
        else:
            state.update((last, newest, seen_at, missed))
            if timed:
                state.setTimeoutTimestamp(max(seen_at + gap * (missed + 1), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [group[0]], "status": [status], "run": [newest], "misses": [misses]})

    rows = sightings.withWatermark(at, delay) if timed else sightings
    ms = F.unix_millis(F.col(at)) if timed else F.lit(-1).cast("bigint")
    extra = [F.col(at).alias("_at")] if timed else []  # the watermark's column must reach the operator
    rows = rows.select(F.col(key).cast("string").alias("key"), F.col(run).cast("bigint").alias("run"), F.col("seen").cast("boolean").alias("seen"), ms.alias("ms"), *extra)
    kind = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return rows.groupBy("key").applyInPandasWithState(step, "key string, status string, run bigint, misses bigint", "last bigint, newest bigint, seen_at bigint, missed bigint", "update", kind)


def run_into(stream: DataFrame, apply, checkpoint: str, *, every: str | None = None, stop_after: int | None = None, mode: str = "append", **options: str):
    """Feed each micro-batch to ``apply(df, batch_id)``; a batch that fails is tried again from the checkpoint.

    Without ``every`` it ends when the input at hand is used up; with it a batch is made at that interval, and it ends after
    ``stop_after`` batches, if given.
    """
    fed = {"n": 0}

    def counted(df: DataFrame, batch: int) -> None:
        apply(df, batch)
        fed["n"] += 1

    writer = stream.writeStream.outputMode(mode).foreachBatch(counted).option("checkpointLocation", checkpoint)
    for k, v in options.items():
        writer = writer.option(k, v)
    query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    if every and stop_after:
        while query.isActive and fed["n"] < stop_after:
            query.awaitTermination(1)
        query.stop()
    else:
        query.awaitTermination()
    return query
