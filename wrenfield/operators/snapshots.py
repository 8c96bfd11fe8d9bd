"""Problem 5: what changed between full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def squeezed(text: Column) -> Column:
    """Case and blanks don't count."""
    return F.lower(F.regexp_replace(text, r"[\s\u00a0]+", ""))


def to_second(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def snapshot_changes(
    snapshots: DataFrame,
    state: list[Column],
    *,
    run: str = "run_id",
    key: str = "job_id",
    delivered: str = "delivered_at",
    runs: DataFrame | None = None,
) -> DataFrame:
    """Rows (``run``, ``key``, ``change``): ``added``, ``removed`` or ``changed`` from each run to the next.

    ``state`` are the expressions that are compared. A row belongs to its ``run`` however late it came; of several rows of
    one key in one run the last ``delivered`` holds (undelivered ones, with a null time, first; ties: the largest state hash).
    ``runs`` (first column: run ids) adds runs that hold no row at all; the order of runs is that of their ids.
    Rows without a run or key are no state of any record and are left out. The first run has nothing before it.

    Each key's deliveries are reduced before the shuffle, so repeats of a hot key never meet in one task; after that a key
    has one row a run. A window over the runs of a key then finds changes by lagged hashes and removals and later
    additions by gaps in the run index.
    """
    rows = snapshots.select(
        F.col(run).alias("run"),
        F.col(key).alias("key"),
        F.col(delivered).alias("at"),
        F.xxhash64(*[F.coalesce(s.cast("string"), F.lit("\u0000null")) for s in state]).alias("hash"),
    ).where(F.col("run").isNotNull() & F.col("key").isNotNull())
    ids = rows.select("run")
    if runs is not None:
        ids = ids.union(runs.select(F.col(runs.columns[0]).cast(rows.schema["run"].dataType)).where(F.col(runs.columns[0]).isNotNull()))
    # One row a delivery: as small as the calendar of deliveries, at any data size.
    index = ids.distinct().select("run", F.row_number().over(Window.orderBy("run")).alias("idx"))

    held = rows.groupBy("run", "key").agg(F.max(F.struct("at", "hash")).alias("last")).select("run", "key", "last.hash")
    by_key = Window.partitionBy("key").orderBy("idx")
    seen = (
        held.join(index, "run")
        .withColumn("before", F.lag("idx").over(by_key))
        .withColumn("before_hash", F.lag("hash").over(by_key))
        .withColumn("after", F.lead("idx").over(by_key))
    )
    none = F.lit(None).cast("struct<idx:int,change:string>")
    event = lambda at, what: F.struct(at.alias("idx"), F.lit(what).alias("change"))
    arrival = (
        F.when(F.col("before").isNull() | (F.col("before") < F.col("idx") - 1), F.when(F.col("idx") > 1, event(F.col("idx"), "added")))
        .when(F.col("before_hash") != F.col("hash"), event(F.col("idx"), "changed"))
        .otherwise(none)
    )
    leaving = F.when(F.col("after").isNull() | (F.col("after") > F.col("idx") + 1), event(F.col("idx") + 1, "removed")).otherwise(none)
    events = seen.select("key", F.explode(F.array_compact(F.array(arrival, leaving))).alias("e")).select("key", "e.idx", "e.change")
    # The run after the last is in no calendar, so the join also drops what would be removed there.
    return events.join(index, "idx").select(F.col("run").alias(run), F.col("key").alias(key), "change")
