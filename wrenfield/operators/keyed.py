"""Keyed operators: one row per key, ranks within a key, matches of keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _columns(names: list[str]) -> list[Column]:
    return [F.col(n) for n in names]


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``, which should be total. Rank windows are cut before the shuffle by Spark's
    window group limit, so a hot key sends one row a task. Rows with a null key form a key of their own."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_share(rows: DataFrame, keys: list[str], order: list[Column], share: float) -> DataFrame:
    """Of each key the first max(1, ceil(n x share)) rows."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("_rn", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    return ranked.where(F.col("_rn") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * share))).drop("_rn", "_n")


def top_quota(rows: DataFrame, key: str, order: list[Column], quotas: DataFrame, quota: str) -> DataFrame:
    """Of each key the first rows up to its quota; keys without a quota give none. ``quotas`` has ``key`` and ``quota``."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.join(quotas, key).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.col(quota)).drop("_rn")


def repeated(rows: DataFrame, keys: list[str], more_than: int = 1) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > more_than)


def without_collisions(rows: DataFrame, key: str, claimed: str) -> DataFrame:
    """Rows whose ``claimed`` value is claimed by one ``key`` only; null claims stay."""
    contested = rows.where(F.col(claimed).isNotNull()).groupBy(claimed).agg(F.count_distinct(key).alias("_n")).where("_n > 1")
    return rows.join(contested, claimed, "left_anti")


def commonest_unit(rows: DataFrame, keys: list[str], unit: list[str], figures: list[str]) -> DataFrame:
    """Like with like: per key the largest group of rows of one unit (ties: the least unit), with the mean of ``figures``."""
    means = [F.avg(f).alias(f) for f in figures]
    groups = rows.groupBy(*keys, *unit).agg(F.count("*").alias("samples"), *means)
    return first_by(groups, keys, [F.col("samples").desc(), *_columns(unit)])


def benchmark(rows: DataFrame, keys: list[str], unit: list[str], entity: str, low: str, high: str, *, entities: int = 3, figures: int = 2) -> DataFrame:
    """Market level: per key the unit that most entities use, if at least ``entities`` do with ``figures`` distinct pairs."""
    groups = (
        rows.groupBy(*keys, *unit)
        .agg(F.count_distinct(entity).alias("entities"), F.count_distinct(F.struct(low, high)).alias("pairs"), F.count("*").alias("samples"), F.avg(low).alias(low), F.avg(high).alias(high))
        .where((F.col("entities") >= entities) & (F.col("pairs") >= figures))
    )
    return first_by(groups, keys, [F.col("entities").desc(), F.col("samples").desc(), *_columns(unit)])


def common_or_null(column: str) -> Column:
    """The one value that all non-null rows have, else null."""
    return F.when(F.count_distinct(column) == 1, F.max(column))


def scaled_in_largest_unit(rows: DataFrame, part: str, unit: str, figure: str, name: str) -> DataFrame:
    """``rows`` with ``name``: min-max x 100 of ``figure`` among the rows of the partition's commonest unit (of two rows or
    more, and with different figures), null elsewhere."""
    known = rows.where(F.col(figure).isNotNull() & F.col(unit).isNotNull())
    groups = known.groupBy(part, unit).agg(F.count("*").alias("_n"), F.min(figure).alias("_lo"), F.max(figure).alias("_hi")).where("_n >= 2 and _hi > _lo")
    largest = first_by(groups, [part], [F.col("_n").desc(), F.col(unit)])
    out = rows.join(largest.select(part, F.col(unit).alias("_u"), "_lo", "_hi"), part, "left")
    scaled = F.when(F.col(unit) == F.col("_u"), (F.col(figure) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 100)
    return out.withColumn(name, scaled).drop("_u", "_lo", "_hi")


def laddered(rows: DataFrame, key: str, rungs: list[DataFrame]) -> DataFrame:
    """(key, target, level): of several match tables (key, target) the matches of the first that has any for a key, kept only
    if there is just one. Tables may repeat matches."""
    levelled = [r.select(F.col(r.columns[0]).alias(key), F.col(r.columns[1]).alias("target"), F.lit(i).alias("level")) for i, r in enumerate(rungs, 1)]
    found = reduce(DataFrame.union, levelled).join(rows.select(key).distinct(), key, "left_semi").distinct()
    per = found.groupBy(key, "level").agg(F.count("*").alias("n"), F.min("target").alias("target"))
    return first_by(per, [key], [F.col("level")]).where("n = 1").select(key, "target", "level")


def merged_group(rows: DataFrame, key: str, order: list[Column], *, fill: list[str], fill_empty: list[str], unite: list[str], keep: list[str]) -> DataFrame:
    """One row per key: the first in ``order`` wins ``keep``; its gaps are filled from the rest in order (``fill``: null is a
    gap, ``fill_empty``: so is the empty text); arrays of ``unite`` are united in order without repeats.

    First values are aggregated by rank with map-side combine; only the united arrays of one key meet in one task.
    """
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    gap = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.col("_rn")))
    return ranked.groupBy(key).agg(
        F.count("*").alias("copies"),
        *[F.min_by(c, "_rn").alias(c) for c in keep],
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_rn"))).alias(c) for c in fill],
        *[gap(c).alias(c) for c in fill_empty],
        *[F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_rn", F.coalesce(c, F.array()).alias("v")))), lambda x: x["v"]))).alias(c) for c in unite],
    )


def nearest_rank(rows: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """Per key the value at nearest rank floor(q x n) (from 0), exactly."""
    n = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    run = Window.partitionBy(*keys).orderBy(value)
    whole = Window.partitionBy(*keys)
    # One row a distinct value, so the window is over a histogram.
    placed = n.withColumn("upto", F.sum("c").over(run)).withColumn("n", F.sum("c").over(whole))
    at = F.least(F.col("n") - 1, F.floor(F.col("n") * q))
    return placed.where((F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)).select(*keys, F.col(value).alias(name))


def nearest_within(left: DataFrame, right: DataFrame, doc: str, limit: int) -> DataFrame:
    """(doc, a, at, b, gap): for each mention of ``left`` (doc, a, at) the nearest of ``right`` (doc, b, bt) of the same document
    less than ``limit`` away (ties: the earlier). Places are bucketed by ``limit``, so a long document is many buckets."""
    a = left.withColumn("_k", F.explode(F.array(*[F.floor(F.col("at") / limit) + d for d in (-1, 0, 1)])))
    b = right.withColumn("_k", F.floor(F.col("bt") / limit))
    near = a.join(b, [doc, "_k"]).withColumn("gap", F.abs(F.col("at") - F.col("bt"))).where(F.col("gap") < limit)
    return near.groupBy(doc, "a", "at").agg(F.min(F.struct("gap", "bt", "b")).alias("m")).select(doc, "a", "at", "m.b", "m.gap")
