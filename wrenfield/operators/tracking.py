"""Marks, attempts and ranks as tables: every write is a function of the table before it and the changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_foreign(crawled: DataFrame, stored: DataFrame, key: str, fields: dict[str, str], provenance: str) -> DataFrame:
    """``crawled`` (key and ``fields``) with stored values for what the crawl didn't find, where they don't come from a crawl:
    the source that ``provenance`` (JSON by field's name) gives isn't a web address. Unreadable provenance keeps nothing;
    without any, values are kept."""
    p = F.from_json(provenance, "map<string,struct<confidence:double,source:string>>")
    old = stored.select(key, *[F.col(c).alias(f"_{c}") for c in fields], p.alias("_p"), (F.col(provenance).isNotNull() & (p.isNull() | (F.size(p) < 0))).alias("_broken"))

    def kept(c: str, name: str) -> Column:
        from_crawl = F.coalesce(F.lower(F.try_element_at("_p", F.lit(name))["source"]).rlike("^https?://"), F.lit(False))
        return F.coalesce(F.col(c), F.when(~F.coalesce("_broken", F.lit(False)) & ~from_crawl, F.col(f"_{c}")))

    return crawled.join(old, key, "left").select(key, *[kept(c, name).alias(c) for c, name in fields.items()])


def run_log(starts: DataFrame, ends: DataFrame, key: str = "id") -> DataFrame:
    """Runs with their ends: ``starts`` (key, mode, started_at) and, once they ended, ``ends`` (key, finished_at, stats_json)."""
    return starts.join(ends, key, "left")


def sightings(known: DataFrame, run: Column, ids: DataFrame, at: Column) -> DataFrame:
    """``known`` (run_id, job_id, seen_at) with one sighting of each of ``ids`` (job_id) in ``run``; those on file stay as they
    are. Records that lost against a richer copy are sighted too."""
    new = ids.where("job_id is not null").select(run.cast("bigint").alias("run_id"), "job_id").distinct().join(known.select("run_id", "job_id"), ["run_id", "job_id"], "left_anti")
    return known.select("run_id", "job_id", "seen_at").unionByName(new.withColumn("seen_at", at))


def set_once(rows: DataFrame, found: DataFrame, key: str, column: str, requeue: str) -> DataFrame:
    """``rows`` with ``column`` from ``found`` where it was null; ``requeue`` is cleared there, so the row is worked on again."""
    new = found.where(F.col(column).isNotNull()).groupBy(key).agg(F.min(column).alias("_new"))
    joined = rows.join(new, key, "left")
    hit = F.col(column).isNull() & F.col("_new").isNotNull()
    return joined.withColumn("_hit", hit).withColumn(requeue, F.when(~F.col("_hit"), F.col(requeue))).withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).select(*rows.columns)


def last_attempt(attempts: DataFrame, key: str, at: str, *values: str) -> DataFrame:
    """One row a key: that of its last attempt (ties: the greatest values)."""
    return attempts.groupBy(key).agg(F.max(F.struct(at, *values)).alias("_last")).select(key, *[F.col(f"_last.{c}").alias(c) for c in (at, *values)])


def marked(rows: DataFrame, marks: DataFrame, key: str, at: Column) -> DataFrame:
    """``rows`` after ``marks`` (key, status, note), one a key: a status sets the mark and its time, and a note where one is
    given; a null status clears all three."""
    new = marks.select(key, F.col("status").alias("_status"), F.col("note").alias("_note"), F.lit(True).alias("_marked"))
    joined = rows.join(new, key, "left")
    set_, clear = F.col("_status").isNotNull(), F.coalesce(F.col("_marked") & F.col("_status").isNull(), F.lit(False))
    change = lambda c, value: F.when(clear, None).when(set_, value).otherwise(F.col(c)).alias(c)
    changed = {"my_status": F.col("_status"), "my_status_at": at, "my_note": F.coalesce("_note", "my_note")}
    return joined.select(*[change(c, changed[c]) if c in changed else F.col(c) for c in rows.columns])


def stamped(rows: DataFrame, ids: DataFrame, key: str, column: str, at: Column) -> DataFrame:
    """``rows`` with ``column`` set to ``at`` for the keys of ``ids``, all in one table."""
    hit = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return rows.join(hit, key, "left").withColumn(column, F.when(F.col("_hit"), at).otherwise(F.col(column))).select(*rows.columns)


def guarded_fact(rows: DataFrame, facts: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with ``column`` from ``facts`` (key, value, stated): a stated fact overrides, any other is written only where
    nothing is. Of several facts of a key stated ones count first, then the least value."""
    one = facts.where("value is not null").groupBy(key).agg(F.min(F.struct((~F.coalesce("stated", F.lit(False))).alias("no"), "value")).alias("_f"))
    empty = F.coalesce(F.col(column), F.lit("")) == ""
    return rows.join(one, key, "left").withColumn(column, F.when(F.col("_f").isNotNull() & (~F.col("_f.no") | empty), F.col("_f.value")).otherwise(F.col(column))).select(*rows.columns)


def with_columns_of(rows: DataFrame, schema: dict[str, str]) -> DataFrame:
    """``rows`` with each column of ``schema`` (name to type) that it lacks, null; nothing is dropped or changed."""
    return rows.withColumns({c: F.lit(None).cast(kind) for c, kind in schema.items() if c not in rows.columns})
