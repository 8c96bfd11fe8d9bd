"""Queries of the general data problems (1, 2 and 5) over the tables of TESTDATA.md."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenfield.operators.geography import country_spelling
from wrenfield.operators.snapshots import snapshot_changes, squeezed, to_second
from wrenfield.operators.times import normalised_times, zone_intervals
from wrenfield.operators.units import advert_figures, annual_dollars, fee_figures
from wrenfield.session import table


def annual_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = advert_figures(table(spark, sf_dir, "jobs")).unionByName(fee_figures(table(spark, sf_dir, "schools")))
    return annual_dollars(figures, table(spark, sf_dir, "fx"), table(spark, sf_dir, "periods"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annual_figures(spark, sf_dir).groupBy("tbl", "rec").agg(F.min("usd_low").alias("usd_low"), F.max("usd_high").alias("usd_high"))


def p1_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records whose unit combination isn't unique."""
    return annual_figures(spark, sf_dir).where(~F.col("unique")).select("tbl", "rec", "currency", "period", "usd_low", "usd_high").distinct()


def written_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, field, value, status) of every written time of every advert."""
    boards = table(spark, sf_dir, "boards").select(F.col("source").alias("_board"), F.col("tz").alias("clock_zone"), F.col("locale").isin("en-US").alias("month_first"))
    countries = table(spark, sf_dir, "countries")
    named = countries.select(F.lower("name").alias("_country"), F.col("tz").alias("place_zone"))
    coded = countries.select(F.lower("code").alias("_country"), F.col("tz").alias("place_zone"))
    places = named.union(coded).groupBy("_country").agg(F.min("place_zone").alias("place_zone"))
    jobs = table(spark, sf_dir, "jobs").where("id is not null").select(F.col("id").alias("job_id"), "source", country_spelling(F.col("country")).alias("_spelled"), "posted_at", "deadline_at", "start_date")
    rows = (
        jobs.join(boards, F.col("source") == F.col("_board"), "left")
        .join(places, F.col("_spelled") == F.col("_country"), "left")
        .select("job_id", "clock_zone", "place_zone", "month_first", F.expr("stack(3, 'posted_at', posted_at, 'deadline_at', deadline_at, 'start_date', start_date) as (field, value)"))
        .where("value is not null")
    )
    zones = boards.select("clock_zone").union(countries.select("tz"))
    return normalised_times(rows, "value", clock_zone="clock_zone", place_zone="place_zone", month_first="month_first", intervals=zone_intervals(zones)).select("job_id", "field", "value", "status")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_times(spark, sf_dir).where("value is not null").groupBy("job_id", "field").agg(F.min("value").alias("value"))


def p2_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many written times came out how, by field."""
    return written_times(spark, sf_dir).groupBy("field", "status").agg(F.count_distinct("job_id").alias("adverts"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = [squeezed(F.col("status")), to_second(F.col("last_seen_at")), to_second(F.col("closed_at"))]
    return snapshot_changes(table(spark, sf_dir, "job_snapshots"), state, runs=table(spark, sf_dir, "runs").select("id"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p5_found": p5_found, "p1_ambiguous": p1_ambiguous, "p2_status": p2_status}

ORACLES = {
    "p5_found": """
        WITH held AS (
          SELECT run_id, job_id, lower(regexp_replace(status, '\\s', '', 'g')) AS status, epoch(date_trunc('second', last_seen_at)) AS seen, epoch(date_trunc('second', closed_at)) AS closed
          FROM job_snapshots QUALIFY row_number() OVER (PARTITION BY run_id, job_id ORDER BY delivered_at DESC) = 1),
        pairs AS (
          SELECT coalesce(b.run_id, a.run_id + 1) AS run_id, coalesce(b.job_id, a.job_id) AS job_id, a.job_id IS NULL AS is_new, b.job_id IS NULL AS is_gone,
                 (a.status, a.seen, a.closed) IS DISTINCT FROM (b.status, b.seen, b.closed) AS differs
          FROM held a FULL JOIN held b ON a.job_id = b.job_id AND b.run_id = a.run_id + 1)
        SELECT run_id, job_id, CASE WHEN is_new THEN 'added' WHEN is_gone THEN 'removed' ELSE 'changed' END AS change
        FROM pairs WHERE (is_new OR is_gone OR differs) AND run_id BETWEEN 2 AND (SELECT max(id) FROM runs)""",
}
