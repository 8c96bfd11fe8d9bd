"""Queries of projections, searches, ladders, overlays and caches over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrenfield.functions import text as tx
from wrenfield.operators import keyed
from wrenfield.operators.geography import COUNTRY_SPELLINGS, country_spelling
from wrenfield.operators.registry import Field, empty_cells, first_filled, project, resolve
from wrenfield.plans.relational import ONE_JOB, ONE_SCHOOL, one_job, one_school
from wrenfield.session import spooled, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def advert_fields() -> list[Field]:
    c = F.col
    return [
        Field("country", "Country", "location", "both", first_filled("s_country", "country")),
        Field("city", "City", "location", "both", first_filled("s_city", "city")),
        Field("school_name", "School", "school", "both", first_filled("name", "school_name")),
        Field("curriculum", "Curriculum", "school", "both", F.array_join(F.coalesce("s_curriculum", "curriculum"), ", ")),
        Field("student_count", "Students", "school", "school", c("student_count")),
        Field("website", "Website", "school", "both", first_filled("website", "school_website")),
        Field("school_email", "School address", "contact", "both", first_filled("school_email")),
        Field("career_email", "Careers address", "contact", "both", first_filled("career_email", F.try_element_at("emails", F.lit(1)))),
        Field("job_title", "Role", "job", "job", first_filled("title")),
        Field("seniority", "Seniority", "job", "job", first_filled("pe_seniority")),
        Field("job_url", "Link", "job", "job", first_filled("url")),
        Field("contract", "Contract", "job", "job", F.nullif(F.concat_ws(", ", "contract_type", "contract_term"), F.lit(""))),
        Field("apply_type", "Apply by", "job", "job", F.when(c("quick_apply"), "one click").when(~c("quick_apply"), "long form")),
        Field("status", "Status", "tracking", "job", F.lower(F.trim("status"))),
        Field("my_status", "Mine", "tracking", "job", first_filled("my_status")),
        Field("last_seen", "Last seen", "tracking", "job", F.date_format("last_seen_at", "yyyy-MM-dd")),
    ]


def advert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = one_job(spark, sf_dir, "school_key", "school_name", "country", "city", "school_website", "curriculum", "emails", "title", "pe_seniority", "url", "contract_type", "contract_term", "quick_apply", "status", "my_status", "last_seen_at")
    s = one_school(spark, sf_dir, "name", "country", "city", "website", "curriculum", "student_count", "school_email", "career_email")
    s = s.withColumnsRenamed({"country": "s_country", "city": "s_city", "curriculum": "s_curriculum"}).drop("rec_id", "enriched_at")
    return j.join(s, "school_key", "left")


TICKED = ["job_title", "country", "nonsense", "status", "website", "student_count", "country", "last_seen", "apply_type", "contract"]


@query(f"""SELECT coalesce(j.title, '') AS "Role", coalesce(nullif(s.country, ''), nullif(j.country, ''), '') AS "Country", coalesce(lower(trim(j.status)), '') AS "Status", coalesce(nullif(s.website, ''), nullif(j.school_website, ''), '') AS "Website", coalesce(strftime(j.last_seen_at AT TIME ZONE 'UTC', '%Y-%m-%d'), '') AS "Last seen",
  CASE WHEN j.quick_apply THEN 'one click' WHEN NOT j.quick_apply THEN 'long form' ELSE '' END AS "Apply by", concat_ws(', ', j.contract_type, j.contract_term) AS "Contract" FROM {ONE_JOB} j LEFT JOIN {ONE_SCHOOL} s ON j.school_key = s.school_key""")
def field_registry(spark, sf_dir):
    return project(advert_rows(spark, sf_dir), resolve(advert_fields(), TICKED, "job"))


@query(f"""WITH r AS (SELECT coalesce(j.title, '') AS a, coalesce(nullif(s.country, ''), nullif(j.country, ''), '') AS b FROM {ONE_JOB} j LEFT JOIN {ONE_SCHOOL} s ON j.school_key = s.school_key)
  SELECT 'Role' AS field, count(*) FILTER (a = '') AS empty, count(*) AS n FROM r UNION ALL SELECT 'Country', count(*) FILTER (b = ''), count(*) FROM r""")
def field_gaps(spark, sf_dir):
    return empty_cells(advert_rows(spark, sf_dir), resolve(advert_fields(), ["job_title", "country"], "job"))


@query(f"""WITH h AS (SELECT id, pe_score, lower(strip_accents(coalesce(title, ''))) AS t, lower(strip_accents(concat_ws(' ', title, school_name, city))) AS hay FROM {ONE_JOB})
  SELECT id, 10 * (contains(t, 'swimming')::INT + contains(t, 'coach')::INT) + coalesce(pe_score, 0) AS score FROM h WHERE contains(hay, 'swimming') AND contains(hay, 'coach')""")
def all_words_search(spark, sf_dir):
    """Every word of the query must stand in the advert; hits in the title weigh more."""
    words = ["swimming", "coach"]
    j = one_job(spark, sf_dir, "title", "school_name", "city", "pe_score")
    plain = lambda c: F.lower(tx.without_accents(c))
    hay, title = plain(F.concat_ws(" ", "title", "school_name", "city")), plain(F.coalesce("title", F.lit("")))
    hits = sum(F.when(title.contains(w), 1).otherwise(0) for w in words)
    found = j.where(F.forall(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(hay, w)))
    return found.select("id", (hits * 10 + F.coalesce("pe_score", F.lit(0))).alias("score"))


@query("SELECT o_orderkey, datediff('day', DATE '1997-06-01', o_orderdate::DATE) AS days_left FROM orders WHERE o_orderstatus = 'O' AND datediff('day', DATE '1997-06-01', o_orderdate::DATE) BETWEEN 0 AND 21")
def urgent_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", tx.days_until(F.col("o_orderdate"), F.expr("date '1997-06-01'")).cast("bigint").alias("days_left"))
    return o.where(F.col("days_left").between(0, 21))


@query(f"""SELECT id, CASE WHEN school_name IS NULL THEN 'no school' WHEN country IS NULL THEN 'no country' WHEN lower(trim(status)) = 'closed' THEN 'closed' WHEN len(coalesce(emails, [])) = 0 AND application_url IS NULL THEN 'no way to apply' WHEN description IS NULL THEN 'no text' END AS reason FROM {ONE_JOB}""")
def first_reason(spark, sf_dir):
    """The first failing rule wins; null is ready."""
    j = one_job(spark, sf_dir, "school_name", "country", "status", "emails", "application_url", "description")
    reason = (
        F.when(F.col("school_name").isNull(), "no school").when(F.col("country").isNull(), "no country").when(F.lower(F.trim("status")) == "closed", "closed")
        .when((F.coalesce(F.array_size("emails"), F.lit(0)) == 0) & F.col("application_url").isNull(), "no way to apply").when(F.col("description").isNull(), "no text")
    )
    return j.select("id", reason.alias("reason"))


@query("WITH a(spelled, code) AS (VALUES " + ", ".join("('{}', '{}')".format(k.replace("'", "''"), v.lower()) for k, v in COUNTRY_SPELLINGS.items()) + f") SELECT j.id, c.code FROM {ONE_JOB} j LEFT JOIN a ON lower(trim(j.country)) = spelled LEFT JOIN countries c ON coalesce(a.code, lower(trim(j.country))) IN (lower(c.code), lower(c.name)) WHERE j.country IS NULL OR c.is_on")
def country_scope(spark, sf_dir):
    """Adverts of the ticked countries under any of their names; unknown countries stay with adverts."""
    c = table(spark, sf_dir, "countries").where("is_on")
    names = c.select(F.lower("code").alias("s"), "code").union(c.select(F.lower("name"), "code"))
    j = one_job(spark, sf_dir, "country").withColumn("s", country_spelling(F.col("country")))
    return j.join(names, "s", "left").where("country is null or code is not null").select("id", "code")


@query("""WITH e AS (SELECT event_id, user_id, event_type, value FROM events WHERE event_type = 'purchase'), f AS (SELECT user_id, event_type, max(event_id) AS last FROM events WHERE event_type <> 'purchase' GROUP BY ALL)
  SELECT e.event_id, coalesce(x.last, y.last) AS matched FROM e LEFT JOIN (SELECT user_id, last FROM f WHERE event_type = 'click') x ON e.user_id = x.user_id LEFT JOIN (SELECT user_id, max(last) AS last FROM f GROUP BY 1) y ON e.user_id = y.user_id""")
def exact_else_fuzzy(spark, sf_dir):
    """By the exact key, else by the wider one: two left joins and a coalesce."""
    e = table(spark, sf_dir, "events")
    other = e.where("event_type <> 'purchase'").groupBy("user_id", "event_type").agg(F.max("event_id").alias("last"))
    exact, wide = other.where("event_type = 'click'").select("user_id", F.col("last").alias("x")), other.groupBy("user_id").agg(F.max("last").alias("y"))
    return e.where("event_type = 'purchase'").join(exact, "user_id", "left").join(wide, "user_id", "left").select("event_id", F.coalesce("x", "y").alias("matched"))


@query("""WITH a AS (SELECT school_key, lower(trim(school_email)) AS address, try_cast(json_extract_string(provenance_json, '$.schoolEmail.confidence') AS DOUBLE) AS score FROM schools WHERE school_key IS NOT NULL AND contains(school_email, '@') AND (provenance_json IS NULL OR json_valid(provenance_json)))
  SELECT school_key, address, coalesce(score, 0) AS score FROM a QUALIFY row_number() OVER (PARTITION BY school_key ORDER BY coalesce(score, 0) DESC, address) = 1""")
def overlay_rerank(spark, sf_dir):
    """The best address of each entity by its confidence, read from JSON."""
    s = table(spark, sf_dir, "schools").where(F.col("school_key").isNotNull() & F.contains("school_email", F.lit("@")))
    p = F.from_json("provenance_json", "map<string,struct<confidence:double>>")
    a = s.where(F.col("provenance_json").isNull() | p.isNotNull()).select("school_key", F.lower(F.trim("school_email")).alias("address"), F.coalesce(F.try_element_at(p, F.lit("schoolEmail"))["confidence"], F.lit(0.0)).alias("score"))
    return keyed.first_by(a, ["school_key"], [F.col("score").desc(), F.col("address")])


@query("SELECT vec_id, list_min(list_filter(embedding, lambda x: x > 0)) AS lo, list_max(embedding) AS hi FROM embeddings")
def array_extremes(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_min(F.filter("embedding", lambda x: x > 0)).alias("lo"), F.array_max("embedding").alias("hi"))


@query("SELECT event_type, arg_max(event_id, (ts, event_id)) AS newest FROM events GROUP BY 1")
def newest_per_type(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("newest"))


@query("WITH p AS (SELECT o_orderkey AS k, 1 AS probe FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 2 FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT o_orderkey, 3 FROM orders WHERE o_orderpriority LIKE '1%') SELECT k, min(probe) AS probe FROM p GROUP BY 1")
def keyed_union(spark, sf_dir):
    """Several probes of one source united; the first that has a key wins."""
    o = table(spark, sf_dir, "orders")
    probes = [o.where("o_orderstatus = 'F'"), o.where("o_totalprice > 200000"), o.where("o_orderpriority like '1%'")]
    rows = [p.select(F.col("o_orderkey").alias("k"), F.lit(i).alias("probe")) for i, p in enumerate(probes, 1)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("k").agg(F.min("probe").alias("probe"))


@query("SELECT id AS key, source, school_key, title, status, last_seen_at, closed_at FROM jobs UNION ALL SELECT job_id, source, school_key, title, status, last_seen_at, closed_at FROM job_snapshots")
def shared_columns(spark, sf_dir):
    """Two tables read by the columns that both have, whatever these are."""
    a, b = table(spark, sf_dir, "jobs").withColumnRenamed("id", "key"), table(spark, sf_dir, "job_snapshots").withColumnRenamed("job_id", "key")
    both = [c for c, kind in a.dtypes if dict(b.dtypes).get(c) == kind]
    return a.select(both).unionByName(b.select(both))


@query("""WITH m AS (SELECT s_suppkey, s_nationkey, s_acctbal, min(s_suppkey) OVER (PARTITION BY s_nationkey, (s_suppkey % 7)) AS survivor FROM supplier)
  SELECT survivor, count(*) AS folded, max(s_acctbal) FILTER (s_suppkey = survivor AND s_acctbal > 0) AS own, arg_min(s_acctbal, s_suppkey) FILTER (s_acctbal > 0) AS filled FROM m GROUP BY 1""")
def fold_into_survivor(spark, sf_dir):
    """Duplicates folded into survivors: children re-keyed by a key map, gaps of the survivor filled in key order."""
    s = table(spark, sf_dir, "supplier").withColumn("g", F.col("s_suppkey") % 7)
    key_map = s.groupBy("s_nationkey", "g").agg(F.min("s_suppkey").alias("survivor"))
    rows = s.join(key_map, ["s_nationkey", "g"]).withColumn("v", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")))
    return rows.groupBy("survivor").agg(F.count("*").alias("folded"), F.max(F.when(F.col("s_suppkey") == F.col("survivor"), F.col("v"))).alias("own"), F.min_by("v", F.when(F.col("v").isNotNull(), F.col("s_suppkey"))).alias("filled"))


@query("""WITH a AS (SELECT * FROM schools WHERE rec_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY enriched_at DESC NULLS LAST) = 1)
  SELECT rec_id, CASE WHEN len(coalesce(curriculum, [])) > 0 THEN career_email ELSE coalesce(career_email, school_email) END AS career_email FROM a""")
def conditional_overwrite(spark, sf_dir):
    """A rule that switches on whether an array holds anything; null and empty arrays don't."""
    a = keyed.first_by(table(spark, sf_dir, "schools").where("rec_id is not null"), ["rec_id"], [F.col("enriched_at").desc_nulls_last()])
    return a.select("rec_id", F.when(F.coalesce(F.array_size("curriculum"), F.lit(0)) > 0, F.col("career_email")).otherwise(F.coalesce("career_email", "school_email")).alias("career_email"))


@query("SELECT sha256(host) AS key, max(fetched_at) >= TIMESTAMPTZ '2026-01-10 00:00:00+00' AS fresh FROM documents WHERE host IS NOT NULL GROUP BY 1")
def cache_ttl(spark, sf_dir):
    """A cache keyed by a hash: entries older than their time to live are stale."""
    return table(spark, sf_dir, "documents").where("host is not null").groupBy(F.sha2(F.encode("host", "UTF-8"), 256).alias("key")).agg((F.max("fetched_at") >= F.expr("timestamp '2026-01-10 00:00:00Z'")).alias("fresh"))


@query(f"SELECT id, row_number() OVER (ORDER BY coalesce(nullif(trim(posted_at), ''), '') = '', try_cast(posted_at AS DOUBLE) NULLS LAST, posted_at, id) AS place FROM {ONE_JOB}")
def interactive_sort(spark, sf_dir):
    """Blanks last, numbers before words. Places come from a range partitioning and counts per range, not from one task."""
    j = one_job(spark, sf_dir, "posted_at")
    blank = F.coalesce(F.nullif(F.trim("posted_at"), F.lit("")), F.lit("")) == ""
    rows = j.select("id", "posted_at", blank.alias("b"), F.col("posted_at").try_cast("double").alias("n"))
    order = [F.col("b"), F.col("n").asc_nulls_last(), F.col("posted_at").asc_nulls_last(), F.col("id")]
    # Written down, so that a range is the same one wherever it is read.
    ranged = spooled(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    within = ranged.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    sizes = within.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return within.join(before, "part").select("id", (F.col("before") + F.col("r")).alias("place"))


@query("SELECT country, name, rec_id FROM schools WHERE rec_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY country ORDER BY prominence DESC NULLS LAST, name, rec_id) <= 10")
def nulls_last_top(spark, sf_dir):
    s = table(spark, sf_dir, "schools").where("rec_id is not null").select("country", "name", "rec_id", "prominence")
    w = Window.partitionBy("country").orderBy(F.col("prominence").desc_nulls_last(), F.col("name").asc_nulls_last(), "rec_id")
    return s.withColumn("_rn", F.row_number().over(w)).where("_rn <= 10").select("country", "name", "rec_id")


@query("SELECT o.o_orderkey, floor(o_totalprice * coalesce(f.usd_per_unit, 0.5) + 0.5)::BIGINT AS usd FROM orders o LEFT JOIN fx f ON f.currency = CASE o_orderstatus WHEN 'O' THEN 'EUR' WHEN 'F' THEN 'GBP' ELSE 'XXX' END")
def fx_overlay(spark, sf_dir):
    """Live rates with a fallback for what they lack."""
    cur = F.when(F.col("o_orderstatus") == "O", "EUR").when(F.col("o_orderstatus") == "F", "GBP").otherwise("XXX")
    o, fx = table(spark, sf_dir, "orders").withColumn("currency", cur), table(spark, sf_dir, "fx")
    return o.join(fx, "currency", "left").select("o_orderkey", F.floor(F.col("o_totalprice") * F.coalesce("usd_per_unit", F.lit(0.5)) + 0.5).alias("usd"))


@query("SELECT DISTINCT job_id FROM job_snapshots s WHERE EXISTS (SELECT 1 FROM jobs j WHERE j.id = s.job_id AND j.my_status IS NULL) AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.id = s.job_id AND lower(trim(j.status)) = 'closed')")
def to_confirm(spark, sf_dir):
    s, j = table(spark, sf_dir, "job_snapshots").select("job_id").distinct(), table(spark, sf_dir, "jobs").withColumnRenamed("id", "job_id")
    return s.join(j.where("my_status is null"), "job_id", "left_semi").join(j.where("lower(trim(status)) = 'closed'"), "job_id", "left_anti")
