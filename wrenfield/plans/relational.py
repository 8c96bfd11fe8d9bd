"""Queries of joins, aggregations, ranks, orders and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrenfield.operators import keyed
from wrenfield.session import table

AS_OF = "timestamp '2026-01-15 00:00:00'"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: One row an advert, the last checked; deliveries of one id are the same otherwise.
ONE_JOB = "(SELECT * FROM jobs WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_checked_at DESC NULLS LAST) = 1)"
ONE_SCHOOL = "(SELECT * FROM schools WHERE rec_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY school_key ORDER BY enriched_at DESC NULLS LAST, rec_id) = 1)"


def one_job(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    jobs = table(spark, sf_dir, "jobs").where("id is not null").select("id", "last_checked_at", *[c for c in columns if c not in ("id", "last_checked_at")])
    return keyed.first_by(jobs, ["id"], [F.col("last_checked_at").desc_nulls_last()])


def one_school(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    schools = table(spark, sf_dir, "schools").where("rec_id is not null").select("rec_id", "school_key", "enriched_at", *columns)
    return keyed.first_by(schools, ["school_key"], [F.col("enriched_at").desc_nulls_last(), F.col("rec_id")])


@query("SELECT o_orderkey, o_totalprice, coalesce(c_name, '') AS customer, coalesce(n_name, '') AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'O' AND o_totalprice >= 100000")
def entity_export(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O' and o_totalprice >= 100000")
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rows = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left")
    return rows.select("o_orderkey", "o_totalprice", F.coalesce("c_name", F.lit("")).alias("customer"), F.coalesce("n_name", F.lit("")).alias("nation"))


@query(f"SELECT j.id, coalesce(s.name, j.school_name, '') AS school, coalesce(s.country, j.country, '') AS country, coalesce(s.city, j.city, '') AS city, coalesce(s.website, j.school_website, '') AS website FROM {ONE_JOB} j LEFT JOIN {ONE_SCHOOL} s ON j.school_key = s.school_key")
def advert_export(spark, sf_dir):
    """School value, else advert value, else empty: the common pattern of the registered columns."""
    j = one_job(spark, sf_dir, "school_key", "school_name", "country", "city", "school_website")
    s = one_school(spark, sf_dir, "name", "country", "city", "website").select("school_key", "name", F.col("country").alias("s_country"), F.col("city").alias("s_city"), "website")
    first = lambda *c: F.coalesce(*c, F.lit(""))
    return j.join(s, "school_key", "left").select("id", first("name", "school_name").alias("school"), first("s_country", "country").alias("country"), first("s_city", "city").alias("city"), first("website", "school_website").alias("website"))


@query(f"SELECT id, pe_score, pe_seniority FROM {ONE_JOB} WHERE is_pe AND lower(trim(status)) IN ('open', 'stale') AND pe_score >= 40 AND last_seen_at >= TIMESTAMPTZ '2025-10-01 00:00:00+00' AND (contains(lower(country), 'emirates') OR contains(lower(country), 'china')) AND pe_seniority IN ('teacher', 'head', 'director', 'lead')")
def dynamic_filter(spark, sf_dir):
    j = one_job(spark, sf_dir, "is_pe", "status", "pe_score", "pe_seniority", "last_seen_at", "country")
    country = F.lower("country")
    return j.where(
        F.col("is_pe") & F.lower(F.trim("status")).isin("open", "stale") & (F.col("pe_score") >= 40) & (F.col("last_seen_at") >= F.expr("timestamp '2025-10-01 00:00:00Z'"))
        & (country.contains("emirates") | country.contains("china")) & F.col("pe_seniority").isin("teacher", "head", "director", "lead")
    ).select("id", "pe_score", "pe_seniority")


@query(f"""WITH js AS (SELECT school_key, max(pe_score) AS score FROM {ONE_JOB} WHERE school_key IS NOT NULL AND lower(trim(status)) = 'open' GROUP BY 1),
  tiers AS (SELECT j.school_key, 0 AS tier, j.score FROM js j LEFT JOIN {ONE_SCHOOL} s ON j.school_key = s.school_key WHERE s.enriched_at IS NULL OR s.enriched_at < TIMESTAMPTZ '2025-10-15 00:00:00+00'
    UNION ALL SELECT s.school_key, 1, 0 FROM {ONE_SCHOOL} s WHERE s.enriched_at < TIMESTAMPTZ '2025-10-15 00:00:00+00' AND NOT EXISTS (SELECT 1 FROM js WHERE js.school_key = s.school_key))
  SELECT school_key, tier, score, row_number() OVER (ORDER BY tier, score DESC NULLS LAST, school_key) AS place FROM tiers ORDER BY place LIMIT 500""")
def enrichment_queue(spark, sf_dir):
    """Entities to enrich: with an open advert first; the limit of a batch comes after the sort."""
    js = one_job(spark, sf_dir, "school_key", "status", "pe_score").where("school_key is not null and lower(trim(status)) = 'open'").groupBy("school_key").agg(F.max("pe_score").alias("score"))
    s = one_school(spark, sf_dir)
    stale = F.col("enriched_at") < F.expr("timestamp '2025-10-15 00:00:00Z'")
    hiring = js.join(s, "school_key", "left").where(F.col("enriched_at").isNull() | stale).select("school_key", F.lit(0).alias("tier"), "score")
    other = s.where(stale).join(js, "school_key", "left_anti").select("school_key", F.lit(1).alias("tier"), F.lit(0).alias("score"))
    batch = hiring.unionByName(other).orderBy("tier", F.col("score").desc_nulls_last(), "school_key").limit(500)
    return batch.withColumn("place", F.row_number().over(Window.orderBy("tier", F.col("score").desc_nulls_last(), "school_key")).cast("bigint"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS hiring FROM customer")
def exists_flag(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("_x", F.lit(True))
    return table(spark, sf_dir, "customer").join(keys, "c_custkey", "left").select("c_custkey", F.col("_x").isNotNull().alias("hiring"))


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '2000-06-01')")
def unsighted_anti(spark, sf_dir):
    seen = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz '2000-06-01'").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return table(spark, sf_dir, "part").join(seen, "p_partkey", "left_anti").select("p_partkey", "p_name")


@query("SELECT DISTINCT e.user_id FROM events e WHERE e.user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'error' AND f.ts > (SELECT max(ts) FROM events) - INTERVAL 10 DAY)")
def attempt_cooldown(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cut = e.agg((F.max("ts") - F.expr("interval 10 days")).alias("cut")).scalar()
    recent = e.where("event_type = 'error'").where(F.col("ts") > cut).select("user_id")
    return e.where("user_id is not null").select("user_id").distinct().join(recent, "user_id", "left_anti")


@query("SELECT c_custkey, coalesce((SELECT string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) FROM orders WHERE o_custkey = c_custkey), '') AS orders, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
def cogroup_entity(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("x"), F.count("*").alias("n"))
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left")
    return joined.select("c_custkey", F.coalesce(F.array_join(F.transform("x", lambda r: r["o_orderkey"].cast("string")), ","), F.lit("")).alias("orders"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH a AS (SELECT DISTINCT rec_id, school_key, lower(trim(unnest([school_email, career_email]))) AS address FROM schools),
  e AS (SELECT DISTINCT lower(trim(unnest(emails))) AS address FROM jobs)
  SELECT a.address, count(DISTINCT a.school_key) AS schools, min(a.school_key) AS first_school FROM a JOIN e ON a.address = e.address WHERE a.address <> '' GROUP BY 1""")
def membership_join(spark, sf_dir):
    """Which entities hold an address, by an exploded equi-join."""
    clean = lambda c: F.lower(F.trim(c, F.lit(" ")))
    a = table(spark, sf_dir, "schools").select("school_key", F.explode(F.array("school_email", "career_email")).alias("raw")).select("school_key", clean(F.col("raw")).alias("address")).where("address <> ''")
    e = table(spark, sf_dir, "jobs").select(F.explode("emails").alias("raw")).select(clean(F.col("raw")).alias("address")).distinct()
    return a.join(e, "address").groupBy("address").agg(F.count_distinct("school_key").alias("schools"), F.min("school_key").alias("first_school"))


@query(f"SELECT school_key, max(school_name) AS name, max(country) AS country, max(city) AS city, max(school_website) AS website, max(pe_score) AS pe_score FROM {ONE_JOB} WHERE school_key IS NOT NULL GROUP BY 1")
def lexical_max(spark, sf_dir):
    j = one_job(spark, sf_dir, "school_key", "school_name", "country", "city", "school_website", "pe_score").where("school_key is not null")
    return j.groupBy("school_key").agg(F.max("school_name").alias("name"), F.max("country").alias("country"), F.max("city").alias("city"), F.max("school_website").alias("website"), F.max("pe_score").alias("pe_score"))


@query("""SELECT school_key, count(DISTINCT id) AS postings, floor(epoch(min(first_seen_at)))::BIGINT AS first_seen, round((1768435200 - floor(epoch(min(first_seen_at)))) / (30.44 * 86400), 6) AS months,
  CASE WHEN (1768435200 - floor(epoch(min(first_seen_at)))) / (30.44 * 86400) < 6 THEN 'watching' WHEN count(DISTINCT id) * 12 / ((1768435200 - floor(epoch(min(first_seen_at)))) / (30.44 * 86400)) >= 3 THEN 'High'
    WHEN count(DISTINCT id) * 12 / ((1768435200 - floor(epoch(min(first_seen_at)))) / (30.44 * 86400)) >= 1.5 THEN 'Moderate' ELSE 'Low' END AS turnover
  FROM jobs WHERE school_key IS NOT NULL AND first_seen_at IS NOT NULL GROUP BY 1""")
def hiring_history(spark, sf_dir):
    j = table(spark, sf_dir, "jobs").where("school_key is not null and first_seen_at is not null")
    g = j.groupBy("school_key").agg(F.count_distinct("id").alias("postings"), F.unix_seconds(F.min("first_seen_at")).alias("first_seen"))
    g = g.withColumn("m", (F.lit(1768435200) - F.col("first_seen")) / (30.44 * 86400)).withColumn("rate", F.col("postings") * 12 / F.try_divide("m", F.lit(1)))
    label = F.when(F.col("m") < 6, "watching").when(F.col("rate") >= 3, "High").when(F.col("rate") >= 1.5, "Moderate").otherwise("Low")
    return g.select("school_key", "postings", "first_seen", F.round("m", 6).alias("months"), label.alias("turnover"))


@query(f"SELECT coalesce(my_status, 'none') AS my_status, count(*) AS n FROM {ONE_JOB} GROUP BY 1")
def pipeline_counts(spark, sf_dir):
    return one_job(spark, sf_dir, "my_status").groupBy(F.coalesce("my_status", F.lit("none")).alias("my_status")).agg(F.count("*").alias("n"))


@query(f"""SELECT count(*) AS total, count(*) FILTER (lower(trim(status)) = 'open') AS open, count(*) FILTER (lower(trim(status)) = 'stale') AS stale, count(*) FILTER (lower(trim(status)) = 'closed') AS closed, count(*) FILTER (is_pe) AS pe,
  count(*) FILTER (my_status IS NOT NULL) AS marked, count(DISTINCT school_key) AS schools, count(DISTINCT source) AS sources, count(*) FILTER (quick_apply) AS quick, count(*) FILTER (quick_apply IS NULL) AS quick_unknown FROM {ONE_JOB}""")
def scoreboard(spark, sf_dir):
    j = one_job(spark, sf_dir, "status", "is_pe", "my_status", "school_key", "source", "quick_apply")
    s = F.lower(F.trim("status"))
    return j.agg(
        F.count("*").alias("total"), F.count_if(s == "open").alias("open"), F.count_if(s == "stale").alias("stale"), F.count_if(s == "closed").alias("closed"), F.count_if("is_pe").alias("pe"), F.count("my_status").alias("marked"),
        F.count_distinct("school_key").alias("schools"), F.count_distinct("source").alias("sources"), F.count_if("quick_apply").alias("quick"), F.count_if(F.col("quick_apply").isNull()).alias("quick_unknown"),
    )


@query(f"""WITH o AS (SELECT *, coalesce(deadline_at, '9999') AS due FROM {ONE_JOB} WHERE school_key IS NOT NULL AND lower(trim(status)) = 'open' AND title IS NOT NULL)
  SELECT school_key, count(*) AS roles, string_agg(title, '; ' ORDER BY due, id) AS titles, arg_min(url, (due, id)) AS first_url, min(deadline_at) AS soonest, coalesce(min(app_form) FILTER (app_form IN ('online', 'pdf', 'word')), min(app_form)) AS form FROM o GROUP BY 1""")
def open_roles(spark, sf_dir):
    """The ordered fold of an entity's open adverts: titles by deadline (as written, missing ones last), the soonest deadline, and
    a form that can be filled in before none. The list of titles is the report itself, one row an entity."""
    j = one_job(spark, sf_dir, "school_key", "status", "title", "url", "app_form", "deadline_at").where("school_key is not null and lower(trim(status)) = 'open' and title is not null")
    j = j.withColumn("due", F.coalesce("deadline_at", F.lit("9999")))
    g = j.groupBy("school_key").agg(
        F.count("*").alias("roles"), F.array_sort(F.collect_list(F.struct("due", "id", "title"))).alias("x"), F.min_by("url", F.struct("due", "id")).alias("first_url"), F.min("deadline_at").alias("soonest"),
        F.coalesce(F.min(F.when(F.col("app_form").isin("online", "pdf", "word"), F.col("app_form"))), F.min("app_form")).alias("form"),
    )
    return g.select("school_key", "roles", F.array_join(F.transform("x", lambda r: r["title"]), "; ").alias("titles"), "first_url", "soonest", "form")


@query("""WITH g AS (SELECT c_nationkey, o_orderpriority, o_orderstatus, count(*) AS samples, avg(o_totalprice) AS price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
  SELECT c_nationkey, o_orderpriority, o_orderstatus, samples, round(price, 2) AS price FROM g QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY samples DESC, o_orderpriority, o_orderstatus) = 1""")
def like_with_like_mean(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).select("c_nationkey", "o_orderpriority", "o_orderstatus", F.col("o_totalprice").alias("price"))
    return keyed.commonest_unit(rows, ["c_nationkey"], ["o_orderpriority", "o_orderstatus"], ["price"]).withColumn("price", F.round("price", 2))


@query("""WITH g AS (SELECT l_partkey % 50 AS part_group, l_returnflag, l_linestatus, count(DISTINCT l_suppkey) AS entities, count(DISTINCT (l_quantity, l_extendedprice)) AS pairs, count(*) AS samples, avg(l_quantity) AS low, avg(l_extendedprice) AS high FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) >= 3 AND count(DISTINCT (l_quantity, l_extendedprice)) >= 2)
  SELECT part_group, l_returnflag, l_linestatus, entities, pairs, samples, round(low, 4) AS low, round(high, 2) AS high FROM g QUALIFY row_number() OVER (PARTITION BY part_group ORDER BY entities DESC, samples DESC, l_returnflag, l_linestatus) = 1""")
def market_benchmark(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("part_group"), "l_returnflag", "l_linestatus", "l_suppkey", F.col("l_quantity").alias("low"), F.col("l_extendedprice").alias("high"))  # noqa: E741
    return keyed.benchmark(l, ["part_group"], ["l_returnflag", "l_linestatus"], "l_suppkey", "low", "high").withColumns({"low": F.round("low", 4), "high": F.round("high", 2)})


@query("SELECT text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def repeated_values(spark, sf_dir):
    return keyed.repeated(table(spark, sf_dir, "documents").where("text is not null"), ["text"])


@query("WITH r AS (SELECT DISTINCT school_key, lower(trim(website)) AS site FROM schools WHERE website IS NOT NULL AND school_key IS NOT NULL) SELECT school_key, site FROM r QUALIFY count(*) OVER (PARTITION BY site) = 1")
def collision_drop(spark, sf_dir):
    r = table(spark, sf_dir, "schools").where("website is not null and school_key is not null").select("school_key", F.lower(F.trim("website")).alias("site")).distinct()
    return keyed.without_collisions(r, "school_key", "site").select("school_key", "site")


@query("SELECT c_mktsegment, count(DISTINCT c_nationkey) AS nations, CASE WHEN count(DISTINCT c_nationkey) = 1 THEN max(c_nationkey) END AS common FROM customer GROUP BY 1")
def common_value(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count_distinct("c_nationkey").alias("nations"), keyed.common_or_null("c_nationkey").alias("common"))


@query("""WITH r AS (SELECT s_nationkey, s_suppkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
  SELECT s_nationkey, s_suppkey, rank, round(rank / n, 6) AS share, rank = 1 AS first FROM r""")
def rank_share(spark, sf_dir):
    w = Window.partitionBy("s_nationkey")
    r = table(spark, sf_dir, "supplier").withColumn("rank", F.row_number().over(w.orderBy(F.col("s_acctbal").desc(), "s_suppkey"))).withColumn("n", F.count("*").over(w))
    return r.select("s_nationkey", "s_suppkey", F.col("rank").cast("bigint").alias("rank"), F.round(F.col("rank") / F.col("n"), 6).alias("share"), (F.col("rank") == 1).alias("first"))


@query("""WITH a AS (SELECT school_key, lower(trim(unnest([school_email, career_email]))) AS address, unnest([1, 0]) AS tier, prominence FROM schools)
  SELECT address, string_agg(DISTINCT school_key, ',' ORDER BY school_key) AS schools, min(tier) AS tier, max(prominence) AS prominence FROM a WHERE address <> '' AND school_key IS NOT NULL GROUP BY 1""")
def recipient_group(spark, sf_dir):
    a = table(spark, sf_dir, "schools").where("school_key is not null").select("school_key", "prominence", F.explode(F.array(F.struct(F.col("school_email").alias("raw"), F.lit(1).alias("tier")), F.struct(F.col("career_email").alias("raw"), F.lit(0).alias("tier")))).alias("x"))
    a = a.select("school_key", "prominence", F.lower(F.trim("x.raw")).alias("address"), "x.tier").where("address <> ''")
    one = a.groupBy("address", "school_key").agg(F.min("tier").alias("tier"), F.max("prominence").alias("prominence"))
    return one.groupBy("address").agg(F.array_join(F.array_sort(F.collect_list("school_key")), ",").alias("schools"), F.min("tier").alias("tier"), F.max("prominence").alias("prominence"))


GROUPS = [("eco", "(?i)ECONOMY"), ("promo", "(?i)PROMO"), ("size", "(?i)SMALL|LARGE")]


@query("""WITH g AS (SELECT p_brand, p_size, CASE WHEN regexp_matches(p_type, 'ECONOMY', 'i') THEN 'eco' WHEN regexp_matches(p_type, 'PROMO', 'i') THEN 'promo' WHEN regexp_matches(p_type, 'SMALL|LARGE', 'i') THEN 'size' END AS owner FROM part)
  SELECT owner, count(*) AS n, count(*) FILTER (p_size <= 20) AS top20, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM g WHERE owner IS NOT NULL GROUP BY 1""")
def group_rollup(spark, sf_dir):
    """First pattern wins, then a rollup by owner."""
    owner = None
    for name, pattern in GROUPS:
        hit = F.col("p_type").rlike(pattern)
        owner = F.when(hit, name) if owner is None else owner.when(hit, name)
    p = table(spark, sf_dir, "part").withColumn("owner", owner).where("owner is not null")
    return p.groupBy("owner").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") <= 20).alias("top20"), F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf_dir):
    return keyed.first_by(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id, event_id, value FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def best_per_key(spark, sf_dir):
    return keyed.first_by(table(spark, sf_dir, "events").where("value is not null"), ["user_id"], [F.col("value").desc(), F.col("event_id")]).select("user_id", "event_id", "value")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def first_per_key(spark, sf_dir):
    return keyed.first_by(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


@query("WITH r AS (SELECT r_name, (r_regionkey + 1) * 3 AS quota, n_nationkey FROM region JOIN nation ON r_regionkey = n_regionkey), s AS (SELECT r_name, quota, s_suppkey, s_acctbal FROM r JOIN supplier ON s_nationkey = n_nationkey) SELECT r_name, s_suppkey FROM s QUALIFY row_number() OVER (PARTITION BY r_name ORDER BY s_acctbal DESC, s_suppkey) <= quota")
def top_quota(spark, sf_dir):
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    rows = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("r_name", "s_suppkey", "s_acctbal")
    quotas = r.select("r_name", ((F.col("r_regionkey") + 1) * 3).alias("quota"))
    return keyed.top_quota(rows, "r_name", [F.col("s_acctbal").desc(), F.col("s_suppkey")], quotas, "quota").select("r_name", "s_suppkey")


@query("SELECT s_nationkey, s_suppkey FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) <= greatest(1, ceil(count(*) OVER (PARTITION BY s_nationkey) * 0.2))")
def top_share(spark, sf_dir):
    return keyed.top_share(table(spark, sf_dir, "supplier"), ["s_nationkey"], [F.col("s_acctbal").desc(), F.col("s_suppkey")], 0.2).select("s_nationkey", "s_suppkey")


@query("SELECT lang, list_sort(list(n_chars))[least(count(n_chars) - 1, floor(count(n_chars) * 0.9)::BIGINT) + 1] AS p90 FROM documents WHERE n_chars IS NOT NULL GROUP BY 1")
def nearest_rank_p90(spark, sf_dir):
    return keyed.nearest_rank(table(spark, sf_dir, "documents"), ["lang"], "n_chars", 0.9, "p90")


@query("""WITH u AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY ALL HAVING count(*) >= 2 AND max(c_acctbal) > min(c_acctbal)),
  m AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1)
  SELECT c_custkey, round((c_acctbal - lo) / (hi - lo) * 100, 4) AS score FROM customer c LEFT JOIN m ON c.c_nationkey = m.c_nationkey AND c.c_mktsegment = m.c_mktsegment""")
def scaled_in_unit(spark, sf_dir):
    return keyed.scaled_in_largest_unit(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", "c_acctbal", "score").select("c_custkey", F.round("score", 4).alias("score"))


@query(f"""WITH j AS (SELECT DISTINCT school_key, school_name FROM {ONE_JOB} WHERE school_name IS NOT NULL), s AS (SELECT DISTINCT school_key AS target, lower(trim(name)) AS name FROM schools WHERE school_key IS NOT NULL AND trim(name) <> ''),
  m AS (SELECT j.school_name AS key, target, 1 AS level FROM j JOIN s ON j.school_key = s.target UNION SELECT school_name, target, 2 FROM j JOIN s ON lower(trim(school_name)) = name
    UNION SELECT school_name, target, 3 FROM j JOIN s ON regexp_extract(name, '[a-z0-9]+') <> '' AND list_contains(regexp_extract_all(lower(school_name), '[a-z0-9]+'), regexp_extract(name, '[a-z0-9]+')) AND contains(' ' || array_to_string(regexp_extract_all(lower(school_name), '[a-z0-9]+'), ' ') || ' ', ' ' || array_to_string(regexp_extract_all(name, '[a-z0-9]+'), ' ') || ' ')),
  g AS (SELECT key, level, count(DISTINCT target) AS n, min(target) AS target FROM m GROUP BY key, level), h AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY key ORDER BY level) = 1)
  SELECT key, target, level FROM h WHERE n = 1""")
def lookup_ladder(spark, sf_dir):
    """The record that a written school name means: by key, by exact name, then by a record's whole name as words within it. The
    first rung that has any decides, if it has but one. Words meet by the first of a record's name."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))
    j = one_job(spark, sf_dir, "school_key", "school_name").where("school_name is not null").select(F.col("school_name").alias("key"), "school_key").distinct()
    s = table(spark, sf_dir, "schools").where("school_key is not null and trim(name) <> ''").select(F.col("school_key").alias("target"), F.lower(F.trim("name", F.lit(" "))).alias("name")).distinct()
    by_key = j.join(s, F.col("school_key") == F.col("target")).select("key", "target")
    by_name = j.join(s, F.lower(F.trim("key", F.lit(" "))) == F.col("name")).select("key", "target")
    padded = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    asked = j.select("key", padded(words(F.col("key"))).alias("hay"), F.explode(F.array_distinct(words(F.col("key")))).alias("word"))
    held = s.select("target", padded(words(F.col("name"))).alias("needle"), F.try_element_at(words(F.col("name")), F.lit(1)).alias("word"))
    by_words = asked.join(held, "word").where("contains(hay, needle)").select("key", "target")
    return keyed.laddered(j.select("key").distinct(), "key", [by_key, by_name, by_words])


@query("SELECT j.job_id, count(*) AS mentions, count(j2.id) = 0 AS unknown FROM job_snapshots j LEFT JOIN (SELECT DISTINCT id FROM jobs) j2 ON j.job_id = j2.id GROUP BY 1")
def id_lookup_unmatched(spark, sf_dir):
    known = table(spark, sf_dir, "jobs").select(F.col("id").alias("job_id"), F.lit(1).alias("hit")).distinct()
    g = table(spark, sf_dir, "job_snapshots").groupBy("job_id").agg(F.count("*").alias("mentions"))
    return g.join(known, "job_id", "left").select("job_id", "mentions", F.col("hit").isNull().alias("unknown"))


@query("SELECT event_id FROM events WHERE ts < (SELECT min(ts) + INTERVAL 15 DAY FROM events) EXCEPT SELECT event_id FROM events WHERE event_type = 'error'")
def set_difference(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cut = e.agg((F.min("ts") + F.expr("interval 15 days")).alias("cut")).scalar()
    early = e.where(F.col("ts") < cut).select("event_id").distinct()
    return early.join(e.where("event_type = 'error'"), "event_id", "left_anti")


@query("SELECT l_orderkey, list_aggregate(list_sort(list_distinct(list(l_shipmode_like))), 'string_agg', ',') AS flags FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS l_shipmode_like FROM lineitem) GROUP BY 1")
def array_union(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))), ",").alias("flags"))


@query(f"""WITH u AS (SELECT j.id, list_concat(coalesce(j.curriculum, []), coalesce(s.curriculum, [])) AS every FROM {ONE_JOB} j LEFT JOIN {ONE_SCHOOL} s ON j.school_key = s.school_key)
  SELECT id, array_to_string(list_transform(list_filter(range(1, len(every) + 1), lambda i: list_position(every, every[i]) = i), lambda i: every[i]), ', ') AS curriculum FROM u""")
def ordered_union(spark, sf_dir):
    """Arrays of advert and school united in their order, each value once."""
    s = one_school(spark, sf_dir, "curriculum").where("school_key is not null").select("school_key", F.col("curriculum").alias("more"))
    none = F.array().cast("array<string>")
    j = one_job(spark, sf_dir, "school_key", "curriculum").join(s, "school_key", "left")
    return j.select("id", F.array_join(F.array_distinct(F.concat(F.coalesce("curriculum", none), F.coalesce("more", none))), ", ").alias("curriculum"))


@query("SELECT o_orderkey, o_totalprice, o_orderdate::DATE::VARCHAR AS day FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(F.from_json("props", "map<string,string>"), F.lit("k")).try_cast("bigint").alias("k"))


@query("WITH t AS (SELECT event_id, ts >= max(ts) OVER () - INTERVAL 2 DAY AS fresh FROM events), s AS (SELECT avg(fresh::INT) < 0.4 AS shown FROM t) SELECT event_id, fresh AND shown AS badge FROM t, s")
def share_gated_flag(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    newest = e.agg((F.max("ts") - F.expr("interval 2 days")).alias("cut")).scalar()
    fresh = e.select("event_id", (F.col("ts") >= newest).alias("fresh"))
    shown = fresh.agg((F.avg(F.col("fresh").cast("int")) < 0.4).alias("shown")).scalar()
    return fresh.select("event_id", (F.col("fresh") & shown).alias("badge"))


@query("SELECT source, to_json(struct_pack(total := count(*), pe := count(*) FILTER (is_pe)))::VARCHAR AS stats FROM jobs GROUP BY 1")
def run_summary(spark, sf_dir):
    return table(spark, sf_dir, "jobs").groupBy("source").agg(F.to_json(F.struct(F.count("*").alias("total"), F.count_if("is_pe").alias("pe"))).alias("stats"))


@query("SELECT source, sum(n_chars)::BIGINT AS chars, count(*) AS docs FROM documents GROUP BY 1")
def quota_sum(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("docs"))
