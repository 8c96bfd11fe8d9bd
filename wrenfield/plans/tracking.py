"""Queries of recipients, filters, orders and writes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrenfield.functions import text as tx
from wrenfield.functions.addresses import host_of, mail_host_of
from wrenfield.operators import contact, keyed, state, tracking
from wrenfield.plans.relational import ONE_JOB, ONE_SCHOOL, one_job, one_school
from wrenfield.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
AS_OF = "timestamp '2026-01-15 00:00:00Z'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _plain(c: str):
    return F.lower(F.trim(F.col(c), F.lit(" ")))


# -- filters ------------------------------------------------------------------------------------------------------------------


@query(f"""WITH r AS (SELECT s.*, row_number() OVER (PARTITION BY country ORDER BY prominence DESC NULLS LAST, school_key) AS rank FROM {ONE_SCHOOL} s WHERE country IS NOT NULL AND school_key IS NOT NULL)
  SELECT school_key, r.country, rank FROM r WHERE rank <= 20 AND coalesce(trim(career_email), '') = '' AND coalesce(trim(careers_url), '') = '' AND (lower(r.country) IN (SELECT lower(name) FROM countries WHERE is_on) OR lower(r.country) IN (SELECT lower(code) FROM countries WHERE is_on))""")
def needs_a_human(spark, sf_dir):
    """Well-placed schools of the ticked countries without any way to apply (a report of the first 20 of a country)."""
    s = one_school(spark, sf_dir, "country", "prominence", "career_email", "careers_url").where("country is not null and school_key is not null")
    w = Window.partitionBy("country").orderBy(F.col("prominence").desc_nulls_last(), "school_key")
    top = s.withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 20")
    c = table(spark, sf_dir, "countries").where("is_on")
    scope = c.select(F.lower("name").alias("_c")).union(c.select(F.lower("code"))).distinct()
    bare = top.where((F.coalesce(_plain("career_email"), F.lit("")) == "") & (F.coalesce(_plain("careers_url"), F.lit("")) == ""))
    return bare.join(scope, F.lower("country") == F.col("_c"), "left_semi").select("school_key", "country", "rank")


#: The shapes that a term of contract may have.
TERM = "^[0-9]+ (year|years|months)( renewable)?$"


@query(f"""WITH j AS (SELECT id, contract_term, school_key FROM {ONE_JOB}), t AS (SELECT id, CASE WHEN regexp_matches(trim(contract_term), '^[0-9]+ (year|years|months)( renewable)?$') THEN trim(contract_term) END AS term FROM j)
  SELECT id, term FROM t WHERE term IS NOT NULL""")
def trusted_text(spark, sf_dir):
    """A stored text is repeated only if it has one of the shapes that it may have; anything else counts as missing."""
    term = F.trim("contract_term")
    return one_job(spark, sf_dir, "contract_term").select("id", F.when(term.rlike(TERM), term).alias("term")).where("term is not null")


@query(r"""WITH u AS (SELECT DISTINCT rec_id, website, regexp_replace(lower(trim(website)), '^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@\s]*@)?(?:www\.)?([^/?#:\s]*).*$', '\1') AS host FROM schools WHERE rec_id IS NOT NULL AND website IS NOT NULL)
  SELECT rec_id, website FROM u WHERE regexp_full_match(host, '[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+')
    AND NOT regexp_matches(host, '(^|\.)(""" + "|".join(h.replace(".", r"\.") for h in [*contact.NEVER_READ, "hirewell.example", "edustaffing.example"]) + r""")$')""")
def readable_sites(spark, sf_dir):
    """Sites that may be read: real hosts that are neither social networks nor boards."""
    u = table(spark, sf_dir, "schools").where("rec_id is not null and website is not null").select("rec_id", "website").distinct()
    denied = [*contact.NEVER_READ, "hirewell.example", "edustaffing.example"]
    return u.where(host_of(F.col("website")).isNotNull() & ~contact.on_hosts(F.col("website"), denied))


@query(f"""SELECT id, title FROM {ONE_JOB} WHERE contains(lower(concat_ws(' ', title, school_name, city, country)), 'swim') AND coalesce(pe_seniority, '') IN ('head_of_department', 'director_of_sport', 'coordinator', 'second_in_department')
  AND coalesce(my_status, '') NOT IN ('applied', 'skipped')""")
def report_filter(spark, sf_dir, needle: str = "swim", lead_only: bool = True, view: str = "open"):
    """What a reader of the report sees: rows with the text, leaders only, and of the marks applied, skipped or neither."""
    j = one_job(spark, sf_dir, "title", "school_name", "city", "country", "pe_seniority", "my_status")
    text = F.lower(F.concat_ws(" ", "title", "school_name", "city", "country")).contains(needle.lower())
    lead = F.coalesce(F.col("pe_seniority").isin("head_of_department", "director_of_sport", "coordinator", "second_in_department"), F.lit(False)) if lead_only else F.lit(True)
    mark = F.coalesce("my_status", F.lit(""))
    seen = mark == view if view in ("applied", "skipped") else ~mark.isin("applied", "skipped")
    return j.where(text & lead & seen).select("id", "title")


@query("""WITH c AS (SELECT o_orderpriority AS source, date_trunc('month', o_orderdate)::DATE AS run, count(*) AS raw, bool_or(o_totalprice > 440000) AS failed FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY run DESC) AS rn FROM c),
  h AS (SELECT source, max(raw) FILTER (rn = 1) AS raw, bool_or(failed) FILTER (rn = 1) AS bad, count(raw) FILTER (rn BETWEEN 2 AND 11 AND NOT failed) AS n, median(raw) FILTER (rn BETWEEN 2 AND 11 AND NOT failed) AS usual FROM r GROUP BY 1),
  s AS (SELECT source, CASE WHEN bad THEN 'failed' WHEN n < 3 THEN 'new' WHEN usual >= 5 AND raw = 0 THEN 'empty' WHEN usual >= 5 AND raw < 0.4 * usual THEN 'low' ELSE 'ok' END AS status, raw, usual FROM h) SELECT * FROM s WHERE status IN ('failed', 'empty', 'low')""")
def source_problems(spark, sf_dir):
    """Sources whose latest run failed, gave nothing or far less than usual; failed runs don't count for what is usual."""
    runs = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("source"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("run")).agg(F.count("*").alias("raw"), F.max(F.col("o_totalprice") > 440000).alias("failed"))
    return state.health(runs, "source", "run", "raw", "failed").where(F.col("status").isin("failed", "empty", "low"))


ROLE_WORDS = "teacher|head of|director of|coordinator|instructor|coach|leader|specialist|vacancy|position"


@query(rf"""WITH l AS (SELECT doc_id, trim(unnest(string_split(replace(text, chr(13), ''), chr(10)))) AS line FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, line, count(*) AS n FROM l WHERE length(line) BETWEEN 6 AND 160 AND regexp_matches(lower(line), '({ROLE_WORDS})') AND NOT regexp_matches(line, '[.!?]$') AND NOT regexp_matches(lower(line), 'unsubscribe|privacy|/login|/account|facebook\.com')
    AND regexp_matches(lower(line), 'physical education|sport|swim|coach|games|athletics|\bpe\b') GROUP BY ALL""")
def role_lines(spark, sf_dir):
    """Lines of a text that are shaped as a role: a role's word, no sentence, no link of the frame, and of the subject."""
    blank = r"^[ ]+|[ ]+$"
    lines = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.explode(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n")).alias("line")).withColumn("line", F.regexp_replace("line", blank, ""))
    low = F.lower("line")
    shaped = F.char_length("line").between(6, 160) & low.rlike(f"({ROLE_WORDS})") & ~F.col("line").rlike("[.!?]$") & ~low.rlike(r"unsubscribe|privacy|/login|/account|facebook\.com")
    return lines.where(shaped & low.rlike(r"physical education|sport|swim|coach|games|athletics|\bpe\b")).groupBy("doc_id", "line").agg(F.count("*").alias("n"))


# -- joins and aggregations of recipients ---------------------------------------------------------------------------------------

REGISTERED = r"CASE WHEN len(string_split({0}, '.')) >= 3 AND length(string_split({0}, '.')[-2]) <= 3 THEN array_to_string(string_split({0}, '.')[-3:], '.') ELSE array_to_string(string_split({0}, '.')[-2:], '.') END"
MAIL = r"regexp_full_match({0}, '[a-z0-9._%+''-]+@[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)*\.[a-z]{{2,}}')"
SITE = r"regexp_replace(lower(trim({0})), '^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@\s]*@)?(?:www\.)?([^/?#:\s]*).*$', '\1')"
IS_HOST = r"regexp_full_match({0}, '[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+')"


@query(rf"""WITH a AS (SELECT DISTINCT rec_id, {SITE.format('website')} AS site, lower(trim(career_email)) AS mail FROM schools WHERE rec_id IS NOT NULL), b AS (SELECT *, string_split(mail, '@')[2] AS mh FROM a WHERE {IS_HOST.format('site')} AND {MAIL.format('mail')}),
  r AS (SELECT *, {REGISTERED.format('site')} AS rs, {REGISTERED.format('mh')} AS rm FROM b)
  SELECT rec_id, site, mh AS mail_host, rs = rm OR ends_with(site, '.' || rm) OR ends_with(mh, '.' || rs) AS own FROM r""")
def own_domain(spark, sf_dir):
    """If a careers address is of the site's owner."""
    a = table(spark, sf_dir, "schools").where("rec_id is not null").select("rec_id", host_of(F.col("website")).alias("site"), F.nullif(mail_host_of(F.col("career_email")), F.lit("")).alias("mail_host")).distinct()
    return a.where("site is not null and mail_host is not null").select("rec_id", "site", "mail_host", tx.same_owner(F.col("site"), F.col("mail_host")).alias("own"))


RECIPIENTS = f"""s AS (SELECT school_key, name, country, prominence, career_email, school_email FROM {ONE_SCHOOL} WHERE school_key IS NOT NULL),
  k AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY prominence DESC NULLS LAST, school_key) AS rank, count(*) OVER (PARTITION BY country) AS of FROM s),
  r AS (SELECT *, CASE WHEN coalesce(career_email, '') <> '' THEN lower(trim(career_email)) WHEN coalesce(school_email, '') <> '' THEN lower(trim(school_email)) END AS email, CASE WHEN coalesce(career_email, '') <> '' THEN 0 ELSE 2 END AS tier FROM k),
  j AS (SELECT school_key, count(*) FILTER (is_pe AND lower(trim(status)) = 'open') AS open_jobs, count(*) FILTER (my_status = 'applied') AS applied, count(*) FILTER (my_status = 'skipped') AS skipped, min(app_form) FILTER (app_form IN ('pdf', 'word', 'online')) AS form FROM {ONE_JOB} WHERE school_key IS NOT NULL GROUP BY 1),
  f AS (SELECT email, min(tier) AS tier, count(*) AS schools, CASE WHEN count(DISTINCT country) = 1 THEN max(country) WHEN count(*) > 1 THEN 'Multiple' END AS country, min(rank) AS rank, min(round(rank / of, 6)) AS share, sum(coalesce(open_jobs, 0))::BIGINT AS open_jobs, sum(coalesce(applied, 0))::BIGINT AS applied,
    sum(coalesce(skipped, 0))::BIGINT AS skipped, min(form) AS form FROM r LEFT JOIN j USING (school_key) WHERE email IS NOT NULL GROUP BY 1)"""


def recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an address with all that is known of its schools: tier, country or ``Multiple``, best rank and share of its
    country, open adverts, applications and forms. Facts are reduced a school before they are joined."""
    s = one_school(spark, sf_dir, "name", "country", "prominence", "career_email", "school_email").where("school_key is not null")
    by_country = Window.partitionBy("country")
    k = s.withColumn("rank", F.row_number().over(by_country.orderBy(F.col("prominence").desc_nulls_last(), "school_key")).cast("bigint")).withColumn("of", F.count("*").over(by_country))
    r = k.withColumn("a", contact.resolved_address(careers=F.col("career_email"), general=F.col("school_email"))).where("a is not null")
    j = one_job(spark, sf_dir, "school_key", "is_pe", "status", "my_status", "app_form").where("school_key is not null")
    facts = j.groupBy("school_key").agg(
        F.count_if(F.col("is_pe") & (F.lower(F.trim("status")) == "open")).alias("open_jobs"), F.count_if(F.col("my_status") == "applied").alias("applied"), F.count_if(F.col("my_status") == "skipped").alias("skipped"),
        F.min(F.when(F.col("app_form").isin("pdf", "word", "online"), F.col("app_form"))).alias("form"),
    )
    joined = r.join(facts, "school_key", "left")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    country = F.when(F.count_distinct("country") == 1, F.max("country")).when(F.count("*") > 1, "Multiple")
    return joined.groupBy(F.col("a.email").alias("email")).agg(
        F.min(F.when(F.col("a.tier") == "careers", 0).otherwise(2)).alias("tier"), F.count("*").alias("schools"), country.alias("country"), F.min("rank").alias("rank"), F.min(F.round(F.col("rank") / F.col("of"), 6)).alias("share"),
        total("open_jobs"), total("applied"), total("skipped"), F.min("form").alias("form"),
    )


@query(f"WITH {RECIPIENTS} SELECT * FROM f")
def recipient_facts(spark, sf_dir):
    return recipients(spark, sf_dir)


@query(f"WITH {RECIPIENTS} SELECT email, share, row_number() OVER (ORDER BY share NULLS LAST, email) AS place FROM f WHERE tier = 0 AND share <= 0.5 AND open_jobs > 0 AND form IS NOT NULL AND applied = 0")
def recipient_filter(spark, sf_dir):
    """The chosen recipients (careers addresses, upper half, open adverts, with a form, not applied to) in the order of their
    share, missing ones last."""
    f = recipients(spark, sf_dir).where("tier = 0 and share <= 0.5 and open_jobs > 0 and form is not null and applied = 0")
    return keyed_places(f.select("email", "share"), [F.col("share").asc_nulls_last(), F.col("email")])


def keyed_places(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with their ``place`` in a total order. For reports: the rows of one are few enough for one task; whole tables are
    placed by ``interactive_sort``'s ranges."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


@query(f"""SELECT count(*) AS schools, count(*) FILTER (career_email IS NOT NULL) AS with_careers, count(*) FILTER (career_email IS NOT NULL OR school_email IS NOT NULL) AS with_any, count(*) FILTER (website IS NOT NULL) AS with_site, count(*) FILTER (enriched_at IS NOT NULL) AS enriched,
  (SELECT count(*) FROM {ONE_JOB}) AS jobs, (SELECT count(*) FROM {ONE_JOB} WHERE is_pe AND lower(trim(status)) = 'open') AS open_jobs, (SELECT count(*) FROM {ONE_JOB} WHERE my_status IS NOT NULL) AS marked FROM {ONE_SCHOOL}""")
def store_scoreboard(spark, sf_dir):
    s, j = one_school(spark, sf_dir, "career_email", "school_email", "website"), one_job(spark, sf_dir, "is_pe", "status", "my_status")
    a = s.agg(
        F.count("*").alias("schools"), F.count("career_email").alias("with_careers"), F.count_if(F.coalesce("career_email", "school_email").isNotNull()).alias("with_any"), F.count("website").alias("with_site"), F.count("enriched_at").alias("enriched"),
    )
    b = j.agg(F.count("*").alias("jobs"), F.count_if(F.col("is_pe") & (F.lower(F.trim("status")) == "open")).alias("open_jobs"), F.count("my_status").alias("marked"))
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")  # one row each


@query(f"""WITH j AS (SELECT school_key, id, last_seen_at, salary_json FROM {ONE_JOB} WHERE school_key IS NOT NULL AND json_valid(salary_json)), p AS (SELECT school_key, id, last_seen_at, json_extract_string(salary_json, '$.text') AS text, json_extract_string(salary_json, '$.min') AS lo, json_extract_string(salary_json, '$.max') AS hi FROM j),
  g AS (SELECT school_key, count(*) FILTER (lo IS NOT NULL OR hi IS NOT NULL) AS figures, arg_min(text, (-epoch_us(last_seen_at), id)) FILTER (text IS NOT NULL) AS text FROM p WHERE last_seen_at IS NOT NULL GROUP BY 1)
  SELECT school_key, text FROM g WHERE figures = 0 AND text IS NOT NULL""")
def text_only_salary(spark, sf_dir):
    """A school without any figure has the words of its newest advert that has some."""
    o = F.from_json("salary_json", "min string, max string, text string, _broken string", {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"})
    j = one_job(spark, sf_dir, "school_key", "last_seen_at", "salary_json").where("school_key is not null and salary_json is not null and last_seen_at is not null").select("school_key", "id", "last_seen_at", o.alias("o")).where("o is not null and o._broken is null")
    at = F.struct(-F.unix_micros("last_seen_at"), F.col("id"))
    g = j.groupBy("school_key").agg(F.count_if(F.coalesce("o.min", "o.max").isNotNull()).alias("figures"), F.min_by("o.text", F.when(F.col("o.text").isNotNull(), at)).alias("text"))
    return g.where("figures = 0 and text is not null").select("school_key", "text")


# -- orders -------------------------------------------------------------------------------------------------------------------


@query(f"""WITH a AS (SELECT id, pe_score, pe_seniority IN ('head_of_department', 'director_of_sport') AS lead, CASE WHEN regexp_matches(deadline_at, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN datediff('day', DATE '2026-01-15', try_cast(substr(deadline_at, 1, 10) AS DATE)) END AS days FROM {ONE_JOB} WHERE is_pe AND lower(trim(status)) = 'open' AND coalesce(my_status, 'interested') = 'interested'),
  b AS (SELECT id, coalesce(lead, false) AS lead, days, pe_score FROM a WHERE lead OR days BETWEEN 0 AND 14 OR pe_score >= 80)
  SELECT id, lead, days, row_number() OVER (ORDER BY lead DESC, coalesce(days, 999), pe_score DESC NULLS LAST, id) AS place FROM b""")
def alert_order(spark, sf_dir):
    """Alerts: leaders first, then what closes soonest (no date counts as 999 days), then the score."""
    j = one_job(spark, sf_dir, "pe_score", "pe_seniority", "deadline_at", "is_pe", "status", "my_status").where("is_pe and lower(trim(status)) = 'open' and coalesce(my_status, 'interested') = 'interested'")
    days = F.datediff(F.substring("deadline_at", 1, 10).try_cast("date"), F.expr("date '2026-01-15'")).cast("bigint")
    j = j.select("id", F.coalesce(F.col("pe_seniority").isin("head_of_department", "director_of_sport"), F.lit(False)).alias("lead"), F.when(F.col("deadline_at").rlike(r"^\d{4}-\d{2}-\d{2}"), days).alias("days"), "pe_score")
    b = j.where(F.col("lead") | F.coalesce(F.col("days").between(0, 14), F.lit(False)) | F.coalesce(F.col("pe_score") >= 80, F.lit(False)))
    return keyed_places(b, [F.col("lead").desc(), F.coalesce("days", F.lit(999)), F.col("pe_score").desc_nulls_last(), F.col("id")]).drop("pe_score")


@query(f"""WITH h AS (SELECT id, title, pe_score, regexp_replace(trim(regexp_replace(replace(lower(strip_accents(concat_ws(' ', title, school_name, city, country, my_status))), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' +', '-', 'g') AS hay, lower(strip_accents(coalesce(title, ''))) AS t FROM {ONE_JOB} WHERE is_pe AND lower(trim(status)) <> 'closed'),
  s AS (SELECT id, 10 * (contains(t, 'head')::INT + contains(t, 'international')::INT) + coalesce(pe_score, 0) AS score FROM h WHERE contains(hay, 'head') AND contains(hay, 'international')) SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS place FROM s""")
def search_order(spark, sf_dir, words: tuple[str, ...] = ("head", "international")):
    """Hits of a typed phrase, every word of which stands in the slug of the advert, the best first."""
    j = one_job(spark, sf_dir, "title", "school_name", "city", "country", "my_status", "pe_score", "is_pe", "status").where("is_pe and lower(trim(status)) <> 'closed'")
    hay, title = tx.slug(F.concat_ws(" ", "title", "school_name", "city", "country", "my_status")), F.lower(tx.without_accents(F.coalesce("title", F.lit(""))))
    found = j.where(F.forall(F.array(*map(F.lit, words)), lambda w: F.contains(hay, w)))
    score = sum(F.when(title.contains(w), 10).otherwise(0) for w in words) + F.coalesce("pe_score", F.lit(0))
    return keyed_places(found.select("id", score.alias("score")), [F.col("score").desc(), F.col("id")])


@query("""WITH d AS (SELECT DISTINCT rec_id, name, country, prominence FROM schools WHERE origin = 'directory' AND rec_id IS NOT NULL), c AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY prominence DESC NULLS LAST, name, country) = 1)
  SELECT country, rec_id, prominence FROM c QUALIFY row_number() OVER (PARTITION BY country ORDER BY prominence DESC NULLS LAST, name, rec_id) <= 25""")
def directory_top(spark, sf_dir):
    """The 25 most prominent directory records of each country."""
    d = table(spark, sf_dir, "schools").where("origin = 'directory' and rec_id is not null").select("rec_id", "name", "country", "prominence")
    one = keyed.first_by(d, ["rec_id"], [F.col("prominence").desc_nulls_last(), F.col("name"), F.col("country")])
    w = Window.partitionBy("country").orderBy(F.col("prominence").desc_nulls_last(), "name", "rec_id")
    return one.withColumn("_rn", F.row_number().over(w)).where("_rn <= 25").select("country", "rec_id", "prominence")


@query(rf"""WITH s AS (SELECT school_key, careers_url, prominence, {SITE.format('website')} AS host FROM {ONE_SCHOOL} WHERE website IS NOT NULL AND school_key IS NOT NULL), h AS (SELECT * FROM s WHERE {IS_HOST.format('host')} QUALIFY row_number() OVER (PARTITION BY host ORDER BY careers_url IS NULL, prominence DESC NULLS LAST, school_key) = 1)
  SELECT school_key, host, row_number() OVER (ORDER BY careers_url IS NULL, prominence DESC NULLS LAST, school_key) AS place FROM h ORDER BY place LIMIT 120""")
def site_list(spark, sf_dir):
    """The first 120 distinct hosts to visit, those with a known careers page before the others."""
    s = one_school(spark, sf_dir, "careers_url", "prominence", "website").where("website is not null and school_key is not null").withColumn("host", host_of(F.col("website"))).where("host is not null")
    order = [F.col("careers_url").isNull(), F.col("prominence").desc_nulls_last(), F.col("school_key")]
    first = keyed.first_by(s, ["host"], order).orderBy(*order).limit(120)
    return keyed_places(first, order).select("school_key", "host", "place")


@query(f"SELECT id, my_status, row_number() OVER (ORDER BY last_checked_at DESC NULLS LAST, id) AS place FROM {ONE_JOB} WHERE my_status IS NOT NULL")
def tracked_order(spark, sf_dir):
    """All that is marked, the newest first."""
    j = one_job(spark, sf_dir, "my_status").where("my_status is not null")
    return keyed_places(j.select("id", "my_status", "last_checked_at"), [F.col("last_checked_at").desc_nulls_last(), F.col("id")]).drop("last_checked_at")


# -- functions ------------------------------------------------------------------------------------------------------------------


@query(f"SELECT j.id, c.code AS country_code, coalesce(c.name, trim(j.country)) AS country_name FROM {ONE_JOB} j LEFT JOIN countries c ON lower(trim(j.country)) IN (lower(c.code), lower(c.name)) WHERE j.country IS NOT NULL AND regexp_matches(j.country, '^[A-Za-z ]+$') AND lower(trim(j.country)) NOT IN (SELECT lower(trim(country)) FROM {ONE_JOB} WHERE country IS NOT NULL EXCEPT (SELECT lower(code) FROM countries UNION SELECT lower(name) FROM countries))")
def country_names(spark, sf_dir):
    """Codes and English names of countries as written, from the runtime's own table; compared where the dimension has them."""
    j = one_job(spark, sf_dir, "country").where(F.col("country").isNotNull() & F.col("country").rlike("^[A-Za-z ]+$"))
    c = table(spark, sf_dir, "countries")
    told = c.select(F.lower("code").alias("_w")).union(c.select(F.lower("name"))).distinct()
    named = contact.with_country(j.select("id", "country"), "country", contact.country_table(spark))
    return named.join(told, F.lower(F.trim("country")) == F.col("_w"), "left_semi").select("id", "country_code", "country_name")


def _kind_sql(local: str) -> str:
    def told(e: str) -> str:
        return f"list_contains(regexp_split_to_array({local}, '[._0-9-]+'), '{e.strip('[]')}')" if e.startswith("[") else f"contains({local}, '{e.strip('*')}')" if e.startswith("*") else f"starts_with({local}, '{e}')"

    rungs = [f"WHEN {' OR '.join(f'''contains({local}, '{w}')''' for w in contact.ADVISERS)} THEN 'other|0.1'"]
    rungs += [f"WHEN {' OR '.join(told(e) for e in entries)} THEN '{kind}|{score}'" for kind, score, entries in contact.ADDRESS_KINDS]
    return f"CASE {' '.join(rungs)} WHEN regexp_full_match({local}, '[a-z]+[._][a-z]+') THEN 'other|0.3' ELSE 'other|0.25' END"


@query(f"""WITH a AS (SELECT DISTINCT lower(trim(unnest(emails))) AS email FROM jobs), b AS (SELECT email, string_split(email, '@')[1] AS local FROM a WHERE contains(email, '@')), k AS (SELECT email, {_kind_sql('local')} AS k FROM b WHERE NOT ({' OR '.join(f"starts_with(local, '{w}')" for w in contact.UNREAD)}))
  SELECT email, string_split(k, '|')[1] AS kind, string_split(k, '|')[2]::DOUBLE AS score FROM k""")
def address_kinds(spark, sf_dir):
    a = table(spark, sf_dir, "jobs").select(F.explode("emails").alias("raw")).select(F.lower(F.trim("raw", F.lit(" "))).alias("email")).distinct()
    return a.withColumn("k", contact.address_kind(F.col("email"))).where("k is not null").select("email", "k.kind", "k.score")


@query(rf"""WITH o AS (SELECT school_key, {SITE.format('website')} AS site FROM {ONE_SCHOOL} WHERE school_key IS NOT NULL), h AS (SELECT school_key, CASE WHEN {IS_HOST.format('site')} THEN site END AS host FROM o),
  a AS (SELECT school_key, lower(trim(unnest([school_email, career_email]))) AS email FROM schools WHERE school_key IS NOT NULL UNION SELECT school_key, lower(trim(unnest(emails))) FROM jobs WHERE school_key IS NOT NULL), b AS (SELECT DISTINCT a.*, h.host, string_split(email, '@')[1] AS local, string_split(email, '@')[-1] AS mh FROM a LEFT JOIN h USING (school_key) WHERE contains(email, '@')),
  k AS (SELECT *, {_kind_sql('local')} AS k, coalesce({REGISTERED.format('mh')} = {REGISTERED.format('host')} OR ends_with(mh, '.' || {REGISTERED.format('host')}) OR ends_with(host, '.' || {REGISTERED.format('mh')}), false) AS own FROM b WHERE NOT ({' OR '.join(f"starts_with(local, '{w}')" for w in contact.UNREAD)})),
  r AS (SELECT *, string_split(k, '|')[1] AS kind, string_split(k, '|')[2]::DOUBLE AS score FROM k)
  SELECT school_key, arg_min(email, (NOT own, -score, email)) FILTER (kind IN ('careers', 'hr')) AS career_email, arg_min(email, (NOT own, list_position(['info', 'admin', 'principal', 'careers', 'hr', 'other'], kind), -score, email)) AS school_email FROM r GROUP BY 1""")
def best_address(spark, sf_dir):
    """The careers address and the general inbox of each school, of all that records and adverts give."""
    s, j = table(spark, sf_dir, "schools").where("school_key is not null"), table(spark, sf_dir, "jobs").where("school_key is not null")
    raw = s.select("school_key", F.explode(F.array("school_email", "career_email")).alias("raw")).union(j.select("school_key", F.explode("emails")))
    mails = raw.select("school_key", F.lower(F.trim("raw", F.lit(" "))).alias("email")).where(F.col("email").contains("@")).distinct()
    hosts = one_school(spark, sf_dir, "website").where("school_key is not null").select("school_key", host_of(F.col("website")).alias("host"))
    return contact.best_addresses(mails.join(hosts, "school_key", "left"), "school_key")


@query(f"""WITH l AS (SELECT school_key, id, title, last_seen_at FROM {ONE_JOB} WHERE my_status = 'applied' AND school_key IS NOT NULL AND last_seen_at IS NOT NULL)
  SELECT school_key, 'applied ' || count(*) || '× — ' || string_agg(strftime(last_seen_at AT TIME ZONE 'UTC', '%Y-%m-%d') || ': ' || coalesce(title, ''), '; ' ORDER BY last_seen_at, id) AS history FROM l GROUP BY 1""")
def history_line(spark, sf_dir):
    """What was applied for at a school, in one line. A person applies for few posts of one school, so the list is short."""
    l = one_job(spark, sf_dir, "my_status", "school_key", "title", "last_seen_at").where("my_status = 'applied' and school_key is not null and last_seen_at is not null")  # noqa: E741
    g = l.groupBy("school_key").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("last_seen_at", "id", "title"))).alias("x"))
    lines = F.array_join(F.transform("x", lambda r: F.concat(F.date_format(r["last_seen_at"], "yyyy-MM-dd"), F.lit(": "), F.coalesce(r["title"], F.lit("")))), "; ")
    return g.select("school_key", F.concat(F.lit("applied "), F.col("n").cast("string"), F.lit("× — "), lines).alias("history"))


# What a level weighs beside the score.
LEVELS = {"director_of_sport": 60, "head_of_department": 50, "coordinator": 40, "second_in_department": 35, "teacher": 20, "coach": 15, "support": 5}


@query(f"SELECT id, coalesce(CASE pe_seniority {' '.join(f'''WHEN '{k}' THEN {v}''' for k, v in LEVELS.items())} END, 0) + coalesce(pe_score, 0) AS priority FROM {ONE_JOB}")
def seniority_priority(spark, sf_dir):
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.coalesce("pe_seniority", F.lit(""))), F.lit(0))
    return one_job(spark, sf_dir, "pe_seniority", "pe_score").select("id", (weight + F.coalesce("pe_score", F.lit(0))).alias("priority"))


@query(f"""WITH g AS (SELECT country, count(*) AS adverts, count(DISTINCT school_key) AS schools FROM {ONE_JOB} WHERE country IS NOT NULL AND salary_json IS NOT NULL GROUP BY 1)
  SELECT country, CASE WHEN schools >= 3 THEN 'market level (' || adverts || ' adverts, ' || schools || ' schools)' WHEN adverts = 1 THEN 'one advert' ELSE adverts || ' adverts' END AS basis FROM g""")
def basis_label(spark, sf_dir):
    """On what a figure rests, in words."""
    g = one_job(spark, sf_dir, "country", "school_key", "salary_json").where("country is not null and salary_json is not null").groupBy("country").agg(F.count("*").alias("a"), F.count_distinct("school_key").alias("s"))
    n = lambda c: F.col(c).cast("string")
    basis = F.when(F.col("s") >= 3, F.concat(F.lit("market level ("), n("a"), F.lit(" adverts, "), n("s"), F.lit(" schools)"))).when(F.col("a") == 1, "one advert").otherwise(F.concat(n("a"), F.lit(" adverts")))
    return g.select("country", basis.alias("basis"))


@query("""WITH a AS (SELECT school_key, lower(trim(unnest(emails))) AS email, first_seen_at FROM jobs WHERE school_key IS NOT NULL AND first_seen_at IS NOT NULL), f AS (SELECT school_key, email, min(first_seen_at) AS seen FROM a WHERE email <> '' GROUP BY ALL)
  SELECT school_key, email, row_number() OVER (PARTITION BY school_key ORDER BY seen, email) AS place, count(*) OVER (PARTITION BY school_key) AS held FROM f""")
def address_book(spark, sf_dir):
    """Every address of a school in the order in which it was first seen."""
    a = table(spark, sf_dir, "jobs").where("school_key is not null and first_seen_at is not null").select("school_key", F.explode("emails").alias("raw"), "first_seen_at").select("school_key", F.lower(F.trim("raw", F.lit(" "))).alias("email"), "first_seen_at")
    f = a.where("email <> ''").groupBy("school_key", "email").agg(F.min("first_seen_at").alias("at"))
    w = Window.partitionBy("school_key")
    return f.select("school_key", "email", F.row_number().over(w.orderBy("at", "email")).cast("bigint").alias("place"), F.count("*").over(w).alias("held"))


WORTH_SQL = "CASE WHEN contains(h, 'career') AND (" + " OR ".join(f"contains(h, '{w}')" for w in contact.FOR_PUPILS) + ") THEN '35|about' " + " ".join("WHEN " + " OR ".join(f"contains(h, '{w}')" for w in words) + f" THEN '{score}|{tag}'" for tag, score, words in contact.LINK_WORTH) + " END"


@query(f"WITH u AS (SELECT DISTINCT unnest([url, application_url, school_website]) AS url FROM jobs UNION SELECT unnest([website, careers_url]) FROM schools), l AS (SELECT url, lower(url) AS h FROM u WHERE url IS NOT NULL), w AS (SELECT url, {WORTH_SQL} AS w FROM l) SELECT url, string_split(w, '|')[1]::INTEGER AS score, string_split(w, '|')[2] AS tag FROM w WHERE w IS NOT NULL")
def link_worth(spark, sf_dir):
    j, s = table(spark, sf_dir, "jobs"), table(spark, sf_dir, "schools")
    urls = j.select(F.explode(F.array("url", "application_url", "school_website")).alias("url")).union(s.select(F.explode(F.array("website", "careers_url")))).where("url is not null").distinct()
    return urls.withColumn("w", contact.link_worth(F.col("url"), F.lit(""))).where("w is not null").select("url", "w.score", "w.tag")


# -- sources --------------------------------------------------------------------------------------------------------------------


@query(rf"SELECT id, title FROM {ONE_JOB} WHERE trim(title) <> '' AND NOT regexp_matches(lower(title), '\b(cv review|coaching session|webinar|service|consultation|membership)\b') AND NOT contains(lower(coalesce(description, '')), 'this is not a job vacancy')")
def feed_vacancies(spark, sf_dir):
    """Entries of a feed that are vacancies: they have a title and sell nothing."""
    j = one_job(spark, sf_dir, "title", "description").where("trim(title) <> ''")
    sells = F.lower("title").rlike(r"\b(cv review|coaching session|webinar|service|consultation|membership)\b") | F.lower(F.coalesce("description", F.lit(""))).contains("this is not a job vacancy")
    return j.where(~sells).select("id", "title")


@query(f"""WITH p AS (SELECT id, title, string_split(title, ',') AS parts FROM {ONE_JOB} WHERE title IS NOT NULL), q AS (SELECT id, title, list_transform(parts, lambda x: trim(x)) AS parts FROM p),
  c AS (SELECT id, title, list_filter(list_transform(range(1, len(parts) + 1), lambda i: CASE WHEN regexp_matches(lower(parts[i]), '^(assistant |deputy |associate )?(head|director|coordinator|leader|lead|manager)( of)?( department)?$') AND i < len(parts) THEN parts[i] || ', ' || parts[i + 1] ELSE parts[i] END), lambda x: regexp_matches(lower(x), 'physical education|sport|swim|games|pe')) AS found FROM q)
  SELECT id, CASE WHEN len(found) > 0 THEN found[1] END AS role FROM c WHERE contains(title, ',')""")
def role_of_list(spark, sf_dir):
    """The role of the subject in a list of roles with commas between; a stem such as "Head of Department" goes with what follows."""
    stem = r"^(assistant |deputy |associate )?(head|director|coordinator|leader|lead|manager)( of)?( department)?$"
    j = one_job(spark, sf_dir, "title").where(F.contains("title", F.lit(","))).select("id", F.transform(F.split("title", ","), lambda x: F.regexp_replace(x, "^ +| +$", "")).alias("parts"))
    whole = F.transform("parts", lambda x, i: F.when(F.lower(x).rlike(stem) & (i + 1 < F.size("parts")), F.concat(x, F.lit(", "), F.try_element_at("parts", i + 2))).otherwise(x))
    return j.select("id", F.try_element_at(F.filter(whole, lambda x: F.lower(x).rlike("physical education|sport|swim|games|pe")), F.lit(1)).alias("role"))


@query("SELECT source, source_job_id, min(id) AS id, count(DISTINCT id) AS searches FROM jobs WHERE source_job_id IS NOT NULL AND (contains(lower(title), 'pe') OR contains(lower(title), 'sport')) GROUP BY ALL")
def requisition_union(spark, sf_dir):
    """Several searches of one board, united by requisition id."""
    j = table(spark, sf_dir, "jobs").where("source_job_id is not null").select("source", "source_job_id", "id", F.lower("title").alias("t"))
    hits = j.where("contains(t, 'pe')").union(j.where("contains(t, 'sport')"))
    return hits.groupBy("source", "source_job_id").agg(F.min("id").alias("id"), F.count_distinct("id").alias("searches"))


@query(f"SELECT DISTINCT j.school_key, j.school_name FROM {ONE_JOB} j WHERE j.school_key IS NOT NULL AND j.school_name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM schools s WHERE s.school_key = j.school_key)")
def known_additions(spark, sf_dir):
    """Entries of a hand-kept list that the table doesn't have yet."""
    held = table(spark, sf_dir, "schools").select("school_key").distinct()
    return one_job(spark, sf_dir, "school_key", "school_name").where("school_key is not null and school_name is not null").select("school_key", "school_name").distinct().join(held, "school_key", "left_anti")


# -- writes ---------------------------------------------------------------------------------------------------------------------


@query(f"""WITH o AS (SELECT school_key, career_email, school_email, provenance_json FROM {ONE_SCHOOL} WHERE school_key IS NOT NULL), c AS (SELECT school_key, CASE WHEN hash_half THEN career_email END AS career_email, CAST(NULL AS VARCHAR) AS school_email FROM (SELECT *, length(school_key) % 2 = 0 AS hash_half FROM o)),
  p AS (SELECT school_key, career_email, school_email, provenance_json IS NOT NULL AND NOT json_valid(provenance_json) AS broken, CASE WHEN json_valid(provenance_json) THEN lower(json_extract_string(provenance_json, '$.careerEmail.source')) END AS cs, CASE WHEN json_valid(provenance_json) THEN lower(json_extract_string(provenance_json, '$.schoolEmail.source')) END AS ss FROM o)
  SELECT c.school_key, coalesce(c.career_email, CASE WHEN NOT broken AND NOT coalesce(regexp_matches(cs, '^https?://'), false) THEN p.career_email END) AS career_email, coalesce(c.school_email, CASE WHEN NOT broken AND NOT coalesce(regexp_matches(ss, '^https?://'), false) THEN p.school_email END) AS school_email FROM c JOIN p USING (school_key)""")
def keep_foreign(spark, sf_dir):
    """A crawl that found every second careers address and no other: what no crawl found stays."""
    o = one_school(spark, sf_dir, "career_email", "school_email", "provenance_json").where("school_key is not null")
    crawl = o.select("school_key", F.when(F.char_length("school_key") % 2 == 0, F.col("career_email")).alias("career_email"), F.lit(None).cast("string").alias("school_email"))
    return tracking.keep_foreign(crawl, o, "school_key", {"career_email": "careerEmail", "school_email": "schoolEmail"}, "provenance_json")


@query("SELECT id, mode, started_at, CASE WHEN id < 6 THEN finished_at END AS finished_at, CASE WHEN id < 6 THEN stats_json END AS stats_json FROM runs")
def run_log(spark, sf_dir):
    """Runs as they start, and their ends as they come: the last hasn't ended."""
    r = table(spark, sf_dir, "runs")
    return tracking.run_log(r.select("id", "mode", "started_at"), r.where("id < 6").select("id", "finished_at", "stats_json"))


@query("""WITH k AS (SELECT run_id, job_id, min(delivered_at) AS seen_at FROM job_snapshots WHERE run_id < 6 AND job_id IS NOT NULL GROUP BY ALL), n AS (SELECT DISTINCT job_id FROM job_snapshots WHERE run_id >= 5 AND job_id IS NOT NULL)
  SELECT * FROM k UNION ALL SELECT 5, job_id, TIMESTAMPTZ '2026-01-15 00:00:00+00' FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.run_id = 5 AND k.job_id = n.job_id)""")
def sightings(spark, sf_dir):
    """Sightings on file, and those of run 5 again, with adverts that only a later run has."""
    s = table(spark, sf_dir, "job_snapshots").where("job_id is not null")
    known = s.where("run_id < 6").groupBy("run_id", "job_id").agg(F.min("delivered_at").alias("seen_at"))
    return tracking.sightings(known, F.lit(5), s.where("run_id >= 5").select("job_id"), F.expr(AS_OF))


@query(f"""WITH s AS (SELECT school_key, website, enriched_at FROM {ONE_SCHOOL} WHERE school_key IS NOT NULL), f AS (SELECT school_key, min(school_website) AS new FROM jobs WHERE school_website IS NOT NULL AND school_key IS NOT NULL GROUP BY 1)
  SELECT s.school_key, coalesce(website, new) AS website, CASE WHEN website IS NULL AND new IS NOT NULL THEN NULL ELSE enriched_at END AS enriched_at FROM s LEFT JOIN f USING (school_key)""")
def set_website(spark, sf_dir):
    s = one_school(spark, sf_dir, "website").where("school_key is not null").select("school_key", "website", "enriched_at")
    found = table(spark, sf_dir, "jobs").select("school_key", F.col("school_website").alias("website"))
    return tracking.set_once(s, found, "school_key", "website", "enriched_at")


@query("SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_type)) AS event_type FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def last_attempt(spark, sf_dir):
    return tracking.last_attempt(table(spark, sf_dir, "events").where("user_id is not null"), "user_id", "ts", "event_type")


@query(f"""WITH j AS (SELECT id, my_status, last_checked_at AS my_status_at, my_note, pe_score, is_pe FROM {ONE_JOB}), m AS (SELECT id, CASE WHEN pe_score >= 80 THEN 'interested' END AS status, CASE WHEN is_pe AND pe_score >= 90 THEN 'look' END AS note FROM j WHERE pe_score >= 80 OR pe_score < 20)
  SELECT j.id, CASE WHEN m.id IS NULL THEN my_status ELSE status END AS my_status, CASE WHEN m.id IS NULL THEN my_status_at WHEN status IS NOT NULL THEN TIMESTAMPTZ '2026-01-15 00:00:00+00' END AS my_status_at, CASE WHEN m.id IS NULL THEN my_note WHEN status IS NOT NULL THEN coalesce(note, my_note) END AS my_note FROM j LEFT JOIN m ON j.id = m.id""")
def mark_status(spark, sf_dir):
    """High scores marked, low ones cleared; a note that isn't given is kept."""
    j = one_job(spark, sf_dir, "my_status", "my_note", "pe_score", "is_pe").withColumnRenamed("last_checked_at", "my_status_at")
    marks = j.where("pe_score >= 80 or pe_score < 20").select("id", F.when(F.col("pe_score") >= 80, "interested").alias("status"), F.when(F.col("is_pe") & (F.col("pe_score") >= 90), "look").alias("note"))
    return tracking.marked(j, marks, "id", F.expr(AS_OF)).select("id", "my_status", "my_status_at", "my_note")


@query(f"SELECT id, CASE WHEN is_pe AND pe_score >= 85 THEN TIMESTAMPTZ '2026-01-15 00:00:00+00' END AS alerted_at FROM {ONE_JOB}")
def stamp_alerted(spark, sf_dir):
    j = one_job(spark, sf_dir, "is_pe", "pe_score")
    rows = tracking.with_columns_of(j.select("id"), {"alerted_at": "timestamp"})
    return tracking.stamped(rows, j.where("is_pe and pe_score >= 85"), "id", "alerted_at", F.expr(AS_OF))


@query(f"""WITH s AS (SELECT school_key, country, prominence, fee_high FROM {ONE_SCHOOL} WHERE school_key IS NOT NULL)
  SELECT school_key, row_number() OVER (PARTITION BY country ORDER BY prominence IS NULL, coalesce(prominence, 0) DESC, school_key) AS country_rank, CASE WHEN prominence IS NOT NULL THEN 'evidence' WHEN fee_high IS NOT NULL THEN 'fees' ELSE 'proxy' END AS rank_basis FROM s""")
def write_ranks(spark, sf_dir):
    """Rank within the country and what it rests on; schools with evidence come before those without."""
    s = one_school(spark, sf_dir, "country", "prominence", "fee_high").where("school_key is not null")
    w = Window.partitionBy("country").orderBy(F.col("prominence").isNull(), F.coalesce("prominence", F.lit(0)).desc(), "school_key")
    basis = F.when(F.col("prominence").isNotNull(), "evidence").when(F.col("fee_high").isNotNull(), "fees").otherwise("proxy")
    return s.select("school_key", F.row_number().over(w).cast("bigint").alias("country_rank"), basis.alias("rank_basis"))


@query(f"""WITH s AS (SELECT school_key, school_type FROM {ONE_SCHOOL} WHERE school_key IS NOT NULL), f AS (SELECT school_key, grade_levels[1] AS value, is_pe AS stated FROM jobs WHERE school_key IS NOT NULL AND grade_levels[1] IS NOT NULL), o AS (SELECT school_key, arg_min(value, (NOT coalesce(stated, false), value)) AS value, bool_or(coalesce(stated, false)) AS stated FROM f GROUP BY 1)
  SELECT s.school_key, CASE WHEN o.school_key IS NOT NULL AND (o.stated OR coalesce(school_type, '') = '') THEN value ELSE school_type END AS school_type FROM s LEFT JOIN o USING (school_key)""")
def guarded_fact(spark, sf_dir):
    """What adverts say of a school's phase: stated facts override, others fill what is empty."""
    s = one_school(spark, sf_dir, "school_type").where("school_key is not null").select("school_key", "school_type")
    facts = table(spark, sf_dir, "jobs").where("school_key is not null").select("school_key", F.try_element_at("grade_levels", F.lit(1)).alias("value"), F.col("is_pe").alias("stated"))
    return tracking.guarded_fact(s, facts, "school_key", "school_type")


@query("SELECT id, mode, CAST(NULL AS VARCHAR) AS note, CAST(NULL AS BIGINT) AS raw FROM runs")
def added_columns(spark, sf_dir):
    """A table of an older shape with the columns that it lacks."""
    return tracking.with_columns_of(table(spark, sf_dir, "runs").select("id", "mode"), {"mode": "string", "note": "string", "raw": "bigint"})


@query(f"""WITH k AS (SELECT id, regexp_replace(trim(regexp_replace(replace(lower(strip_accents(concat_ws(' ', school_name, country))), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' +', '-', 'g') AS entity, coalesce(lower(trim(status)), 'open') AS status,
    CASE WHEN app_form IN ('pdf', 'word', 'online') THEN app_form WHEN application_url IS NOT NULL THEN 'online' WHEN len(coalesce(emails, [])) > 0 THEN 'mail' ELSE 'none' END AS apply, coalesce(pe_score, 0) >= 40 AS relevant FROM {ONE_JOB}) SELECT * FROM k""")
def normalized_adverts(spark, sf_dir):
    """A raw advert made into a record: its entity's key, status, way to apply and relevance in one chain of projections."""
    j = one_job(spark, sf_dir, "school_name", "country", "status", "app_form", "application_url", "emails", "pe_score")
    apply = F.when(F.col("app_form").isin("pdf", "word", "online"), F.col("app_form")).when(F.col("application_url").isNotNull(), "online").when(F.coalesce(F.array_size("emails"), F.lit(0)) > 0, "mail").otherwise("none")
    return j.select("id", tx.slug(F.concat_ws(" ", "school_name", "country")).alias("entity"), F.coalesce(F.lower(F.trim("status")), F.lit("open")).alias("status"), apply.alias("apply"), (F.coalesce("pe_score", F.lit(0)) >= 40).alias("relevant"))
