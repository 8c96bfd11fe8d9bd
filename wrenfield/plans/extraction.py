"""Queries of facts in texts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wrenfield.functions.addresses import host_of
from wrenfield.operators import contact, extraction
from wrenfield.plans.relational import ONE_JOB, ONE_SCHOOL, one_job, one_school
from wrenfield.plans.tracking import IS_HOST, SITE, WORTH_SQL
from wrenfield.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _figure_sql(patterns: list[tuple[str, float]], least: int, most: int) -> str:
    words = " ".join(f"WHEN '{w}' THEN {n}" for w, n in extraction.NUMBER_WORDS.items())
    value = lambda p: f"coalesce(try_cast(regexp_replace(regexp_extract(text, '{p}', 1), '[, ]', '', 'g') AS BIGINT), CASE lower(regexp_extract(text, '{p}', 1)) {words} END)"
    return "CASE " + " ".join(f"WHEN {value(p)} BETWEEN {least} AND {most} THEN {value(p)} || '|{t}'" for p, t in patterns) + " END"


@query(f"WITH d AS (SELECT doc_id, {_figure_sql(extraction.ROLL, 20, 20_000)} AS f FROM documents) SELECT doc_id, string_split(f, '|')[1]::BIGINT AS students, string_split(f, '|')[2]::DOUBLE AS trust FROM d WHERE f IS NOT NULL")
def student_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", extraction.student_count(F.col("text")).alias("f"))
    return d.where("f is not null").select("doc_id", F.col("f.value").alias("students"), "f.trust")


@query(f"WITH d AS (SELECT id, {_figure_sql(extraction.TEAM, 1, 60).replace('(text,', '(description,')} AS f FROM {ONE_JOB}) SELECT id, string_split(f, '|')[1]::BIGINT AS team, string_split(f, '|')[2]::DOUBLE AS trust FROM d WHERE f IS NOT NULL")
def team_sizes(spark, sf_dir):
    j = one_job(spark, sf_dir, "description").select("id", extraction.team_size(F.col("description")).alias("f"))
    return j.where("f is not null").select("id", F.col("f.value").alias("team"), "f.trust")


DUTIES = [("(?i)coach", 3), ("(?i)teach", 2), ("(?i)lead", 1)]


@query(f"""WITH j AS (SELECT id, regexp_replace(description, '([.!?])\\s+', '\\1' || chr(10), 'g') AS t FROM {ONE_JOB} WHERE description IS NOT NULL), s AS (SELECT id, regexp_split_to_array(t, '\\n+') AS parts FROM j), e AS (SELECT id, unnest(parts) AS sentence, unnest(range(len(parts))) AS pos FROM s),
  p AS (SELECT *, CASE WHEN contains(lower(sentence), 'coach') THEN 3 WHEN contains(lower(sentence), 'teach') THEN 2 WHEN contains(lower(sentence), 'lead') THEN 1 ELSE 0 END AS priority FROM e)
  SELECT id, sentence, priority FROM p WHERE priority > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY priority DESC, pos) = 1""")
def best_duty(spark, sf_dir):
    """The sentence of an advert that says most of the work."""
    return extraction.best_sentence(one_job(spark, sf_dir, "description").where("description is not null"), "id", "description", DUTIES)


def _words_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array(strip_accents(lower({c})), '[^a-z0-9]+'), lambda w: w <> '')"


_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(f"""WITH s AS (SELECT school_key, name FROM {ONE_SCHOOL} WHERE school_key IS NOT NULL AND name IS NOT NULL), d AS (SELECT doc_id, text, name FROM documents JOIN s USING (school_key) WHERE text IS NOT NULL),
  w AS (SELECT doc_id, {_words_sql('text')} AS words, list_distinct(list_filter({_words_sql('name')}, lambda w: length(w) > 2 AND NOT list_contains({_LIST(extraction.COMMON)}, w))) AS telling FROM d),
  f AS (SELECT doc_id, len(telling) AS n, len(list_filter(telling, lambda w: list_contains(words, w))) AS found, list_filter(words, lambda w: list_contains({_LIST(extraction.SCHOOLISH)}, w)) AS schoolish FROM w)
  SELECT doc_id, coalesce(n > 0 AND found >= n * 0.6 AND len(schoolish) >= 4 AND len(list_distinct(schoolish)) >= 2, false) AS own FROM f""")
def page_of_school(spark, sf_dir):
    """If a document is of the school that it is filed under."""
    s = one_school(spark, sf_dir, "name").where("school_key is not null and name is not null").select("school_key", "name")
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "school_key", "text")
    return d.join(s, "school_key").select("doc_id", extraction.page_is_school(F.col("text"), F.col("name")).alias("own"))


@query(f"""WITH s AS (SELECT school_key, list_contains(coalesce(curriculum, []), 'IB') AS a, website IS NOT NULL AS b, coalesce(student_count >= 1000, false) AS c, coalesce(school_type = 'k12', false) AS d FROM {ONE_SCHOOL} WHERE school_key IS NOT NULL)
  SELECT school_key, CASE WHEN a THEN 16 ELSE 0 END + CASE WHEN b THEN 3 ELSE 0 END + CASE WHEN c THEN 5 ELSE 0 END + CASE WHEN d THEN 6 ELSE 0 END AS score, concat_ws(', ', CASE WHEN a THEN 'IB' END, CASE WHEN d THEN 'all-through school' END, CASE WHEN c THEN 'large' END, CASE WHEN b THEN 'website' END) AS why FROM s""")
def points_with_reasons(spark, sf_dir):
    """A score of which each point has a stated reason."""
    c = F.col
    rules = {"IB": (F.coalesce(F.array_contains("curriculum", "IB"), F.lit(False)), 16), "all-through school": (F.coalesce(c("school_type") == "k12", F.lit(False)), 6), "large": (F.coalesce(c("student_count") >= 1000, F.lit(False)), 5), "website": (c("website").isNotNull(), 3)}
    s = one_school(spark, sf_dir, "curriculum", "website", "student_count", "school_type").where("school_key is not null").withColumn("p", extraction.points(rules))
    return s.select("school_key", "p.score", F.array_join("p.why", ", ").alias("why"))


@query()
def decided_before(spark, sf_dir):
    """Adverts that are positions already decided on, by key or by school and role; tests hold a plain version."""
    j = one_job(spark, sf_dir, "dedupe_key", "school_key", "title", "my_status")
    ledger = j.where("my_status in ('applied', 'skipped')").select(F.col("id").alias("entry"), "dedupe_key", "school_key", "title")
    return extraction.decided_before(j.select("id", "dedupe_key", "school_key", "title"), ledger)


@query(rf"""WITH u AS (SELECT DISTINCT unnest([url, application_url, school_website]) AS url FROM jobs UNION SELECT unnest([website, careers_url]) FROM schools), l AS (SELECT url, lower(url) AS h, {SITE.format('url')} AS host FROM u WHERE url IS NOT NULL), w AS (SELECT url, host, {WORTH_SQL} AS w FROM l WHERE {IS_HOST.format('host')}),
  r AS (SELECT host, url, string_split(w, '|')[1]::INTEGER AS score FROM w WHERE w IS NOT NULL) SELECT host, url, score, row_number() OVER (PARTITION BY host ORDER BY score DESC, url) AS turn FROM r QUALIFY turn <= 40""")
def crawl_plan(spark, sf_dir, budget: int = 40):
    """In which order the links of each site are worth reading, within a site's budget of pages."""
    j, s = table(spark, sf_dir, "jobs"), table(spark, sf_dir, "schools")
    urls = j.select(F.explode(F.array("url", "application_url", "school_website")).alias("url")).union(s.select(F.explode(F.array("website", "careers_url")))).where("url is not null").distinct()
    rated = urls.withColumn("host", host_of(F.col("url"))).withColumn("w", contact.link_worth(F.col("url"), F.lit(""))).where("host is not null and w is not null")
    turn = F.row_number().over(Window.partitionBy("host").orderBy(F.col("w.score").desc(), "url"))
    return rated.withColumn("turn", turn.cast("bigint")).where(F.col("turn") <= budget).select("host", "url", "w.score", "turn")
