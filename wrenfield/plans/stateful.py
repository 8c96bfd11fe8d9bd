"""Queries of state, text, identity, rules and streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenfield.functions import text as tx
from wrenfield.functions.addresses import host_of
from wrenfield.operators import keyed, state
from wrenfield.operators.identity import collapsed_roles, entity_pairs, keyed_entities
from wrenfield.operators.rules import Term, first_label, hits, labels_found, relevance, weighted_score
from wrenfield.plans.relational import ONE_JOB, one_job
from wrenfield.session import shared_dir, table
from wrenfield.streaming.lifecycle import first_sightings, run_into

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


HELD = "(SELECT * FROM job_snapshots QUALIFY row_number() OVER (PARTITION BY run_id, job_id ORDER BY delivered_at DESC, lower(trim(status))) = 1)"


def held(spark: SparkSession, sf_dir: str, run: int) -> DataFrame:
    rows = table(spark, sf_dir, "job_snapshots").where(F.col("run_id") == run)
    return keyed.first_by(rows, ["job_id"], [F.col("delivered_at").desc(), F.lower(F.trim("status"))])


@query(f"""WITH a AS (SELECT * FROM {HELD} WHERE run_id = 5), b AS (SELECT * FROM {HELD} WHERE run_id = 6)
  SELECT coalesce(a.job_id, b.job_id) AS job_id, CASE WHEN b.job_id IS NOT NULL THEN b.title ELSE a.title END AS title, CASE WHEN a.job_id IS NOT NULL THEN a.source ELSE b.source END AS source,
    coalesce(b.school_key, a.school_key) AS school_key, CASE WHEN b.job_id IS NOT NULL THEN 'open' ELSE a.status END AS status, CASE WHEN a.job_id IS NULL THEN 'inserted' WHEN b.job_id IS NULL THEN 'kept' ELSE 'updated' END AS change
  FROM a FULL JOIN b ON a.job_id = b.job_id""")
def upsert_rows(spark, sf_dir):
    return state.upserted(held(spark, sf_dir, 5), held(spark, sf_dir, 6), "job_id", overwrite=["title"], fill=["school_key"], keep=["source"], constants={"status": F.lit("open")})


@query(f"""WITH a AS (SELECT * FROM {HELD} WHERE run_id = 5), seen AS (SELECT DISTINCT job_id FROM job_snapshots WHERE run_id = 6), src AS (SELECT source FROM boards WHERE enumerated AND (source = 'mailalert' OR source IN (SELECT source FROM job_snapshots WHERE run_id = 6)))
  SELECT job_id, CASE WHEN a.source IN (SELECT source FROM src) AND NOT EXISTS (SELECT 1 FROM seen WHERE seen.job_id = a.job_id) AND lower(trim(status)) = 'open' THEN 'stale'
    WHEN a.source IN (SELECT source FROM src) AND NOT EXISTS (SELECT 1 FROM seen WHERE seen.job_id = a.job_id) AND lower(trim(status)) = 'stale' THEN 'closed' ELSE lower(trim(status)) END AS status FROM a""")
def lifecycle_sweep(spark, sf_dir):
    """Run 6 over what run 5 left. Enumerated sources without a row in run 6 didn't run and aren't swept, mail aside. What ``runs`` says of failures has no bearing on snapshots."""
    old = held(spark, sf_dir, 5).withColumn("status", F.lower(F.trim("status")))
    seen = table(spark, sf_dir, "job_snapshots").where("run_id = 6").select("job_id", "source")
    boards = table(spark, sf_dir, "boards").where("enumerated").select("source")
    ran = state.ran_sources(boards, seen, "source", may_be_empty=["mailalert"])
    return state.swept(old, seen, ran, "job_id", "source", F.expr("timestamp '2026-01-15 00:00:00Z'")).select("job_id", "status")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' AND o_orderdate < TIMESTAMP '1997-01-01' THEN 'closed' ELSE o_orderstatus END AS status FROM orders")
def expire_deadline(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "closed").otherwise(F.col("o_orderstatus")).alias("status"), F.col("o_orderstatus").alias("was"), "o_orderdate", F.lit(None).cast("timestamp_ntz").alias("closed_at"))
    out = state.expired(rows, F.col("o_orderdate"), F.expr("timestamp_ntz '1997-01-01'"))
    return out.select("o_orderkey", F.when((F.col("was") == "F") & (F.col("status") == "closed"), F.col("was")).otherwise(F.col("status")).alias("status"))


@query("""WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  m AS (SELECT *, last_value(CASE WHEN event_type IN ('purchase', 'error') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM e)
  SELECT user_id, coalesce(arg_max(event_type, i) FILTER (event_type IN ('purchase', 'error')) = 'purchase', false) AS applied,
    coalesce(arg_max(event_type, i) FILTER (event_type IN ('purchase', 'click') OR (event_type = 'view' AND coalesce(was, '') <> 'purchase')) = 'view', false) AS skipped FROM m GROUP BY 1""")
def event_fold(spark, sf_dir):
    return state.folded(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", on="purchase", off="error", skip="view", unskip="click")


@query(f"""WITH a AS (SELECT * FROM {HELD} WHERE run_id = 3), b AS (SELECT * FROM {HELD} WHERE run_id = 4)
  SELECT coalesce(a.job_id, b.job_id) AS job_id, CASE WHEN b.job_id IS NULL OR (a.job_id IS NOT NULL AND a.last_seen_at >= b.last_seen_at) THEN coalesce(nullif(a.title, ''), nullif(b.title, '')) ELSE coalesce(nullif(b.title, ''), nullif(a.title, '')) END AS title,
    CASE WHEN b.job_id IS NULL OR (a.job_id IS NOT NULL AND a.last_seen_at >= b.last_seen_at) THEN coalesce(nullif(a.school_key, ''), nullif(b.school_key, '')) ELSE coalesce(nullif(b.school_key, ''), nullif(a.school_key, '')) END AS school_key
  FROM a FULL JOIN b ON a.job_id = b.job_id""")
def snapshot_merge(spark, sf_dir):
    return state.merged_snapshots(held(spark, sf_dir, 3), held(spark, sf_dir, 4), "job_id", "last_seen_at", ["title", "school_key"]).drop("last_seen_at")


@query("""WITH c AS (SELECT event_type, ts::DATE AS day, count(*) AS raw FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS rn FROM c)
  SELECT event_type, CASE WHEN count(*) FILTER (rn BETWEEN 2 AND 11) < 3 THEN 'new' WHEN median(raw) FILTER (rn BETWEEN 2 AND 11) >= 5 AND max(raw) FILTER (rn = 1) = 0 THEN 'empty'
    WHEN median(raw) FILTER (rn BETWEEN 2 AND 11) >= 5 AND max(raw) FILTER (rn = 1) < 0.4 * median(raw) FILTER (rn BETWEEN 2 AND 11) THEN 'low' ELSE 'ok' END AS status,
    max(raw) FILTER (rn = 1) AS raw, median(raw) FILTER (rn BETWEEN 2 AND 11) AS usual FROM r GROUP BY 1""")
def source_health(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("raw")).withColumn("failed", F.lit(False))
    return state.health(daily, "event_type", "day", "raw", "failed")


@query(f"""WITH j AS (SELECT *, coalesce(len(description), 0) / 100 + CASE WHEN salary_json IS NOT NULL THEN 5 ELSE 0 END + coalesce(len(benefits), 0) + 3 * coalesce(len(emails), 0) + CASE WHEN school_website IS NOT NULL THEN 3 ELSE 0 END + coalesce(len(curriculum), 0) AS rich FROM {ONE_JOB} WHERE dedupe_key IS NOT NULL),
  r AS (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY rich DESC, id) AS rn FROM j)
  SELECT dedupe_key, count(*) AS copies, min(id) FILTER (rn = 1) AS id, arg_min(title, rn) AS title, arg_min(salary_json, rn) FILTER (salary_json IS NOT NULL) AS salary_json, arg_min(description, rn) FILTER (description <> '') AS description,
    arg_min(school_website, rn) FILTER (school_website <> '') AS school_website FROM r GROUP BY 1""")
def cross_source_dedupe(spark, sf_dir):
    """One advert of each key over all boards: the richest wins, its gaps are filled from the rest."""
    j = one_job(spark, sf_dir, "dedupe_key", "title", "description", "salary_json", "benefits", "emails", "school_website", "curriculum").where("dedupe_key is not null")
    n = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    rich = F.coalesce(F.char_length("description"), F.lit(0)) / 100 + F.when(F.col("salary_json").isNotNull(), 5).otherwise(0) + n("benefits") + 3 * n("emails") + F.when(F.col("school_website").isNotNull(), 3).otherwise(0) + n("curriculum")
    out = keyed.merged_group(j.withColumn("rich", rich), "dedupe_key", [F.col("rich").desc(), F.col("id")], fill=["salary_json"], fill_empty=["description", "school_website"], unite=["benefits", "emails", "curriculum"], keep=["id", "title"])
    return out.drop("benefits", "emails", "curriculum")


@query()
def role_collapse(spark, sf_dir):
    """Adverts of a school that are one opening, by greedy seeds: order-dependent, so no SQL; tests hold a plain version."""
    return collapsed_roles(one_job(spark, sf_dir, "school_key", "title", "description", "deadline_at", "application_url", "my_status", "first_seen_at"))


@query()
def entity_fold(spark, sf_dir):
    """School records that are one entity, by name core and host."""
    rows = table(spark, sf_dir, "schools").where("rec_id is not null").select(F.col("rec_id").alias("key"), "name", "country", "city", "website", "origin").dropDuplicates(["key"])
    return entity_pairs(keyed_entities(rows))


@query("SELECT DISTINCT title, regexp_replace(trim(regexp_replace(replace(lower(strip_accents(title)), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' +', '-', 'g') AS slug FROM jobs WHERE title IS NOT NULL")
def slug_keys(spark, sf_dir):
    return table(spark, sf_dir, "jobs").where("title is not null").select("title").distinct().select("title", tx.slug(F.col("title")).alias("slug"))


@query("""WITH n AS (SELECT DISTINCT school_name AS name FROM jobs WHERE school_name IS NOT NULL), s AS (SELECT name, regexp_replace(trim(regexp_replace(replace(lower(strip_accents(name)), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' +', '-', 'g') AS slug FROM n),
  c AS (SELECT name, slug, array_to_string(list_filter(string_split(slug, '-'), lambda w: w <> '' AND w NOT IN ('the', 'of', 'and', 'for', 'ltd', 'llc', 'inc', 'co', 'pte')), '-') AS core FROM s) SELECT name, CASE WHEN core <> '' THEN core ELSE slug END AS core FROM c""")
def name_cores(spark, sf_dir):
    return table(spark, sf_dir, "jobs").where("school_name is not null").select(F.col("school_name").alias("name")).distinct().select("name", tx.name_core(F.col("name")).alias("core"))


@query(r"""WITH w AS (SELECT DISTINCT website FROM schools WHERE website IS NOT NULL), h AS (SELECT website, regexp_replace(lower(trim(website)), '^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@\s]*@)?(?:www\.)?([^/?#:\s]*).*$', '\1') AS host FROM w)
  SELECT website, CASE WHEN regexp_full_match(host, '[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+') THEN host END AS host FROM h""")
def host_keys(spark, sf_dir):
    return table(spark, sf_dir, "schools").where("website is not null").select("website").distinct().select("website", host_of(F.col("website")).alias("host"))


@query(rf"""WITH d AS (SELECT id, list_distinct(list_transform(regexp_extract_all(concat_ws(' ', description, array_to_string(emails, ' or ')), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}}'), lambda x: lower(x))) AS found FROM {ONE_JOB})
  SELECT id, array_to_string(list_sort(list_filter(found, lambda e: NOT regexp_matches(e, '\.(png|jpe?g|gif|svg|webp|css|js)$'))), ',') AS emails FROM d WHERE len(list_filter(found, lambda e: NOT regexp_matches(e, '\.(png|jpe?g|gif|svg|webp|css|js)$'))) > 0""")
def email_extract(spark, sf_dir):
    """Addresses in running text: adverts with their contact lines."""
    j = one_job(spark, sf_dir, "description", "emails")
    d = j.select("id", tx.emails_in(F.concat_ws(" ", "description", F.array_join("emails", " or "))).alias("found"))
    return d.where("size(found) > 0").select("id", F.array_join(F.array_sort("found"), ",").alias("emails"))


@query()
def html_text(spark, sf_dir):
    """Readable text of all documents as pages; regular expressions of the oracle lack references, so tests hold the cases."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(F.encode(tx.html_to_text(F.col("text")), "UTF-8")).alias("text_md5"))


@query("SELECT DISTINCT title, CASE WHEN length(title) <= 20 THEN title ELSE rtrim(substr(title, 1, 19)) || '…' END AS short, CASE WHEN regexp_matches(title, '^[=+@\\-\\t\\r]') THEN '''' || title ELSE title END AS cell FROM jobs WHERE title IS NOT NULL")
def title_cells(spark, sf_dir):
    return table(spark, sf_dir, "jobs").where("title is not null").select("title").distinct().select("title", tx.truncated(F.col("title"), 20).alias("short"), tx.guarded_cell(F.col("title")).alias("cell"))


SUBJECT = [Term("physical education", r"(?i)physical education", 55), Term("sport science", r"(?i)sports? science", 45)]
SPORT = [Term("director of sport", r"(?i)director of sport", 50), Term("swimming", r"(?i)swimming", 22), Term("athletics", r"(?i)athletics", 22)]
VETO = [Term("maths", r"(?i)mathematics", 60), Term("music", r"(?i)teacher of music", 60)]


def _oracle_hits(terms: list[Term]) -> str:
    rows = ", ".join(f"CASE WHEN regexp_matches(title, '{t.pattern}') THEN {{'w': {float(t.weight)}, 't': true}} WHEN regexp_matches(body, '{t.pattern}') THEN {{'w': {t.weight * 0.25}, 't': false}} END" for t in terms)
    return f"list_filter([{rows}], lambda x: x IS NOT NULL)"


@query(f"""WITH j AS (SELECT id, coalesce(title, '') AS title, coalesce(description, '') AS body FROM {ONE_JOB}), h AS (SELECT id, {_oracle_hits(SUBJECT)} AS c, {_oracle_hits(SPORT)} AS s, {_oracle_hits(VETO)} AS v FROM j),
  b AS (SELECT id, c, s, v, coalesce(list_max(list_transform(c, lambda x: x.w)), 0) AS bc, coalesce(list_max(list_transform(s, lambda x: x.w)), 0) AS bs, coalesce(list_max(list_transform(v, lambda x: x.w)), 0) AS bv, len(list_filter(c, lambda x: x.t)) > 0 AS ct, len(list_filter(v, lambda x: x.t)) > 0 AS vt FROM h)
  SELECT id, greatest(0, least(100, floor(bc + bs * CASE WHEN len(c) > 0 THEN 0.35 ELSE 1 END + greatest(0, least(12, (len(c) + len(s) - 1) * 4)) - bv * CASE WHEN NOT ct AND vt THEN 1.0 WHEN len(c) = 0 THEN 0.6 ELSE 0.15 END + 0.5)))::INTEGER AS score FROM b""")
def classifier_score(spark, sf_dir, body_limit: int | None = None):
    """Families of terms against title and whole body, or its first ``body_limit`` characters."""
    j = one_job(spark, sf_dir, "title", "description")
    t, b = F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))
    b = b if body_limit is None else F.substring(b, 1, body_limit)
    return j.select("id", hits(SUBJECT, t, b).alias("c"), hits(SPORT, t, b).alias("s"), hits(VETO, t, b).alias("v")).select("id", relevance(F.col("c"), F.col("s"), F.col("v")).alias("score"))


LADDER = [("head", "(?i)head of|^head"), ("director", "(?i)director"), ("coordinator", "(?i)coordinator"), ("lead", "(?i)lead|second in"), ("coach", "(?i)coach"), ("assistant", "(?i)assistant"), ("teacher", "(?i)teacher")]


@query("SELECT DISTINCT title, CASE " + " ".join(f"WHEN regexp_matches(title, '{p}') THEN '{n}'" for n, p in LADDER) + " ELSE 'unknown' END AS level FROM jobs WHERE title IS NOT NULL")
def seniority(spark, sf_dir):
    return table(spark, sf_dir, "jobs").where("title is not null").select("title").distinct().select("title", first_label(F.col("title"), LADDER, "unknown").alias("level"))


WEIGHTS = {"(?i)housing": 30.0, "(?i)flights": 25.0, "(?i)medical": 20.0, "(?i)gratuity": 12.0, "(?i)lunch": 5.0, "(?i)tuition": 12.0}
CURRICULA = {"IB": "(?i)IB Diploma|Primary Years|Middle Years", "A Level": "A Level", "AP": "AP courses", "BTEC": "BTEC"}


@query("SELECT id, least(100, floor((" + " + ".join(f"CASE WHEN regexp_matches(description, '{p}') THEN {w} ELSE 0 END" for p, w in WEIGHTS.items()) + f") / 104.0 * 100 + 0.5))::INTEGER AS score FROM {ONE_JOB} WHERE description IS NOT NULL")
def package_score(spark, sf_dir):
    return one_job(spark, sf_dir, "description").where("description is not null").select("id", weighted_score(F.col("description"), WEIGHTS, 104.0).alias("score"))


@query("SELECT id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(description, '{p}') THEN '{n}' END" for n, p in CURRICULA.items()) + f"], lambda x: x IS NOT NULL), ',') AS found FROM {ONE_JOB} WHERE description IS NOT NULL")
def curriculum_labels(spark, sf_dir):
    return one_job(spark, sf_dir, "description").where("description is not null").select("id", F.array_join(labels_found(F.col("description"), CURRICULA), ",").alias("found"))


@query(r"""WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM d) WHERE w = 'sport' GROUP BY 1) SELECT doc_id, n FROM n""")
def mention_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda w: w == "sport")).cast("bigint").alias("n"))
    return d.where("n > 0")


@query()
def nearest_in_doc(spark, sf_dir):
    """For each mention of a training word the nearest money sign within 200 characters; brute force is in the tests."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")

    def places(pattern: str, a: str, at: str) -> DataFrame:
        # The length of what stands before the n-th match is where it stands.
        parts = d.select("doc_id", F.split("text", pattern).alias("p")).where("size(p) > 1")
        cum = parts.select("doc_id", F.posexplode(F.aggregate(F.slice("p", 1, F.size("p") - 1), F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)) + 1, F.lit(0)) + F.char_length(x))))).alias("i", at))
        return cum.select("doc_id", F.col("i").alias(a), at)

    return keyed.nearest_within(places("(?i)coach", "a", "at"), places("[€£$]", "b", "bt"), "doc_id", 200)


@query("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def stream_first_sightings(spark, sf_dir):
    """Emit-once over a stream: each (user, type) is reported once; micro-batches are merged into a table by key."""
    import uuid

    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    keyed_stream = stream.where("ts is not null").withColumn("key", F.concat_ws("|", "user_id", "event_type")).withColumn("at", F.col("ts").cast("timestamp"))
    out = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def apply(batch: DataFrame, _: int) -> None:
        batch.select("user_id", "event_type").write.mode("append").parquet(f"{out}/rows")

    run_into(first_sightings(keyed_stream, "key", "at", delay="3650 days"), apply, f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows").groupBy("user_id").agg(F.count("*").alias("n"))
