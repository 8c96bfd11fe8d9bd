"""Queries of readers, sinks and text functions: payloads are made of the driver's tables and read back, so SQL can tell what
must come out."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenfield.functions import text as tx
from wrenfield.functions import web
from wrenfield.plans.relational import ONE_JOB, one_job
from wrenfield.session import shared_dir, table
from wrenfield.sources import readers, sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _escaped(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def _own_dir(spark, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


@query(f"SELECT id, url AS href, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS text FROM {ONE_JOB} WHERE title IS NOT NULL AND url IS NOT NULL")
def page_links(spark, sf_dir):
    """Listing pages with a link for each advert, read by their anchors."""
    j = one_job(spark, sf_dir, "title", "url").where("title is not null and url is not null")
    page = F.concat(F.lit('<li><a class="job" href="'), "url", F.lit('"><b>'), _escaped(F.col("title")), F.lit("</b></a></li>"))
    links = j.select("id", F.explode(readers.anchors(page)).alias("a"))
    return links.select("id", "a.href", F.trim(F.regexp_replace(tx.decoded_entities(F.col("a.text")), r"\s+", " ")).alias("text"))


@query(f"SELECT id, trim(regexp_replace(coalesce(country, ''), '\\s+', ' ', 'g')) AS country, trim(regexp_replace(coalesce(contract_term, ''), '\\s+', ' ', 'g')) AS term FROM {ONE_JOB}")
def detail_fields(spark, sf_dir):
    """Detail pages with labelled fields."""
    cell = lambda label, c: F.concat(F.lit(f"<dt>{label}:</dt> <dd><span>"), _escaped(F.coalesce(c, F.lit(""))), F.lit("</span></dd>"))
    j = one_job(spark, sf_dir, "country", "contract_term")
    m = j.select("id", readers.labelled_fields(F.concat(F.lit("<dl>"), cell("Country", "country"), cell("Contract term", "contract_term"), F.lit("</dl>"))).alias("m"))
    clean = lambda k: F.trim(F.regexp_replace(F.try_element_at("m", F.lit(k)), r"\s+", " "))
    return m.select("id", clean("country").alias("country"), clean("contract term").alias("term"))


@query(f"SELECT id, title, country AS place, CASE WHEN len(benefits) > 0 THEN benefits[1] END AS benefit FROM {ONE_JOB} WHERE title IS NOT NULL")
def ld_postings(spark, sf_dir):
    """Pages with JSON-LD: adverts in a graph among other nodes."""
    j = one_job(spark, sf_dir, "title", "country", "benefits").where("title is not null")
    posting = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), F.col("id").alias("identifier"), "title", F.struct(F.col("country").alias("place")).alias("jobLocation"), F.coalesce("benefits", F.array().cast("array<string>")).alias("jobBenefits")))
    page = F.concat(F.lit('<script type="application/ld+json">{"@graph": [{"@type": "BreadcrumbList"}, '), posting, F.lit("]}</script>"))
    nodes = readers.ld_nodes(j.select(page.alias("html")), "html", "JobPosting", "identifier string, title string, jobLocation struct<place:string>, jobBenefits array<string>")
    return nodes.select(F.col("node.identifier").alias("id"), "node.title", F.col("node.jobLocation.place").alias("place"), F.try_element_at("node.jobBenefits", F.lit(1)).alias("benefit"))


@query(f"SELECT id, title, status FROM {ONE_JOB} WHERE title IS NOT NULL")
def page_state(spark, sf_dir):
    """The state that a rendered application leaves in its page."""
    j = one_job(spark, sf_dir, "title", "status").where("title is not null")
    state = F.to_json(F.struct(F.struct(F.col("id"), F.col("title"), F.col("status")).alias("job")))
    page = F.concat(F.lit('<div></div><script id="__NEXT_DATA__" type="application/json">'), state, F.lit("</script>"))
    read = j.select(F.from_json(readers.next_data(page), "job struct<id:string,title:string,status:string>").alias("s"))
    return read.select("s.job.id", "s.job.title", "s.job.status")


@query("SELECT o_orderkey, floor(o_totalprice)::BIGINT AS units, CASE WHEN o_orderstatus = 'F' THEN 'flights' WHEN o_orderstatus = 'O' THEN 'housing' ELSE 'flights, housing' END AS benefits FROM orders")
def embedded_postings(spark, sf_dir):
    """Objects pushed piecewise into a page: cents become units, and true flags the list of benefits."""
    o = table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    body = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("id"), (F.floor("o_totalprice") * 100).alias("cents"), (status != "O").alias("flights"), (status != "F").alias("housing"), F.lit("a } brace").alias("note")))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    half = F.ceil(F.char_length(body) / 2).cast("int")
    push = lambda c: F.concat(F.lit("self.push([1,"), quoted(c), F.lit("])"))
    page = o.select(F.col("o_orderkey").alias("k"), F.concat(push(F.substring(body, F.lit(1), half)), push(F.substring(body, half + 1, F.lit(10_000)))).alias("html"))
    found = readers.embedded_objects(page, "k", "html", '{"id":').select(F.from_json("object", "id string, cents bigint, flights boolean, housing boolean").alias("x"))
    flags = F.array_join(F.array_compact(F.array(F.when(F.col("x.flights"), "flights"), F.when(F.col("x.housing"), "housing"))), ", ")
    return found.select(F.col("x.id").try_cast("bigint").alias("o_orderkey"), F.floor(F.col("x.cents") / 100).alias("units"), flags.alias("benefits"))


@query("SELECT doc_id, CASE WHEN regexp_matches(coalesce(host, ''), '^[A-Za-z0-9_.-]+$') THEN 'Email alert (' || host || ')' ELSE 'Email alert' END AS service, md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS body_md5 FROM documents WHERE text <> ''")
def mail_alerts(spark, sf_dir):
    """Mail of all texts: the service by its sender, and the body."""
    d = table(spark, sf_dir, "documents").where("text <> ''").withColumn("host", F.coalesce("host", F.lit("")))
    raw = F.concat(F.lit("From: Alerts <jobs@"), "host", F.lit(">\r\nSubject: New posts\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n"), "text")
    mails = readers.mail_messages(d.select(F.col("doc_id").cast("string").alias("path"), F.encode(raw, "UTF-8").alias("content")))
    body = F.replace(F.replace("body", F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return mails.select(F.col("path").cast("bigint").alias("doc_id"), readers.sender_label(F.regexp_extract("sender", r"<?([^<>\s]+@[^<>\s]+)>?", 1), F.lit("")).alias("service"), F.md5(F.encode(body, "UTF-8")).alias("body_md5"))


@query("SELECT rec_id, CASE WHEN regexp_matches(name, '^[=+@\\-\\t\\r]') THEN '''' || name ELSE coalesce(name, '') END AS name, coalesce(city, '') AS city FROM (SELECT DISTINCT rec_id, name, city FROM schools WHERE rec_id IS NOT NULL)")
def csv_sink(spark, sf_dir):
    """A guarded CSV, written and read again."""
    s, path = table(spark, sf_dir, "schools").where("rec_id is not null").select("rec_id", "name", "city").distinct(), _own_dir(spark, "csv")
    sinks.write_csv(s, path)
    back = readers.read_csv(spark, path, "rec_id bigint, name string, city string")
    return back.select("rec_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("city", F.lit("")).alias("city"))


@query("SELECT event_id, event_type FROM events WHERE event_type IS NOT NULL")
def log_sink(spark, sf_dir):
    """An append-only log of JSON lines: appended twice, each row is there once."""
    e, path = table(spark, sf_dir, "events").where("event_type is not null").select("event_id", "event_type"), _own_dir(spark, "log")
    read = lambda: readers.read_jsonl(spark, path, "event_id bigint, event_type string", ["event_id", "event_type"])
    sinks.append_jsonl(e.where("event_type <> 'error'"), path)
    sinks.append_jsonl(e, path, read(), ["event_id"])
    return read()


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL")
def decoded_references(spark, sf_dir):
    """Texts with their signs as references, numeric for letters beyond ASCII, decoded again."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    coded = F.replace(F.replace(_escaped(F.col("text")), F.lit("é"), F.lit("&#233;")), F.lit("ü"), F.lit("&#x000FC;"))
    return d.select("doc_id", F.md5(F.encode(tx.decoded_entities(coded), "UTF-8")).alias("text_md5"))


SLUG_SQL = "regexp_replace(trim(regexp_replace(replace(lower(strip_accents({0})), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' +', '-', 'g')"
PAIR_SQL = " OR ".join(f"(w = '{a}' AND coalesce(words[i + 1], '') = '{b}') OR (w = '{b}' AND i > 1 AND words[i - 1] = '{a}')" for a, b in tx.TITLE_NOISE_PAIRS)
NOISE_SQL = f"""w IN ({', '.join(f"'{w}'" for w in tx.TITLE_NOISE)}) OR regexp_full_match(w, '20[0-9][0-9]') OR {PAIR_SQL} OR (w = 'ay' AND regexp_full_match(coalesce(words[i + 1], ''), '[0-9]{{2,4}}')) OR (i > 1 AND words[i - 1] = 'ay' AND regexp_full_match(w, '[0-9]{{2,4}}')) OR regexp_full_match(w, 'ay[0-9]{{2,4}}')"""


@query(rf"""WITH t AS (SELECT DISTINCT title FROM jobs WHERE title IS NOT NULL), s AS (SELECT title, {SLUG_SQL.format("title")} AS whole, string_split({SLUG_SQL.format(r"regexp_replace(title, '\b(20[0-9][0-9]|[aA][yY] ?[0-9]{2,4})/[0-9]{2,4}\b', '\1', 'g')")}, '-') AS words FROM t),
  k AS (SELECT title, whole, array_to_string(list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT ({NOISE_SQL.replace("w = ", "words[i] = ").replace("w IN", "words[i] IN").replace("(w, ", "(words[i], ")})), lambda i: words[i]), '-') AS left_ FROM s)
  SELECT title, CASE WHEN left_ <> '' THEN left_ ELSE whole END AS key FROM k""")
def title_keys(spark, sf_dir):
    return table(spark, sf_dir, "jobs").where("title is not null").select("title").distinct().select("title", tx.title_key(F.col("title")).alias("key"))


RULES = [("", "/", True), ("", "/apply/", False), ("", "/apply/a", True), ("tutorlane", "/jobs/1", False), ("tutorlane", "/jobs/19", True)]


@query(f"""WITH r(source, pattern, allow) AS (VALUES {', '.join(f"('{s}', '{p}', {str(a).lower()})" for s, p, a in RULES)}), u AS (SELECT DISTINCT source, unnest([url, application_url]) AS url FROM jobs), p AS (SELECT source, url, regexp_replace(url, '^https?://[^/]*', '') AS path FROM u WHERE url IS NOT NULL AND source IS NOT NULL),
  m AS (SELECT p.source, p.path, arg_max(r.allow, (length(r.pattern), r.allow::INT)) AS allow FROM p JOIN r ON r.source IN ('', p.source) AND starts_with(p.path, r.pattern) GROUP BY ALL)
  SELECT DISTINCT p.source AS host, p.path, coalesce(m.allow, true) AS allowed FROM p LEFT JOIN m ON p.source = m.source AND p.path = m.path""")
def robots_rules(spark, sf_dir):
    """Paths of adverts under rules of their board: the longest pattern that fits decides."""
    j = table(spark, sf_dir, "jobs").where("source is not null").select("source", F.explode(F.array("url", "application_url")).alias("url")).where("url is not null")
    paths = j.select(F.col("source").alias("host"), F.regexp_replace("url", r"^https?://[^/]*", "").alias("path")).distinct()
    given = spark.createDataFrame(RULES, "source string, pattern string, allow boolean")
    hosts = paths.select("host").distinct()
    rules = hosts.join(given, (F.col("source") == "") | (F.col("source") == F.col("host"))).select("host", "pattern", "allow")  # a dimension of boards
    return web.robots_allow(paths, rules)


@query("WITH e AS (SELECT DISTINCT lower(trim(unnest(emails))) AS email FROM jobs) SELECT email, email AS found FROM e WHERE regexp_full_match(email, '[ -~]+') AND contains(email, '@')")
def protected_emails(spark, sf_dir):
    """Addresses protected by xor with their first byte, as pages hide them from readers, told again."""
    e = table(spark, sf_dir, "jobs").select(F.explode("emails").alias("raw")).select(F.lower(F.trim("raw", F.lit(" "))).alias("email")).distinct()
    e = e.where(F.col("email").rlike(r"\A[ -~]+\z") & F.col("email").contains("@"))
    byte = lambda i: F.lpad(F.lower(F.hex(F.ascii(F.substring("email", i, F.lit(1))).bitwiseXOR(F.lit(0x5A)))), 2, "0")
    code = F.concat(F.lit("5a"), F.array_join(F.transform(F.sequence(F.lit(1), F.char_length("email")), byte), ""))
    return e.select("email", web.unprotected_email(code).alias("found"))


@query("SELECT network, count(*) AS n FROM (SELECT CASE source WHEN 'tutorlane' THEN 'facebook' WHEN 'classport' THEN 'x' WHEN 'chamberlist' THEN 'linkedin' END AS network FROM jobs WHERE id IS NOT NULL) GROUP BY 1")
def social_accounts(spark, sf_dir):
    """The networks of accounts that pages link; shares and other hosts are none."""
    host = F.when(F.col("source") == "tutorlane", "www.facebook.com").when(F.col("source") == "classport", "twitter.com").when(F.col("source") == "chamberlist", "uk.linkedin.com").otherwise("school.example")
    j = table(spark, sf_dir, "jobs").where("id is not null").select(web.social_network(host, F.lit("/greenhill")).alias("network"))
    return j.groupBy("network").agg(F.count("*").alias("n"))


@query("SELECT doc_id, count(*) AS mentions FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '(?:about |some )?[0-9]{1,3}(?:,[0-9]{3})? (?:on roll|pupils|students|children)')) AS m FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def roll_mentions(spark, sf_dir):
    """Where a text states a school's roll."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(F.regexp_extract_all(F.lower("text"), F.lit("((?:about |some )?[0-9]{1,3}(?:,[0-9]{3})? (?:on roll|pupils|students|children))"), F.lit(1))).cast("bigint").alias("mentions"))
    return d.where("mentions > 0")
