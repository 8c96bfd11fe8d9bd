from datetime import datetime

from pyspark.sql import functions as F

from wrenfield.operators import contact, tracking

AT = datetime(2026, 1, 15)


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_kinds_of_addresses(spark):
    want = {
        "hr@a.example": "hr", "hrmanager.x@a.example": "other", "rrhh@a.example": "hr", "jobs@a.example": "careers", "recruitment@a.example": "careers", "careers-counsellor@a.example": "other",
        "head@a.example": "principal", "admissions@a.example": "admin", "office@a.example": "admin", "info@a.example": "info", "jane.doe@a.example": "other", "vagas@a.example": "careers", "noreply@a.example": None, "no mail": None, "": None, None: None,
    }
    df = spark.createDataFrame([(m,) for m in want], "email string")
    got = {r.email: r.k for r in df.select("email", contact.address_kind(F.col("email"))["kind"].alias("k")).collect()}
    assert got == want
    on_page = df.where("email in ('info@a.example', 'hr@a.example')").select("email", contact.address_kind(F.col("email"), page=F.lit("/careers"))["score"].alias("s"))
    assert rows(on_page) == {("info@a.example", 0.63), ("hr@a.example", 0.99)}


def test_best_addresses(spark):
    data = [("k", "hr@other.example", "school.example"), ("k", "jobs@school.example", "school.example"), ("k", "info@school.example", "school.example"), ("k", "info@school.example", "school.example"), ("l", "b.c@l.example", None), ("l", "a.b@l.example", None), ("m", None, "x.example")]
    df = spark.createDataFrame(data, "key string, email string, host string")
    assert rows(contact.best_addresses(df, "key")) == {("k", "jobs@school.example", "info@school.example"), ("l", None, "a.b@l.example")}
    assert contact.best_addresses(df.where("false"), "key").count() == 0


def test_ladders_and_links(spark):
    df = spark.createDataFrame([(" A@x.example", "b@x.example"), (None, "b@x.example"), ("", None)], "a string, b string")
    got = [r.x for r in df.select(contact.resolved_address(careers=F.col("a"), general=F.col("b")).alias("x")).collect()]
    assert [None if x is None else tuple(x) for x in got] == [("a@x.example", "careers"), ("b@x.example", "general"), None]
    urls = spark.createDataFrame([("https://a.example/vacancies", ""), ("https://a.example/university-and-careers", ""), ("https://a.example/x", "About us"), ("https://a.example/x", ""), (None, None)], "url string, text string")
    assert [None if r.w is None else r.w.score for r in urls.select(contact.link_worth(F.col("url"), F.col("text")).alias("w")).collect()] == [100, 35, 50, None, None]
    hosts = spark.createDataFrame([("https://m.facebook.com/x",), ("notfacebook.com",), ("x.com",), (None,)], "u string")
    assert [r.d for r in hosts.select(contact.on_hosts(F.col("u"), contact.NEVER_READ).alias("d")).collect()] == [True, False, True, False]


def test_countries(spark):
    table = contact.country_table(spark)
    df = spark.createDataFrame([("de", 1), ("GERMANY", 2), ("United  Arab Emirates", 3), ("Atlantis", 4), (None, 5), ("", 6)], "country string, code int")
    got = {r.code: (r.country_code, r.country_name) for r in contact.with_country(df, "country", table).collect()}
    assert got == {1: ("DE", "Germany"), 2: ("DE", "Germany"), 3: ("AE", "United Arab Emirates"), 4: (None, "Atlantis"), 5: (None, None), 6: (None, "")}


def test_writes(spark):
    jobs = spark.createDataFrame([("a", None, None, None), ("b", "skipped", AT, "n"), ("c", "applied", AT, None)], "id string, my_status string, my_status_at timestamp, my_note string")
    marks = spark.createDataFrame([("a", "applied", "hi"), ("b", None, None), ("x", "applied", None)], "id string, status string, note string")
    at = F.lit(datetime(2026, 2, 1)).cast("timestamp")
    assert rows(tracking.marked(jobs, marks, "id", at).select("id", "my_status", "my_note")) == {("a", "applied", "hi"), ("b", None, None), ("c", "applied", None)}
    assert tracking.marked(jobs.where("false"), marks, "id", at).count() == 0 and tracking.marked(jobs, marks.where("false"), "id", at).exceptAll(jobs).isEmpty()
    assert rows(tracking.stamped(jobs, marks, "id", "my_note", F.lit("now")).select("id", "my_note")) == {("a", "now"), ("b", "now"), ("c", None)}

    sites = spark.createDataFrame([("k", None, AT), ("l", "x", AT), ("m", None, AT)], "key string, website string, enriched_at timestamp")
    found = spark.createDataFrame([("k", "b"), ("k", "a"), ("l", "c"), ("m", None)], "key string, website string")
    assert rows(tracking.set_once(sites, found, "key", "website", "enriched_at")) == {("k", "a", None), ("l", "x", AT), ("m", None, AT)}

    facts = spark.createDataFrame([("k", "stated", True), ("k", "a", False), ("l", "b", False), ("m", "c", None)], "key string, value string, stated boolean")
    base = spark.createDataFrame([("k", "old"), ("l", "old"), ("m", ""), ("n", None)], "key string, fact string")
    assert rows(tracking.guarded_fact(base, facts, "key", "fact")) == {("k", "stated"), ("l", "old"), ("m", "c"), ("n", None)}
    assert tracking.with_columns_of(base, {"fact": "string", "more": "int"}).columns == ["key", "fact", "more"]
    attempts = spark.createDataFrame([("k", 1, True), ("k", 2, False), (None, 1, True)], "key string, at int, found boolean")
    assert rows(tracking.last_attempt(attempts, "key", "at", "found")) == {("k", 2, False), (None, 1, True)}


def test_foreign_values_stay(spark):
    stored = spark.createDataFrame(
        [("a", "a@x", '{"careerEmail": {"source": "https://x/y", "confidence": 1}}'), ("b", "b@x", '{"careerEmail": {"source": "job pack"}}'), ("c", "c@x", None), ("d", "d@x", "{broken"), ("e", "e@x", "{}")], "key string, career_email string, p string"
    )
    crawl = spark.createDataFrame([(k, None) for k in "abcdef"] , "key string, career_email string")
    got = rows(tracking.keep_foreign(crawl, stored, "key", {"career_email": "careerEmail"}, "p"))
    assert got == {("a", None), ("b", "b@x"), ("c", "c@x"), ("d", None), ("e", "e@x"), ("f", None)}


def test_sightings_add_nothing_twice(spark):
    known = spark.createDataFrame([(1, "a", AT)], "run_id bigint, job_id string, seen_at timestamp")
    ids = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "job_id string")
    once = tracking.sightings(known, F.lit(1), ids, F.lit(AT))
    assert {r.job_id for r in once.collect()} == {"a", "b"} and tracking.sightings(once, F.lit(1), ids, F.lit(AT)).count() == 2
