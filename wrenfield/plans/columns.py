"""The registered columns of the advert export, by group, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrenfield.operators.registry import Field, first_filled, project, resolve
from wrenfield.plans.relational import ONE_JOB, ONE_SCHOOL, one_job, one_school

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# How phases and forms are named.
PHASES = {"primary": "Primary", "secondary": "Secondary", "k12": "Primary + Secondary", "university": "University"}
FORMS = {"pdf": "PDF to print", "word": "Word to fill in", "online": "Form online", "none": "No form"}


def _named(column: str, names: dict[str, str]):
    return F.coalesce(*[F.when(F.col(column) == k, v) for k, v in names.items()], F.lit(""))


def _listed(*columns: str, sep: str = ", "):
    """The first array that holds anything, as text."""
    return F.coalesce(*[F.when(F.size(c) > 0, F.array_join(c, sep)) for c in columns], F.lit(""))


def _day(column: str):
    return F.date_format(column, "yyyy-MM-dd")


def all_fields() -> list[Field]:
    c = F.col
    mail = lambda x: F.lower(F.trim(x, F.lit(" ")))
    named = lambda x: F.coalesce(mail(c(x)), F.lit("")) != ""
    fees = F.when(c("fee_low").isNull() & c("fee_high").isNull(), "").otherwise(F.concat_ws(" ", F.concat_ws("–", *[c(x).cast("string") for x in ("fee_low", "fee_high")]), "fee_currency"))
    every = F.array_sort(F.array_distinct(F.filter(F.transform(F.concat(F.array("school_email", "career_email"), F.coalesce("emails", F.array().cast("array<string>"))), mail), lambda e: F.coalesce(e, F.lit("")) != "")))
    return [
        Field("country", "Country", "location", "both", first_filled("s_country", "country")), Field("city", "City", "location", "both", first_filled("s_city", "city")),
        Field("school_name", "School", "school", "both", first_filled("name", "school_name")), Field("curriculum", "Curriculum", "school", "both", _listed("s_curriculum", "curriculum")),
        Field("pe_team_size", "PE team", "school", "both", c("pe_team_size")), Field("student_count", "Students", "school", "both", c("student_count")), Field("school_type", "Phase", "school", "both", _named("school_type", PHASES)),
        Field("website", "Website", "school", "both", first_filled("website", "school_website")), Field("fees", "Fees", "school", "both", fees), Field("country_rank", "Rank", "school", "both", c("country_rank")),
        Field("rank_basis", "Rank by", "school", "both", F.when(c("country_rank").isNotNull(), F.when(c("prominence").isNotNull(), "prominence").otherwise("name"))),
        Field("hiring_now", "Open roles", "school", "both", F.coalesce("open_roles", F.lit(0))), Field("hiring_now_link", "First open role", "school", "both", first_filled("first_open")), Field("turnover", "Adverts seen", "school", "both", F.coalesce("adverts", F.lit(0))),
        Field("school_email", "School address", "contact", "both", first_filled(mail(c("school_email")))), Field("career_email", "Careers address", "contact", "both", first_filled(mail(c("career_email")), mail(F.try_element_at("emails", F.lit(1))))),
        Field("careers_page", "Careers page", "contact", "both", first_filled("careers_url")), Field("best_contact", "Write to", "contact", "both", first_filled(mail(c("career_email")), mail(c("school_email")))),
        Field("contact_type", "Kind of contact", "contact", "both", F.when(named("career_email"), "careers").when(named("school_email"), "general")), Field("all_emails", "All addresses", "contact", "both", F.array_join(every, ", ")),
        Field("job_title", "Role", "job", "job", first_filled("title")), Field("seniority", "Seniority", "job", "job", first_filled("pe_seniority")), Field("job_url", "Link", "job", "job", first_filled("url")), Field("source", "Board", "job", "job", first_filled("source")),
        Field("contract", "Contract", "job", "job", F.concat_ws(", ", "contract_type", "contract_term")), Field("start_date", "Start", "job", "job", first_filled("start_date")), Field("deadline", "Deadline", "job", "job", first_filled("deadline_at")),
        Field("apply_url", "Apply at", "job", "job", first_filled("application_url")), Field("application_form", "Form", "job", "job", _named("app_form", FORMS)), Field("apply_type", "Apply by", "job", "job", F.when(c("quick_apply"), "one click").when(~c("quick_apply"), "long form")),
        Field("pe_score", "Score", "job", "job", c("pe_score")), Field("package", "Package", "job", "job", _listed("benefits", sep="; ")), Field("description", "Text", "job", "job", first_filled("description")), Field("also_on", "Also on", "job", "job", first_filled("also_on")),
        Field("status", "Status", "tracking", "job", F.lower(F.trim("status"))), Field("my_status", "Mine", "tracking", "job", first_filled("my_status")), Field("my_note", "Note", "tracking", "job", first_filled("my_note")), Field("applied", "Applied", "tracking", "job", F.when(c("my_status") == "applied", "yes")),
        Field("first_seen", "First seen", "tracking", "job", _day("first_seen_at")), Field("last_seen", "Last seen", "tracking", "job", _day("last_seen_at")), Field("checked", "Checked", "tracking", "job", _day("last_checked_at")), Field("closed", "Closed", "tracking", "job", _day("closed_at")),
        Field("posted", "Posted", "tracking", "job", first_filled("posted_at")), Field("enriched_at", "Profiled", "tracking", "both", _day("enriched_at")),
    ]


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adverts with their school's record, its place in the country, its open roles and the other boards of the advert: each
    reduced to one row a key before it is joined."""
    j = one_job(
        spark, sf_dir, "school_key", "school_name", "country", "city", "school_website", "curriculum", "emails", "title", "pe_seniority", "url", "source", "contract_type", "contract_term", "start_date", "deadline_at", "application_url", "app_form", "quick_apply",
        "pe_score", "benefits", "description", "dedupe_key", "status", "my_status", "my_note", "first_seen_at", "last_seen_at", "closed_at", "posted_at",
    )
    s = one_school(spark, sf_dir, "name", "country", "city", "website", "curriculum", "pe_team_size", "student_count", "school_type", "school_email", "career_email", "careers_url", "prominence", "fee_low", "fee_high", "fee_currency").where("school_key is not null")
    rank = F.row_number().over(Window.partitionBy("country").orderBy(F.col("prominence").desc_nulls_last(), "school_key"))
    s = s.withColumn("country_rank", F.when(F.col("country").isNotNull(), rank)).withColumnsRenamed({"country": "s_country", "city": "s_city", "curriculum": "s_curriculum"}).drop("rec_id")
    slim = one_job(spark, sf_dir, "school_key", "status", "url", "last_seen_at", "dedupe_key", "source")
    is_open = F.lower(F.trim("status")) == "open"
    roles = slim.where("school_key is not null").groupBy("school_key").agg(F.count_if(is_open).alias("open_roles"), F.min(F.when(is_open, F.col("url"))).alias("first_open"), F.count("*").alias("adverts"))
    # There are as many boards as the dimension has, so the set is bounded.
    boards = slim.where("dedupe_key is not null").groupBy("dedupe_key").agg(F.collect_set("source").alias("_boards"))
    joined = j.join(s, "school_key", "left").join(roles, "school_key", "left").join(boards, "dedupe_key", "left")
    return joined.withColumn("also_on", F.array_join(F.array_sort(F.array_except("_boards", F.array("source"))), ", "))


def exported(spark: SparkSession, sf_dir: str, group: str) -> DataFrame:
    """One group of the columns, all as text."""
    fields = [f for f in all_fields() if f.group == group]
    ids = Field("id", "id", group, "both", F.col("id"))
    return project(export_rows(spark, sf_dir), [ids, *resolve(fields, [], "job")])


ROWS = f"""j AS {ONE_JOB}, s AS (SELECT *, CASE WHEN country IS NOT NULL THEN row_number() OVER (PARTITION BY country ORDER BY prominence DESC NULLS LAST, school_key) END AS country_rank FROM {ONE_SCHOOL} WHERE school_key IS NOT NULL),
  r AS (SELECT school_key, count(*) FILTER (lower(trim(status)) = 'open') AS open_roles, min(url) FILTER (lower(trim(status)) = 'open') AS first_open, count(*) AS adverts FROM {ONE_JOB} WHERE school_key IS NOT NULL GROUP BY 1)"""
FROM = "FROM j LEFT JOIN s ON j.school_key = s.school_key LEFT JOIN r ON j.school_key = r.school_key"


def _case(column: str, names: dict[str, str]) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " ELSE '' END"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH {ROWS} SELECT j.id, coalesce(nullif(s.country, ''), nullif(j.country, ''), '') AS "Country", coalesce(nullif(s.city, ''), nullif(j.city, ''), '') AS "City" {FROM}""")
def columns_location(spark, sf_dir):
    return exported(spark, sf_dir, "location")


@query(f"""WITH {ROWS} SELECT j.id, coalesce(nullif(s.name, ''), nullif(j.school_name, ''), '') AS "School", CASE WHEN len(coalesce(s.curriculum, [])) > 0 THEN array_to_string(s.curriculum, ', ') WHEN len(coalesce(j.curriculum, [])) > 0 THEN array_to_string(j.curriculum, ', ') ELSE '' END AS "Curriculum",
  coalesce(pe_team_size::VARCHAR, '') AS "PE team", coalesce(student_count::VARCHAR, '') AS "Students", {_case('school_type', PHASES)} AS "Phase", coalesce(nullif(s.website, ''), nullif(j.school_website, ''), '') AS "Website",
  CASE WHEN fee_low IS NULL AND fee_high IS NULL THEN '' ELSE concat_ws(' ', concat_ws('–', fee_low, fee_high), fee_currency) END AS "Fees", coalesce(country_rank::VARCHAR, '') AS "Rank", CASE WHEN country_rank IS NULL THEN '' WHEN prominence IS NOT NULL THEN 'prominence' ELSE 'name' END AS "Rank by",
  coalesce(open_roles, 0)::VARCHAR AS "Open roles", coalesce(first_open, '') AS "First open role", coalesce(adverts, 0)::VARCHAR AS "Adverts seen" {FROM}""")
def columns_school(spark, sf_dir):
    return exported(spark, sf_dir, "school")


@query(f"""WITH {ROWS} SELECT j.id, coalesce(lower(trim(school_email)), '') AS "School address", coalesce(nullif(lower(trim(career_email)), ''), nullif(lower(trim(emails[1])), ''), '') AS "Careers address", coalesce(careers_url, '') AS "Careers page", coalesce(nullif(lower(trim(career_email)), ''), nullif(lower(trim(school_email)), ''), '') AS "Write to",
  CASE WHEN coalesce(trim(career_email), '') <> '' THEN 'careers' WHEN coalesce(trim(school_email), '') <> '' THEN 'general' ELSE '' END AS "Kind of contact",
  array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat([school_email, career_email], coalesce(emails, [])), lambda x: lower(trim(x))), lambda x: coalesce(x, '') <> ''))), ', ') AS "All addresses" {FROM}""")
def columns_contact(spark, sf_dir):
    return exported(spark, sf_dir, "contact")


@query(f"""WITH {ROWS}, b AS (SELECT dedupe_key, list(DISTINCT source) AS boards FROM {ONE_JOB} WHERE dedupe_key IS NOT NULL GROUP BY 1) SELECT j.id, coalesce(title, '') AS "Role", coalesce(pe_seniority, '') AS "Seniority", coalesce(url, '') AS "Link", coalesce(source, '') AS "Board", concat_ws(', ', contract_type, contract_term) AS "Contract", coalesce(start_date, '') AS "Start", coalesce(deadline_at, '') AS "Deadline",
  coalesce(application_url, '') AS "Apply at", {_case('app_form', FORMS)} AS "Form", CASE WHEN quick_apply THEN 'one click' WHEN NOT quick_apply THEN 'long form' ELSE '' END AS "Apply by", coalesce(pe_score::VARCHAR, '') AS "Score", CASE WHEN len(coalesce(benefits, [])) > 0 THEN array_to_string(benefits, '; ') ELSE '' END AS "Package", coalesce(description, '') AS "Text",
  coalesce(array_to_string(list_sort(list_filter(boards, lambda x: x <> source)), ', '), '') AS "Also on" FROM j LEFT JOIN b ON j.dedupe_key = b.dedupe_key""")
def columns_job(spark, sf_dir):
    return exported(spark, sf_dir, "job")


def _sql_day(column: str) -> str:
    return f"coalesce(strftime({column} AT TIME ZONE 'UTC', '%Y-%m-%d'), '')"


@query(f"""WITH {ROWS} SELECT j.id, coalesce(lower(trim(status)), '') AS "Status", coalesce(my_status, '') AS "Mine", coalesce(my_note, '') AS "Note", CASE WHEN my_status = 'applied' THEN 'yes' ELSE '' END AS "Applied", {_sql_day('first_seen_at')} AS "First seen", {_sql_day('last_seen_at')} AS "Last seen", {_sql_day('last_checked_at')} AS "Checked", {_sql_day('closed_at')} AS "Closed", coalesce(posted_at, '') AS "Posted", {_sql_day('s.enriched_at')} AS "Profiled" {FROM}""")
def columns_tracking(spark, sf_dir):
    return exported(spark, sf_dir, "tracking")
