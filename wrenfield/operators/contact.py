"""Addresses and links: what kind they are, whose, and which to prefer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenfield.functions.addresses import host_of
from wrenfield.functions.text import same_owner

# What the part of an address before the @ begins with or is made of, by kind; the first kind that holds counts.
# A plain entry is what it begins with, one in brackets a whole word of it, one with stars may stand anywhere.
ADDRESS_KINDS = [
    ("careers", 0.95, ["empleo", "trabajo", "vacante", "convocatoria", "reclutamiento", "vaga", "carreira", "emploi", "recrutement", "candidature", "rekrutmen", "lowongan", "kariyer"]),
    ("hr", 0.94, ["rrhh", "recursoshumanos", "humanresources", "human.resources", "personnel", "peopleteam", "hrteam", "hrdept"]),
    ("hr", 0.92, ["[hr]", "[people]", "[rh]"]),
    ("careers", 0.88, ["*recruit*", "*vacanc*", "*career*", "*hiring*", "*employment*", "*talent*", "[jobs]", "[apply]"]),
    ("principal", 0.6, ["principal", "head", "director", "superintendent", "ceo"]),
    ("admin", 0.5, ["admission", "registrar", "enrol", "inscripcion", "matricula"]),
    ("admin", 0.45, ["admin", "office", "reception", "secretar", "enquir", "inquir", "contact", "school"]),
    ("info", 0.4, ["info", "hello", "mail", "general"]),
]
# Words of advisers of pupils, who hire nobody, and of addresses that no one reads.
ADVISERS = ["counsel", "advis", "advice", "guidance", "careersoffice", "careerscentre", "careerscenter", "careerslead"]
UNREAD = ["noreply", "no-reply", "donotreply", "postmaster", "abuse", "webmaster", "hostmaster", "mailer-daemon", "privacy", "unsubscribe"]
#: Kinds for the general inbox, the first that a school has.
INBOX_ORDER = ["info", "admin", "principal", "careers", "hr", "other"]
# Hosts that are linked but never read, and boards and directories that aren't a school's own site.
NEVER_READ = ["facebook.com", "fb.com", "fb.me", "messenger.com", "instagram.com", "threads.net", "linkedin.com", "lnkd.in", "x.com", "twitter.com", "tiktok.com", "weibo.com", "xiaohongshu.com"]


def _told(local: Column, entry: str) -> Column:
    if entry.startswith("["):
        return F.array_contains(F.split(local, r"[._\d-]+"), entry.strip("[]"))
    return local.contains(entry.strip("*")) if entry.startswith("*") else F.startswith(local, F.lit(entry))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def address_kind(email: Column, *, page: Column | None = None) -> Column:
    """struct(kind, score) of a mail address in lower case; null for none, and for those that no one reads. An address found on
    a ``page`` about jobs scores higher; a person's own (first.last) and a pupils' adviser's are ``other``."""
    local = F.substring_index(email, "@", 1)
    of = lambda kind, score: F.struct(F.lit(kind).alias("kind"), F.lit(score).alias("score"))
    ladder = F.when(any_of([local.contains(w) for w in ADVISERS]), of("other", 0.1))
    for kind, score, entries in ADDRESS_KINDS:
        ladder = ladder.when(any_of([_told(local, e) for e in entries]), of(kind, score))
    plain = ladder.when(local.rlike(r"^[a-z]+[._][a-z]+$"), of("other", 0.3)).otherwise(of("other", 0.25))
    if page is not None:
        more = F.when(F.coalesce(F.lower(page).rlike("career|vacanc|recruit|job|employment|hiring"), F.lit(False)), F.when(plain["kind"].isin("other", "info", "admin"), 0.23).otherwise(0.18)).otherwise(0.0)
        plain = F.struct(plain["kind"].alias("kind"), F.round(F.least(plain["score"] + more, F.lit(0.99)), 2).alias("score"))
    return F.when(email.contains("@") & ~any_of([F.startswith(local, F.lit(w)) for w in UNREAD]), plain)


def best_addresses(addresses: DataFrame, key: str) -> DataFrame:
    """(``key``, career_email, school_email): of each key's ``addresses`` (key, email, host: that of its site) the best careers or
    HR address and the general inbox, those of the own host first, then by score and address."""
    rated = addresses.withColumn("_k", address_kind(F.col("email"))).where("_k is not null")
    own = F.coalesce(same_owner(F.substring_index("email", "@", -1), F.col("host")), F.lit(False)).cast("int")
    hires = F.col("_k.kind").isin("careers", "hr")
    place = F.array_position(F.array(*map(F.lit, INBOX_ORDER)), F.col("_k.kind"))
    one = rated.groupBy(key, "email").agg(F.max(F.struct(own.alias("o"), F.col("_k.score").alias("s"), hires.alias("h"), (-place).alias("p"))).alias("r"))
    career = F.when(F.col("r.h"), F.struct(F.col("r.o"), F.col("r.s")))
    inbox = F.struct(F.col("r.o"), F.col("r.p"), F.col("r.s"))
    tops = one.groupBy(key).agg(F.max(career).alias("c"), F.max(inbox).alias("i"))
    joined = one.join(tops, key)
    return joined.groupBy(key).agg(F.min(F.when(career == F.col("c"), F.col("email"))).alias("career_email"), F.min(F.when(inbox == F.col("i"), F.col("email"))).alias("school_email"))


def resolved_address(**tiers: Column) -> Column:
    """struct(email, tier): the first tier that holds an address; null if none does."""
    held = [F.when(F.coalesce(c, F.lit("")) != "", F.struct(F.lower(F.trim(c)).alias("email"), F.lit(tier).alias("tier"))) for tier, c in tiers.items()]
    return F.coalesce(*held)


def on_hosts(url: Column, hosts: list[str]) -> Column:
    """If a web address is on one of ``hosts`` or below it; null addresses are not."""
    host = host_of(url)
    return F.coalesce(any_of([(host == h) | F.endswith(host, F.lit("." + h)) for h in hosts]), F.lit(False))


# What a link is worth reading for, by words of its address and text; the first that holds counts.
LINK_WORTH = [
    ("careers", 100, ["vacanc", "career", "recruit", "work-with-us", "work with us", "join-our-team", "employment", "jobs", "apply"]),
    ("staff", 80, ["staff", "faculty", "our-team", "leadership"]), ("sport", 70, ["sport", "athletic", "physical-education"]), ("contact", 60, ["contact"]), ("about", 50, ["about", "welcome", "mission"]), ("admissions", 40, ["admission", "fees"]),
]
# Words beside "career" on pages for pupils.
FOR_PUPILS = ["universit", "college", "guidance", "advice", "advis", "counsel", "programme", "education", "fair", "student"]


def link_worth(url: Column, text: Column) -> Column:
    """struct(score, tag): how early a link is worth reading and for what; null for none. Careers pages for pupils come late."""
    hay = F.lower(F.concat_ws(" ", url, text))
    of = lambda score, tag: F.struct(F.lit(score).alias("score"), F.lit(tag).alias("tag"))
    pupils = hay.contains("career") & any_of([hay.contains(w) for w in FOR_PUPILS])
    ladder = F.when(pupils, of(35, "about"))
    for tag, score, words in LINK_WORTH:
        ladder = ladder.when(any_of([hay.contains(w) for w in words]), of(score, tag))
    return ladder


def country_table(spark) -> DataFrame:
    """(code, name, slug) of all ISO 3166 countries, as the Java runtime names them in English: a bounded dimension."""
    from wrenfield.functions.text import slug

    locale = spark._jvm.java.util.Locale
    rows = [(str(c), str(locale("", c).getDisplayCountry(locale.ENGLISH))) for c in locale.getISOCountries()]
    return spark.createDataFrame(rows, "code string, name string").withColumn("slug", slug(F.col("name")))


def with_country(rows: DataFrame, column: str, countries: DataFrame) -> DataFrame:
    """``rows`` with country_code and country_name of the country written in ``column`` (a code or an English name in any
    spelling of case and signs); an unknown one keeps its text as name and has no code. ``countries`` is ``country_table``."""
    from wrenfield.functions.text import slug

    spelled = F.trim(F.col(column))
    keys = countries.select(F.lower("code").alias("_k"), F.col("code").alias("_code"), F.col("name").alias("_name")).union(countries.select("slug", "code", "name")).dropDuplicates(["_k"])
    keyed = rows.withColumn("_s", F.when(spelled.rlike("^[A-Za-z]{2}$"), F.lower(spelled)).otherwise(slug(spelled)))
    joined = keyed.join(keys, F.col("_s") == F.col("_k"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], F.col("_code").alias("country_code"), F.coalesce("_name", spelled).alias("country_name"))
