"""Facts told in running text: figures by patterns in order of trust, best sentences, names on pages, points with reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenfield.functions.text import without_accents
from wrenfield.operators.identity import role_of, same_role

# Numbers that are written as words.
NUMBER_WORDS = {w: i for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve".split(), 1)}


def told_figure(text: Column, patterns: list[tuple[str, float]], *, least: int, most: int) -> Column:
    """struct(value, trust): the figure that the first pattern which matches has as its first group, in digits (with separators
    of thousands) or as a word; null if none matches or the figure is implausible. Patterns are tried in order of trust."""

    def read(group: Column) -> Column:
        word = F.coalesce(*[F.when(F.lower(group) == w, n) for w, n in NUMBER_WORDS.items()])
        return F.coalesce(F.regexp_replace(group, "[, ]", "").try_cast("bigint"), word.cast("bigint"))

    def one(pattern: str, trust: float) -> Column:
        value = read(F.regexp_extract(text, pattern, 1))
        return F.when(value.between(least, most), F.struct(value.alias("value"), F.lit(trust).alias("trust")))

    return F.coalesce(*[one(p, t) for p, t in patterns])


ROLL = [(r"(?i)(\d{1,3}(?:,\d{3})+|\d{2,5}) on roll", 0.9), (r"(?i)school of (\d{1,3}(?:,\d{3})+|\d{2,5}) (?:pupils|students)", 0.85), (r"(?i)(\d{1,3}(?:,\d{3})+|\d{2,5}) (?:pupils|students|children)", 0.6)]
TEAM = [(r"(?i)department has (\d{1,2}|[a-z]+) specialists", 0.9), (r"(?i)team of (\d{1,2}|[a-z]+)\b", 0.7), (r"(?i)(\d{1,2}) (?:PE|sports?) teachers", 0.6)]


def student_count(text: Column) -> Column:
    """The roll that a text states, 20 to 20,000."""
    return told_figure(text, ROLL, least=20, most=20_000)


def team_size(text: Column) -> Column:
    """The size of the team that a text states, 1 to 60."""
    return told_figure(text, TEAM, least=1, most=60)


def best_sentence(rows: DataFrame, key: str, text: str, priorities: list[tuple[str, int]]) -> DataFrame:
    """(``key``, sentence, priority): of each row's sentences the one whose pattern counts most, the first of equals; rows
    without any give none. Sentences end at a stop and a blank, or a line's end."""
    parts = rows.select(key, F.posexplode(F.split(text, r"(?<=[.!?])\s+|\n+")).alias("at", "sentence"))
    counts = F.greatest(*[F.when(F.col("sentence").rlike(p), n).otherwise(0) for p, n in priorities], F.lit(0))
    told = parts.withColumn("priority", counts).where("priority > 0")
    best = told.groupBy(key).agg(F.max(F.struct("priority", (-F.col("at")).alias("at"))).alias("b"))
    return told.join(best, key).where((F.col("priority") == F.col("b.priority")) & (F.col("at") == -F.col("b.at"))).select(key, "sentence", "priority")


# Words of names that tell no school, and words that pages of schools are full of.
COMMON = "school schools international academy college british american world primary secondary high grammar bilingual community preparatory senior the and of for".split()
SCHOOLISH = "school academy college student students pupil pupils curriculum admissions campus teacher teachers classroom classrooms".split()


def plain_words(text: Column) -> Column:
    return F.filter(F.split(without_accents(F.lower(text)), "[^a-z0-9]+"), lambda w: w != "")


def page_is_school(text: Column, name: Column, share: float = 0.6) -> Column:
    """If a page is that of the school of a name: it has at least ``share`` of the name's telling words, and four words of
    schools, two of them different. A name without a telling word is on no page."""
    words = plain_words(text)
    telling = F.array_distinct(F.filter(plain_words(name), lambda w: (F.length(w) > 2) & ~w.isin(*COMMON)))
    found = F.size(F.array_intersect(telling, words))
    schoolish = F.filter(words, lambda w: w.isin(*SCHOOLISH))
    return F.coalesce((F.size(telling) > 0) & (found >= F.size(telling) * share) & (F.size(schoolish) >= 4) & (F.size(F.array_distinct(schoolish)) >= 2), F.lit(False))


def points(rules: dict[str, tuple[Column, int]]) -> Column:
    """struct(score, why): the sum of the points of the rules that hold, and their names."""
    score = reduce(lambda a, b: a + b, [F.when(holds, n).otherwise(0) for holds, n in rules.values()])
    return F.struct(score.alias("score"), F.array_compact(F.array(*[F.when(holds, name) for name, (holds, _) in rules.items()])).alias("why"))


def decided_before(adverts: DataFrame, ledger: DataFrame) -> DataFrame:
    """(id, entry): of each of ``adverts`` (id, dedupe_key, school_key, title) the least entry of ``ledger`` (entry, dedupe_key,
    school_key, title) that is the same position: by its key or, failing that, at the same school for the same role. Roles
    are a few kinds a school, so entries meet as one row a school and role; adverts without a match have no row."""
    exact = adverts.join(ledger.groupBy("dedupe_key").agg(F.min("entry").alias("exact")), "dedupe_key", "left")
    held = ledger.where("school_key is not null").select("school_key", role_of(F.col("title")).alias("b"), "entry").groupBy("school_key", "b").agg(F.min("entry").alias("like"))
    asked = exact.where("exact is null and school_key is not null").select("id", "school_key", role_of(F.col("title")).alias("a"))
    like = asked.join(held, "school_key").where(same_role(F.col("a"), F.col("b"))).groupBy("id").agg(F.min("like").alias("entry"))
    return exact.where("exact is not null").groupBy("id").agg(F.min("exact").alias("entry")).unionByName(like)
