"""Problem 3: best representative of each duplicate group."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenfield.functions.addresses import host_of, mail_host_of, mail_of
from wrenfield.llm.names import EMPTY_WORDS, GIVEN_NAMES, KIND_WORDS
from wrenfield.session import spooled

# First labels of hosts that stand for "put your own here".
PLACEHOLDERS = "domain yourdomain mydomain example email youremail mysite yoursite website yourwebsite company yourcompany test sample localhost site".split()
FILE_ENDINGS = r"\.(png|jpe?g|gif|svg|webp|css|js|ico|pdf)$"


def tokens_of(value: str) -> list[str]:
    return re.findall(r"[a-z0-9]+|[^a-z0-9]", value.lower())


def aligned(profile: list[dict[str, float]], tokens: list[str], weight: float) -> list[dict[str, float]]:
    """``profile`` (columns of token weights, "" for a gap) with one more sequence, by global alignment: a column is met at
    the gain of the token's weight in it, a gap costs nothing but gains only the column's gap weight."""
    n, m, total = len(profile), len(tokens), sum(profile[0].values()) if profile else 0.0
    score = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        score[i][0] = score[i - 1][0] + profile[i - 1].get("", 0.0)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            score[i][j] = max(score[i - 1][j - 1] + profile[i - 1].get(tokens[j - 1], 0.0) + 1e-9, score[i - 1][j] + profile[i - 1].get("", 0.0), score[i][j - 1])
    out, i, j = [], n, m
    while i or j:
        if i and j and score[i][j] == score[i - 1][j - 1] + profile[i - 1].get(tokens[j - 1], 0.0) + 1e-9:
            i, j, column, token = i - 1, j - 1, dict(profile[i - 1]), tokens[j - 1]
        elif i and (not j or score[i][j] == score[i - 1][j] + profile[i - 1].get("", 0.0)):
            i, column, token = i - 1, dict(profile[i - 1]), ""
        else:
            j, column, token = j - 1, {"": total}, tokens[j - 1]
        column[token] = column.get(token, 0.0) + weight
        out.append(column)
    return out[::-1]


def consensus(values: list[str], weights: list[float]) -> str:
    """The one of ``values`` closest to their token-level consensus: sequences are aligned progressively, heaviest first, each
    column votes by weight, and the value that shares most weight with the winning columns is taken (ties: the heavier,
    then the larger)."""
    order = sorted(range(len(values)), key=lambda i: (-weights[i], values[i]))
    profile: list[dict[str, float]] = []
    for i in order:
        tokens = tokens_of(values[i])
        profile = aligned(profile, tokens, weights[i]) if profile else [{t: weights[i]} for t in tokens]
    winners = [max(c.items(), key=lambda kv: (kv[1], kv[0]))[0] for c in profile]
    target = [w for w in winners if w]

    return values[min(order, key=lambda i: (_token_edits(tokens_of(values[i]), target), -weights[i], [-ord(c) for c in values[i]]))]


def _token_edits(have: list[str], target: list[str]) -> int:
    row = list(range(len(target) + 1))
    for i, x in enumerate(have, 1):
        new = [i]
        for j, y in enumerate(target, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


#: Days in which a value of a field loses half its weight: addresses of people change sooner than those of sites.
HALF_LIFE = {"website": 90.0, "school_email": 60.0, "career_email": 45.0}
#: The weight that age leaves at least, that of values without a time too; confidence that is lower by NEAR costs nothing, by
#: FAR all but DISTRUST, which is less than anything that age does.
OLDEST, NEAR, FAR, DISTRUST = 0.05, 0.1, 0.3, 0.001
#: Values that meet in one vote, about.
MEET = 64


def vote_weight(field: Column, confidence: Column, best: Column, at: Column, latest: Column, half_life: dict[str, float] | None = None) -> Column:
    """The weight of a value: trust by how much its confidence is below the group's best, times recency by its age against the
    group's latest."""
    half = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in (half_life or HALF_LIFE).items() for x in kv]), field), F.lit(60.0))
    behind = F.greatest(F.least((best - confidence - NEAR - 1e-9) / (FAR - NEAR), F.lit(1.0)), F.lit(0.0))
    age = (F.unix_micros(latest) - F.unix_micros(at)) / 86_400e6
    return F.pow(F.lit(DISTRUST), behind) * F.greatest(F.coalesce(F.pow(F.lit(2.0), -age / half), F.lit(0.0)), F.lit(OLDEST))


def representatives(candidates: DataFrame, *, half_life: dict[str, float] | None = None) -> DataFrame:
    """(key, field, value): one existing value for each group of ``candidates`` (key, field, value, confidence, at).

    Each distinct value votes once for its tokens, with the most that its records give it (``vote_weight``; null confidences
    are 0): one clearly higher confidence outweighs, of two alike the later, and several that agree in their tokens outvote one
    that is a little later. Null values and keys have no part.

    Up to about ``MEET`` values meet in one vote. Larger groups are a tournament: values meet in hash chunks of that size,
    and each chunk's survivor goes on with the weight of its chunk, in as many rounds as the largest group needs.
    """
    one = candidates.where("key is not null and value is not null").select("key", "field", "value", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "at")
    best = one.groupBy("key", "field").agg(F.max("confidence").alias("best"), F.max("at").alias("latest"))
    weight = vote_weight(F.col("field"), F.col("confidence"), F.col("best"), F.col("at"), F.col("latest"), half_life)
    alive = one.join(best, ["key", "field"]).groupBy("key", "field", "value").agg(F.max(weight).alias("weight"))
    sizes = alive.groupBy("key", "field").agg(F.count("*").alias("n"))

    @F.pandas_udf("string")
    def vote(groups: pd.Series) -> pd.Series:
        return groups.map(lambda g: None if len(g) == 0 else consensus([x["value"] for x in g], [x["weight"] for x in g]))

    def met(rows: DataFrame, *by: str) -> DataFrame:
        group = rows.groupBy("key", "field", *by).agg(F.array_sort(F.collect_list(F.struct("weight", "value"))).alias("g"), F.sum("weight").alias("weight"))
        # Groups of one value need no vote; the UDF sees an empty list for them.
        many = F.when(F.size("g") > 1, F.col("g")).otherwise(F.array().cast("array<struct<weight:double,value:string>>"))
        return group.select("key", "field", *by[1:], F.when(F.size("g") > 1, vote(many)).otherwise(F.col("g")[0]["value"]).alias("value"), "weight")

    sized = spooled(alive.join(sizes, ["key", "field"]))
    most = sized.agg(F.max("n")).first()[0] or 0
    chosen = met(sized.where(F.col("n") <= MEET)).select("key", "field", "value")
    if most > MEET:
        large, level = sized.where(F.col("n") > MEET), 0
        while level == 0 or MEET**level < most:
            level += 1
            chunk = F.pmod(F.xxhash64("value", F.lit(level)), F.greatest(F.ceil(F.col("n") / MEET**level), F.lit(1)))
            large = met(large.withColumn("chunk", chunk), "chunk", "n")
        chosen = chosen.unionByName(large.select("key", "field", "value"))
    return chosen


def family_of(key: Column) -> Column:
    """What sister schools share: the words of a key that tell neither kind nor given name nor country."""
    common = sorted({*KIND_WORDS, *EMPTY_WORDS, *GIVEN_NAMES})
    return F.array_join(F.array_except(F.split(F.split(key, r"\|")[0], "-"), F.array(*[F.lit(w) for w in common])), " ")


def usable_addresses(schools: DataFrame) -> DataFrame:
    """(key, field, value, confidence, at) of records' addresses that are whole, no placeholder and no recruitment host.

    A host that serves schools of two families or more is a recruitment host; sister schools may share theirs.
    """
    fields = {"website": "website", "school_email": "schoolEmail", "career_email": "careerEmail"}
    provenance = F.from_json("provenance_json", "map<string,struct<confidence:double,source:string>>")
    read = schools.where("school_key is not null").select(F.col("school_key").alias("key"), "rec_id", "enriched_at", *fields, provenance.alias("p"))
    rows = read.select(
        "key", "enriched_at", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("raw"), F.try_element_at("p", F.lit(j))["confidence"].alias("confidence")) for f, j in fields.items()])).alias("x")
    ).select("key", "enriched_at", "x.*")
    site = F.col("field") == "website"
    rows = rows.select(
        "key", "field", F.col("enriched_at").alias("at"), "confidence",
        F.when(site, host_of(F.col("raw"))).otherwise(mail_of(F.col("raw"))).alias("value"), F.when(site, host_of(F.col("raw"))).otherwise(mail_host_of(F.col("raw"))).alias("host"),
    ).where("value is not null")
    own = ~F.split("host", r"\.")[0].isin(*PLACEHOLDERS) & ~F.col("host").rlike(FILE_ENDINGS)
    rows = rows.where(own)
    serving = rows.select("host", family_of(F.col("key")).alias("family")).distinct().groupBy("host").agg(F.count("*").alias("families")).where("families > 1")
    return rows.join(serving, "host", "left_anti").select("key", "field", "value", "confidence", "at")


def surviving_addresses(schools: DataFrame) -> DataFrame:
    """(school_key, field, value) for schools of two or more distinct records."""
    several = schools.where("school_key is not null and rec_id is not null").select("school_key", "rec_id").distinct().groupBy("school_key").agg(F.count("*").alias("n")).where("n > 1")
    best = representatives(usable_addresses(schools))
    return best.withColumnRenamed("key", "school_key").join(several, "school_key", "left_semi")
