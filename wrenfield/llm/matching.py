"""Problem 6: matching entities across sources without keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenfield.functions.steps import fenced
from wrenfield.session import spooled

#: Two spelling errors in a name change at most so many bits of 64.
RADIUS = 8
#: Weights of the fields in the score.
WEIGHTS = {"name": 6.0, "domain": 4.0, "country": 2.0, "place": 2.0}


def qgrams(text: Column) -> Column:
    """The distinct pairs of letters, with both ends marked."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(marked, i, F.lit(2))))


def bit_vector(grams: Column) -> Column:
    """64 bits, one set by each q-gram."""
    return F.aggregate(grams, F.lit(0).cast("bigint"), lambda v, g: v.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(g), F.lit(64)).cast("int"))))


def vector_dice(a: Column, b: Column) -> Column:
    """The Dice of two texts by the bit vectors of their q-grams; 1 for equal ones, null if either is null."""
    x, y = bit_vector(qgrams(a)), bit_vector(qgrams(b))
    return F.when(a == b, 1.0).otherwise(2.0 * F.bit_count(x.bitwiseAND(y)) / (F.bit_count(x) + F.bit_count(y)))


def vector_chunks(vector: Column, radius: int = RADIUS) -> Column:
    """(chunk, bits): radius + 1 pieces of the vector; vectors within the radius have one in common."""
    parts = radius + 1
    cuts = [64 * i // parts for i in range(parts + 1)]
    piece = lambda a, b: F.shiftrightunsigned(vector, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("bigint"))
    return F.array(*[F.struct(F.lit(i).alias("chunk"), piece(a, b).alias("bits")) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])


def hamming_pairs(left: DataFrame, right: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(kind, proper, other, dice): names of ``left`` and ``right`` (both kind, proper) of one kind whose vectors differ in at
    most ``radius`` bits, exactly: multi-index hashing on chunks, verified on whole vectors; with the Dice of their q-grams."""
    coded = lambda df: df.select("kind", "proper").distinct().withColumn("grams", qgrams(F.col("proper"))).withColumn("vector", bit_vector(F.col("grams")))
    a, b = coded(left), coded(right)
    by = ["kind", "chunk", "bits"]
    spread = lambda df: df.select("kind", "proper", "vector", F.explode(vector_chunks(F.col("vector"), radius)).alias("c")).select("kind", "proper", "vector", "c.*")
    probes, index = spread(a), spread(b).withColumnsRenamed({"proper": "other", "vector": "own"})
    # Frequent bits are split: their index by salts of a few hundred rows, and each probe goes to every salt.
    salts = index.groupBy(*by).agg(F.ceil(F.count("*") / 200).cast("int").alias("salts"))
    index = index.join(salts, by).withColumn("salt", F.pmod(F.xxhash64("other"), F.col("salts")).cast("int")).select(*by, "salt", "other", "own")
    probes = probes.join(salts, by).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(*by, "salt", "proper", "vector")
    # Few bytes for much work: adaptive execution isn't to put them into one task.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    probes, index = probes.repartition(tasks, *by, "salt"), index.repartition(tasks, *by, "salt")
    close = probes.hint("shuffle_hash").join(index, [*by, "salt"]).where(F.bit_count(F.col("vector").bitwiseXOR(F.col("own"))) <= radius)
    # Fenced, so that what is asked of a pair later isn't computed for all that share a chunk.
    pairs = fenced(close.select("kind", "proper", "other").distinct())
    x, y = qgrams(F.col("proper")), qgrams(F.col("other"))
    return pairs.withColumn("dice", 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def with_only_kind(named: DataFrame, names: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``named`` (id, kind, proper) with kinds for names whose kind is missing or cut off: the one kind that ``names`` (kind,
    proper) have with the same proper part or, if none has it, with those that it may be a misspelling or the beginning of.
    Rows with kind '' stay too, to meet schools that have no kind either."""
    typed = names.where("kind <> ''").select("kind", "proper").distinct()
    bare = named.where("kind = ''").select("id", "proper")
    probes = bare.select(F.lit("").alias("kind"), "proper").distinct()
    # All kinds are met as one, so that chunks and bits alone decide.
    met = hamming_pairs(probes, typed.select(F.lit("").alias("kind"), "proper"), radius).select("proper", "other")
    apart = F.levenshtein("proper", "other", 2)
    met = spooled(met.withColumn("edits", F.when(apart >= 0, apart).when((F.length("proper") >= 4) & F.startswith("other", "proper"), 2)).where("edits is not null"))
    least = met.groupBy("proper").agg(F.min(F.least("edits", F.lit(1))).alias("least"))
    near = met.join(least, "proper").where(F.least("edits", F.lit(1)) == F.col("least")).select("proper", "other")
    only = spooled(near.join(typed.withColumnRenamed("proper", "other"), "other").groupBy("proper").agg(F.count_distinct("kind").alias("n"), F.min("kind").alias("kind")).where("n = 1").select("proper", "kind"))
    return named.unionByName(bare.join(only, "proper").select("id", "kind", "proper"))


def candidates(adverts: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, key, score): every school that an advert may belong to.

    ``adverts``: id, kinds, proper, country, place, domains. ``entities``: rows of key, kind, proper, country, place, domain
    (each may be null; several rows a key). An advert meets schools by close names of one kind and by a web or mail domain
    that belongs to one school only; a name without a kind has that of the schools it is close to, if they have but one
    (``with_only_kind``); one that names a school isn't met by domain alone if the kinds differ. Close names are
    checked by edit distance, and by country and place where they differ at all. What close names, their kinds and pairs by name
    come to is written once each (``spooled``), so the driver never plans all of it at a time. The score is the weighted mean over the fields that both sides have: the Dice of
    the q-grams of names, countries and places, and whether the domain is the school's own.
    """
    named = adverts.where("proper <> ''").select("id", F.explode("kinds").alias("kind"), "proper")
    names = entities.where("proper <> ''").select("key", "kind", F.col("proper").alias("other")).distinct()
    named = with_only_kind(named, names.select("kind", F.col("other").alias("proper")))
    close = hamming_pairs(named, names.select("kind", F.col("other").alias("proper")))
    # Close vectors may belong to other names: two edits, or a cut end, are what one name may differ by.
    apart = F.levenshtein("proper", "other", 2)
    close = spooled(close.withColumn("edits", F.when(apart >= 0, apart).when((F.length("proper") >= 4) & F.startswith("other", "proper"), 2)).where("edits is not null"))
    by_name = spooled(named.join(close, ["kind", "proper"]).join(names, ["kind", "other"]).groupBy("id", "key").agg(F.max("dice").alias("name"), F.min("edits").alias("edits")))
    owners = entities.where("domain is not null").select("domain", "key").distinct()
    owned = owners.groupBy("domain").agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n = 1").select("domain", "key")
    by_domain = adverts.select("id", "kinds", "proper", F.explode("domains").alias("domain")).join(owned, "domain").select("id", "key", "kinds", "proper").distinct()
    kinds = entities.groupBy("key").agg(F.collect_set("kind").alias("own_kinds"), F.collect_set("country").alias("countries"), F.collect_set("place").alias("places"))
    fits = F.coalesce(F.col("proper") == "", F.lit(True)) | F.arrays_overlap("kinds", "own_kinds") | (F.array_join("kinds", "") == "")
    by_domain = by_domain.join(kinds.select("key", "own_kinds"), "key").where(fits).select("id", "key", F.lit(1.0).alias("domain"))
    both = by_name.join(by_domain, ["id", "key"], "full").join(kinds, "key").join(adverts.select("id", "country", "place", "proper"), "id")
    w = {k: F.lit(v) for k, v in WEIGHTS.items()}
    # Of several values of a school the closest counts.
    inside = lambda v, s: F.when(F.col(v).isNotNull() & (F.size(s) > 0), F.array_max(F.transform(s, lambda x: vector_dice(F.col(v), x))))
    sims = {
        "name": F.when(F.coalesce("proper", F.lit("")) != "", F.coalesce("name", F.lit(0.25))),
        "domain": F.col("domain"),
        "country": inside("country", "countries"),
        "place": inside("place", "places"),
    }
    # A name that isn't spelled the same belongs to the school only if country and place don't speak against it.
    agrees = lambda v, s: F.col(v).isNull() | (F.size(s) == 0) | F.array_contains(s, F.col(v))
    both = both.where(F.col("domain").isNotNull() | (F.col("edits") == 0) | (agrees("country", "countries") & agrees("place", "places")))
    total = sum(F.when(s.isNotNull(), w[k]).otherwise(0.0) for k, s in sims.items())
    return both.select("id", "key", (sum(F.coalesce(s * w[k], F.lit(0.0)) for k, s in sims.items()) / total).alias("score"))


def calibration(scored: DataFrame, labels: DataFrame, bins: int = 40) -> list[float]:
    """The share of right ones among the best candidates of labelled adverts by score bin, made monotone. ``labels`` has id
    and key. ``bins`` numbers come to the driver; bins without labels take those below, before any 0."""
    top = scored.groupBy("id").agg(F.max(F.struct("score", "key")).alias("top")).select("id", "top.score", "top.key")
    best = top.join(labels.withColumnRenamed("key", "true_key"), "id")
    at = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    rows = best.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.sum((F.col("key") == F.col("true_key")).cast("int")).alias("right")).collect()
    counts = {r.bin: (r.right, r.n) for r in rows}
    blocks: list[list[float]] = []  # pool adjacent violators
    for b in range(bins):
        right, n = counts.get(b, (0, 0))
        blocks.append([right + 0.5 * (b / bins), n + 0.5, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
            c = blocks.pop()
            blocks[-1] = [blocks[-1][0] + c[0], blocks[-1][1] + c[1], blocks[-1][2] + c[2]]
    return [r / n for r, n, width in blocks for _ in range(int(width))]


def matched(scored: DataFrame, confidences: list[float], least: float = 0.5) -> DataFrame:
    """(id, key, score, confidence): the best candidate of each advert, if its confidence is at least ``least`` and no other
    school scores the same."""
    bins = len(confidences)
    top = scored.groupBy("id").agg(F.max("score").alias("best"))
    ties = scored.join(top, "id").where("score >= best - 1e-9").groupBy("id").agg(F.count_distinct("key").alias("n"), F.max("key").alias("key"), F.max("score").alias("score"))
    table = F.array(*[F.lit(float(c)) for c in confidences])
    confidence = F.element_at(table, F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int") + 1)
    return ties.where("n = 1").select("id", "key", "score", F.round(confidence, 4).alias("confidence")).where(F.col("confidence") >= least)
