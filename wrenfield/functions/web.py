"""Links, robots rules, protected addresses and locations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenfield.functions.text import slug

# Hosts of social networks.
SOCIAL_HOSTS = {"facebook.com": "facebook", "instagram.com": "instagram", "linkedin.com": "linkedin", "twitter.com": "x", "x.com": "x", "youtube.com": "youtube"}


def robots_allow(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, allowed): the longest pattern that fits a path decides, an allowing one before a forbidding one of its
    length; no pattern allows. ``rules`` has host, pattern and allow; ``*`` stands for anything, a final ``$`` for the end;
    empty patterns are no rules."""
    quoted = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace("pattern", r"([.+?(){}\[\]|^\\$])", r"\\$1"), r"\*", ".*"), r"\\\$$", "\\$"))
    prepared = rules.where("pattern <> ''").select(F.col("host").alias("_h"), quoted.alias("_re"), F.length("pattern").alias("_len"), "allow")
    hit = paths.join(prepared, (F.col("host") == F.col("_h")) & F.expr("path rlike _re"), "left")
    best = hit.groupBy("host", "path").agg(F.max_by("allow", F.struct("_len", F.col("allow").cast("int"))).alias("a"))
    return best.select("host", "path", F.coalesce("a", F.lit(True)).alias("allowed"))


def unprotected_email(code: Column) -> Column:
    """A mail address from its protected form: hex bytes that are xored with the first; null if it is none."""
    n = F.floor(F.length(code) / 2).cast("int")
    byte = lambda i: F.conv(F.substring(code, 2 * i - 1, F.lit(2)), 16, 10).cast("int")
    key = F.conv(F.substring(code, 1, 2), 16, 10).cast("int")
    text = F.array_join(F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: F.chr(byte(i).bitwiseXOR(key))), "")
    return F.when(code.rlike("^(?:[0-9a-fA-F]{2}){4,}$") & text.contains("@"), text)


def social_network(host: Column, path: Column) -> Column:
    """The network of an account's address; null for other hosts and for paths that are no account (share, intent, a lone video)."""
    base = F.regexp_replace(host, r"^(?:www|m|[a-z]{2})\.", "")
    network = reduce(lambda c, kv: c.when(base == kv[0], kv[1]), list(SOCIAL_HOSTS.items())[1:], F.when(base == next(iter(SOCIAL_HOSTS)), SOCIAL_HOSTS[next(iter(SOCIAL_HOSTS))]))
    return F.when(~path.rlike(r"(?i)^/*(?:(?:share|sharer|intent|watch|hashtag|search|login|home)(?:\.php)?(?:[/?].*)?)?$"), network)


def resolved_location(text: Column, countries: dict[str, str], cities: dict[str, str]) -> Column:
    """struct(country, city) of a written place: segments are tried from the right for a country's slug, then any for a
    city's, whose country is known; else the last segment is the country. Both tables are closed lists."""
    from wrenfield.functions.lookup import lookup

    parts = F.filter(F.transform(F.split(text, r"\s*[,;/|]\s*"), F.trim), lambda p: p != "")
    slugs = F.transform(parts, slug)
    named = F.filter(F.transform(F.reverse(slugs), lambda s: lookup(countries, s)), lambda c: c.isNotNull())
    towns = F.filter(slugs, lambda s: lookup(cities, s).isNotNull())
    town = F.try_element_at(towns, F.lit(1))
    country = F.coalesce(F.try_element_at(named, F.lit(1)), lookup(cities, town), F.try_element_at(parts, F.lit(-1)))
    other = F.filter(parts, lambda p: lookup(countries, slug(p)).isNull())
    first = F.try_element_at(other, F.lit(1))
    return F.struct(country.alias("country"), F.when(first != country, first).alias("city"))
