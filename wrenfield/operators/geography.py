"""Free spellings of countries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wrenfield.functions.lookup import lookup

# Other names of countries, in lower case, and their ISO 3166 codes.
COUNTRY_SPELLINGS = {
    "uk": "GB", "u.k.": "GB", "great britain": "GB", "britain": "GB", "england": "GB", "scotland": "GB", "wales": "GB",
    "uae": "AE", "u.a.e.": "AE", "utd arab emirates": "AE", "emirates": "AE", "the emirates": "AE",
    "prc": "CN", "p.r.c.": "CN", "p.r. china": "CN", "pr china": "CN", "china (mainland)": "CN", "mainland china": "CN",
    "people's republic of china": "CN", "republic of singapore": "SG", "s'pore": "SG", "kingdom of thailand": "TH", "siam": "TH",
    "m'sia": "MY", "bharat": "IN", "republic of india": "IN", "españa": "ES", "espana": "ES", "kingdom of spain": "ES",
    "republic of france": "FR", "french republic": "FR", "state of qatar": "QA", "polska": "PL", "rep. of poland": "PL",
    "republic of poland": "PL", "deutschland": "DE", "fed. rep. of germany": "DE", "federal republic of germany": "DE",
    "viet nam": "VN", "việt nam": "VN", "nippon": "JP", "nihon": "JP", "rep. of kenya": "KE", "republic of kenya": "KE",
    "suisse": "CH", "schweiz": "CH", "svizzera": "CH", "swiss confederation": "CH",
}


def country_spelling(raw: Column) -> Column:
    """The spelling by which a country is looked up: lower case, single blanks; known other names become the ISO code."""
    spelled = F.lower(F.trim(F.regexp_replace(raw, r"[\s\u00a0]+", " ")))
    return F.coalesce(F.lower(lookup(COUNTRY_SPELLINGS, spelled)), spelled)
