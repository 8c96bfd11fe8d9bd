"""Problem 1: quantities recorded in different units.

The physical identity is

    US dollars a year = figure x scale x periods a year x dollars per unit of currency

Whatever a record states fixes a factor; what it leaves open (is ``31.500`` a decimal or are there thousands, how many
minor units has a currency) makes several candidates, of which the one with the least log residual against the level of
the unambiguous records is taken. Records whose second candidate comes close are flagged as not unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenfield.functions.lookup import lookup
from wrenfield.functions.steps import fenced, step

# Names and signs of currencies, in lower case, and their ISO 4217 codes. "$" alone is the US dollar.
CURRENCY_NAMES = {
    "€": "EUR", "euros": "EUR", "euro": "EUR", "£": "GBP", "pounds sterling": "GBP", "pound sterling": "GBP", "pounds": "GBP", "sterling": "GBP",
    "$": "USD", "us$": "USD", "us dollars": "USD", "us dollar": "USD", "dollars": "USD", "dirhams": "AED", "dirham": "AED", "dhs": "AED", "dh": "AED",
    "s$": "SGD", "singapore dollars": "SGD", "baht": "THB", "฿": "THB", "qr": "QAR", "qatari riyals": "QAR", "qatari riyal": "QAR",
    "rmb": "CNY", "yuan": "CNY", "renminbi": "CNY", "cn¥": "CNY", "元": "CNY", "₫": "VND", "dong": "VND", "đ": "VND", "₹": "INR", "rs.": "INR", "rs": "INR",
    "rupees": "INR", "indian rupees": "INR", "ringgit": "MYR", "rm": "MYR", "yen": "JPY", "jp¥": "JPY", "円": "JPY", "zloty": "PLN", "zlotys": "PLN",
    "złoty": "PLN", "zł": "PLN", "swiss francs": "CHF", "francs": "CHF", "sfr.": "CHF", "sfr": "CHF", "fr.": "CHF", "ksh": "KES", "kshs": "KES",
    "kenya shillings": "KES", "kenyan shillings": "KES", "shillings": "KES", "omani rials": "OMR", "omani rial": "OMR", "r.o.": "OMR",
}

# ISO 4217 codes that stand for themselves in any case.
CURRENCY_CODES = "AED AUD BHD CAD CHF CNY CZK DKK EUR GBP HKD HUF IDR INR JPY KES KRW KWD MYR NOK NZD OMR PHP PLN QAR SAR SEK SGD THB TRY TWD USD VND ZAR"

# Wordings of pay periods, in lower case.
PERIOD_NAMES = {
    "ANNUALLY": "annually|annual|yearly|year|a year|per year|per annum|p.a.|pa|/yr|/year|/annum|each year|every year",
    "TERMLY": "termly|term|a term|per term|each term|/term|every term",
    "MONTHLY": "monthly|month|a month|per month|each month|p.m.|pcm|pm|/month|/mo|/mth|every month",
    "WEEKLY": "weekly|week|a week|per week|each week|p.w.|pw|/week|/wk|every week",
    "DAILY": "daily|day|a day|per day|each day|daily rate|day rate|/day|p.d.|per diem",
    "HOURLY": "hourly|hour|an hour|per hour|each hour|/hr|/hour|/h|p.h.|hourly rate",
}

# Words after a figure and what they multiply it by.
MULTIPLIERS = {"k": 1e3, "thousand": 1e3, "thou": 1e3, "m": 1e6, "mn": 1e6, "mio": 1e6, "million": 1e6, "bn": 1e9, "billion": 1e9, "lakh": 1e5, "lakhs": 1e5, "crore": 1e7, "万": 1e4, "萬": 1e4}

# Names of minor units; how many make one unit is 100 but for the listed currencies.
MINOR_UNITS = r"cents?|pence|fils|sen|paise|paisa|grosz|groszy|rappen|centimes?|baisa|minor units?|satang|fen"
MINOR_DIGITS = {"JPY": 0, "VND": 0, "OMR": 3}

NUMBER = r"\d{1,3}(?:[.,'’ ]\d{3})+(?:[.,]\d{1,2})?(?!\d)|\d+(?:[.,]\d+)?"


def _either(words: list[str]) -> str:
    """Alternatives, longest first; a word that ends in a letter must end there."""
    quoted = [("".join("\\" + c if c in r".$/|()[]+*?^" else c for c in w), w) for w in sorted(set(words), key=lambda w: (-len(w), w))]
    return "|".join(q + (r"(?![\p{L}])" if w[-1].isalpha() and w.isascii() else "") for q, w in quoted)


PERIOD = _either([w for names in PERIOD_NAMES.values() for w in names.split("|") if w not in ("year", "month", "week", "day", "hour", "term", "annual")])
CURRENCY = _either([*CURRENCY_NAMES, *(c.lower() for c in CURRENCY_CODES.split())])
SUFFIX = _either(list(MULTIPLIERS))
#: currency, figure, multiplier, currency, then perhaps the same again, then the period.
PAY = (
    rf"(?is)^(.*?)(?:(?<![\p{{L}}])({CURRENCY})\s?)?(?<!\d)(?<!\d[.,])({NUMBER})\s?({SUFFIX})?\s?({CURRENCY})?"
    rf"(?:\s?(?:-|–|—|to|bis)\s?({CURRENCY})?\s?({NUMBER})\s?({SUFFIX})?\s?({CURRENCY})?)?\s?({PERIOD}).*$"
)
#: Sums in words that are no pay.
NOT_PAY = r"(?i)\b(deposit|fee|fees|bonus|grant|allowance|refund|voucher|loan|budget)\b"


def currency_code(raw: Column) -> Column:
    """The ISO code of a currency's name, sign or code in any case; else null."""
    name = F.lower(F.trim(F.regexp_replace(raw, r"[\s\u00a0]+", " ")))
    return lookup(CURRENCY_NAMES | {c.lower(): c for c in CURRENCY_CODES.split()}, name)


def period_code(raw: Column) -> Column:
    return lookup({name: code for code, names in PERIOD_NAMES.items() for name in names.split("|")}, F.lower(F.trim(F.regexp_replace(raw, r"[\s\u00a0]+", " "))))


def readings(bare: Column, suffix: Column) -> Column:
    """What a written figure (without blanks and apostrophes) may mean, as an array of doubles: one, or two where its one
    separator may be of either kind."""
    times = F.coalesce(lookup(MULTIPLIERS, F.lower(suffix)).try_cast("double"), F.lit(1.0))
    plain = F.regexp_replace(bare, r"[.,]", "").try_cast("double") * times
    decimal = F.regexp_replace(F.regexp_replace(bare, r"[.,](?=.*[.,])", ""), ",", ".").try_cast("double") * times
    return (
        F.when(bare.rlike(r"^\d{1,3}([.,]\d{3}){2,}$") | bare.rlike(r"^\d+$"), F.array(plain))
        .when(bare.rlike(r"^\d{1,3}[.,]\d{3}$"), F.array(plain, decimal))
        .when(bare.rlike(r"^\d[\d.,]*$"), F.array(decimal))
    )


def bared(figure: Column) -> Column:
    return F.regexp_replace(figure, r"[\s'’\u00a0\u202f\u2009_]", "")


def scales(wording: Column, currency: Column) -> Column:
    """What a wording (in lower case) says figures must be multiplied by, as an array of candidates."""
    tens = F.when(currency.isin(*[c for c, n in MINOR_DIGITS.items() if n == 0]), F.array(F.lit(0.01), F.lit(1.0))).when(currency == "OMR", F.array(F.lit(0.01), F.lit(0.001))).otherwise(F.array(F.lit(0.01)))
    return (
        F.when(wording.rlike(rf"(?<![\p{{L}}])({MINOR_UNITS})(?![\p{{L}}])"), tens)
        .when(wording.rlike(r"(?<!\d)'?000s?(?!\d)|(?<![\p{L}])(thousands?|k)(?![\p{L}])|x ?1[ ,.]?000(?!\d)"), F.array(F.lit(1e3)))
        .when(wording.rlike(r"(?<![\p{L}])(mn|mio|millions?)(?![\p{L}])"), F.array(F.lit(1e6)))
        .otherwise(F.array(F.lit(1.0)))
    )


#: Unambiguous figures that a currency must have for a level of its own.
ENOUGH = 30


def annual_dollars(figures: DataFrame, fx: DataFrame, periods: DataFrame, *, kind: str = "tbl") -> DataFrame:
    """``figures`` with ``usd_low``, ``usd_high`` (bigint) and ``unique``.

    ``figures`` has ``lows`` and ``highs`` (arrays of readings; either may be null), ``scale`` (array of factors),
    ``currency`` (ISO code) and ``period`` (key of ``periods``). Rows without a reading, currency, period or rate are
    no cases and are left out. A lone figure is both ends; ends in the wrong order are turned round. ``unique`` is false
    where the second candidate's residual is within ln 3 of the best.

    ``fx`` and ``periods`` are dimensions of a few dozen rows: currencies and period names of the world. The level that
    residuals are taken against is the median log of the unambiguous figures of a ``kind`` and currency, over all rows, or of
    the ``kind`` where a currency has fewer than ``ENOUGH``.
    """
    rates = fx.select(F.col("currency").alias("_c"), F.col("usd_per_unit").alias("_rate")).groupBy("_c").agg(F.max("_rate").alias("_rate"))
    years = periods.select(F.col("period").alias("_p"), F.col("per_year").alias("_years")).groupBy("_p").agg(F.max("_years").alias("_years"))
    priced = (
        figures.where((F.size(F.coalesce("lows", "highs")) > 0) & F.col("currency").isNotNull() & F.col("period").isNotNull())
        .join(rates, F.col("currency") == F.col("_c"))
        .join(years, F.col("period") == F.col("_p"))
    )
    lows, highs = F.coalesce("lows", "highs"), F.coalesce("highs", "lows")
    factor = F.col("_years") * F.col("_rate")
    candidate = lambda low, high, scale: F.struct((F.least(low, high) * scale * factor).alias("low"), (F.greatest(low, high) * scale * factor).alias("high"))
    lone = F.col("lows").isNull() | F.col("highs").isNull()
    pairs = F.when(lone, F.flatten(F.transform(lows, lambda x: F.transform("scale", lambda s: candidate(x, x, s))))).otherwise(
        F.flatten(F.transform(lows, lambda x: F.flatten(F.transform(highs, lambda y: F.transform("scale", lambda s: candidate(x, y, s))))))
    )
    priced = fenced(step(priced, all=pairs))
    sure = priced.where((F.size("_all") == 1) & (F.col("_all")[0]["high"] > 0))
    # One pass: medians of kind and currency, and of kind alone (currency null), which is a dimension of a few dozen rows.
    dollars = sure.select(F.col(kind).alias("_k"), F.explode(F.array(F.col("currency"), F.lit(None).cast("string"))).alias("_lc"), F.ln(F.col("_all")[0]["high"]).alias("_x"))
    levels = dollars.groupBy("_k", "_lc").agg(F.count("*").alias("_n"), F.percentile_approx("_x", 0.5, 1000).alias("_m"))
    own = levels.where(F.col("_lc").isNotNull() & (F.col("_n") >= ENOUGH)).select("_k", "_lc", F.col("_m").alias("_own"))
    level = levels.where("_lc is null").select(F.col("_k").alias("_gk"), F.col("_m").alias("_general"))
    # Two ends of one figure are told in one unit: their own ratio counts as much as the distance from the level.
    residual = lambda c: F.abs(F.ln(F.sqrt(c["low"] * c["high"])) - F.coalesce(F.col("_level"), F.lit(10.5))) + F.ln(c["high"] / c["low"])
    scored = F.array_sort(F.transform(F.filter("_all", lambda c: c["low"] > 0), lambda c: F.struct(residual(c).alias("r"), c["low"].alias("low"), c["high"].alias("high"))))
    placed = priced.join(own, (F.col(kind) == F.col("_k")) & (F.col("currency") == F.col("_lc")), "left").join(level, F.col(kind) == F.col("_gk"), "left")
    best = step(placed.withColumn("_level", F.coalesce("_own", "_general")), best=scored)
    best = fenced(best, F.size("_best") > 0)
    second = F.try_element_at("_best", F.lit(2))
    whole = lambda x: F.floor(x + 0.5).cast("bigint")
    return best.select(
        *[F.col(c) for c in figures.columns],
        whole(F.col("_best")[0]["low"]).alias("usd_low"),
        whole(F.col("_best")[0]["high"]).alias("usd_high"),
        (second.isNull() | (second["r"] - F.col("_best")[0]["r"] > F.ln(F.lit(3.0)))).alias("unique"),
    )


def advert_figures(jobs: DataFrame, *, id: str = "id", pay: str = "salary_json") -> DataFrame:
    """The pay figures of adverts: (tbl, rec, lows, highs, scale, currency, period). Broken JSON gives no row.

    Figures in fields count before figures in words; a currency, period or scale is taken from its field, else from the words.
    Sums in words need a period, and no word before them may say that they are no pay.
    """
    col, mark = F.col, "\u0001"
    schema = "min string, max string, currency string, period string, text string, unit string, _broken string"
    o = F.from_json(col(pay), schema, {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"})
    read = jobs.where(col(pay).isNotNull() & col(id).isNotNull()).select(col(id).cast("string").alias("rec"), o.alias("o"))
    read = fenced(read, col("o").isNotNull() & col("o._broken").isNull() & F.coalesce("o.min", "o.max", "o.text").isNotNull())
    read = step(read, text=F.coalesce(F.regexp_replace("o.text", r"[\u00a0\u202f\u2009]", " "), F.lit("")), fielded=col("o.min").isNotNull() | col("o.max").isNotNull())
    read = step(read, g=F.when(~col("_fielded") & col("_text").rlike(PAY), F.split(F.regexp_replace("_text", PAY, mark.join(f"${i}" for i in range(1, 11))), mark)))
    read = fenced(read, col("_fielded") | (col("_g").isNotNull() & ~col("_g")[0].rlike(NOT_PAY)))
    has = lambda i: F.when(col("_g")[i] != "", col("_g")[i])
    ending = rf"(?i)\s*({SUFFIX})\s*$"
    read = step(
        read,
        low=bared(F.when(col("_fielded"), F.regexp_replace("o.min", ending, "")).otherwise(has(2))),
        high=bared(F.when(col("_fielded"), F.regexp_replace("o.max", ending, "")).otherwise(F.coalesce(has(6), has(2)))),
        low_suffix=F.when(col("_fielded"), F.regexp_extract("o.min", ending, 1)).otherwise(F.coalesce(has(3), has(7))),
        high_suffix=F.when(col("_fielded"), F.regexp_extract("o.max", ending, 1)).otherwise(F.coalesce(has(7), has(3))),
        currency=F.coalesce(currency_code(col("o.currency")), currency_code(F.coalesce(has(1), has(4), has(5), has(8)))),
        period=F.coalesce(period_code(col("o.period")), period_code(F.coalesce(has(9), F.when(col("_fielded"), F.regexp_extract("_text", rf"(?i)(?<![\p{{L}}])({PERIOD})", 1))))),
        wording=F.lower(F.concat_ws(" ", F.coalesce("o.unit", F.lit("")), F.when(col("_fielded"), col("_text")))),
    )
    out = read.select(
        F.lit("jobs").alias("tbl"),
        "rec",
        readings(col("_low"), col("_low_suffix")).alias("lows"),
        readings(col("_high"), col("_high_suffix")).alias("highs"),
        scales(col("_wording"), col("_currency")).alias("scale"),
        col("_currency").alias("currency"),
        col("_period").alias("period"),
    )
    return fenced(out)


def fee_figures(schools: DataFrame, *, id: str = "rec_id", low: str = "fee_low", high: str = "fee_high", unit: str = "fee_currency") -> DataFrame:
    """The fees of school records, as ``advert_figures``; fees without a period are per year."""
    named = schools.where(F.col(id).isNotNull()).select(F.col(id).cast("string").alias("rec"), F.col(low).alias("low"), F.col(high).alias("high"), F.col(unit).alias("unit"))
    read = step(named, raw=F.lower(F.trim(F.regexp_replace("unit", r"[\s\u00a0]+", " "))))
    read = step(read, lead=F.regexp_extract("_raw", rf"^({CURRENCY})", 1))
    read = step(read, rest=F.expr("substring(_raw, length(_lead) + 1)"), currency=currency_code(F.col("_lead")))
    number = lambda c: F.when(F.col(c).isNotNull(), F.array(F.col(c).cast("double")))
    out = read.select(
        F.lit("schools").alias("tbl"),
        "rec",
        number("low").alias("lows"),
        number("high").alias("highs"),
        scales(F.col("_rest"), F.col("_currency")).alias("scale"),
        F.col("_currency").alias("currency"),
        F.coalesce(period_code(F.regexp_extract("_rest", rf"({PERIOD})\s*$", 1)), F.lit("ANNUALLY")).alias("period"),
    )
    return fenced(out)
