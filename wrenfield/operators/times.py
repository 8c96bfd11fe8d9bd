"""Problem 2: mixed timestamp formats and time zones."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenfield.functions.lookup import lookup
from wrenfield.functions.steps import fenced, step

# Names of months (English, German, French, Spanish) by number, in lower case.
MONTH_NAMES = {
    1: "january jan januar januar. janvier enero ene jänner",
    2: "february feb februar février fevrier febrero",
    3: "march mar märz mrz maerz mars marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet julio",
    8: "august aug août aout agosto ago",
    9: "september sep sept septembre septiembre",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez décembre decembre diciembre dic",
}

# Abbreviations of zones and their minutes east of UTC. IST is India's, BST is Britain's, GST the Gulf's.
ZONE_MINUTES = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "bst": 60, "west": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180, "eat": 180,
    "gst": 240, "pkt": 300, "ist": 330, "ict": 420, "sgt": 480, "myt": 480, "hkt": 480, "awst": 480, "jst": 540, "kst": 540, "aest": 600,
    "aedt": 660, "nzst": 720, "nzdt": 780, "est": -300, "edt": -240, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}

WORD = r"[A-Za-zäöüéèûôÄÖÜÉÈÛÔ]+"
#: Before the date itself: a lead word, a weekday.
LEAD = rf"^(?:(?:from|on|start|starting|starts|by|until|posted|closes|deadline|ab|am|bis)\s*:?\s+)?(?:{WORD}day,?\s+|(?:Mon|Tue|Tues|Wed|Thu|Thur|Thurs|Fri|Sat|Sun)\.?,?\s+)?"
ORDINAL = r"(?:st|nd|rd|th|\.|º)?"
#: (pattern, order of its groups as year, month, day, what follows). The first that matches is taken.
DATES = [
    (rf"(?i){LEAD}(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?!\d)(.*)$", "$1|$2|$3|$4"),
    (r"^(\d{4})(\d{2})(\d{2})(T\d{4,6}.*)?$", "$1|$2|$3|$4"),
    (rf"(?i){LEAD}(\d{{1,2}})[./-](\d{{1,2}})[./-](\d{{4}}|\d{{2}})(?!\d)(.*)$", "$3|$1/$2|n|$4"),
    (rf"(?i){LEAD}(\d{{1,2}}){ORDINAL}[ -](?:of )?({WORD})\.?,?[ -](\d{{4}})(?!\d)(.*)$", "$3|$2|$1|$4"),
    (rf"(?i){LEAD}({WORD})\.? (\d{{1,2}}){ORDINAL},? (\d{{4}})(?!\d)(.*)$", "$3|$1|$2|$4"),
    (rf"(?i){LEAD}({WORD})\.?,? (\d{{4}})$", "$2|$1||"),
    (rf"(?i){LEAD}(\d{{4}})[-/](\d{{1,2}})$", "$1|$2||"),
    (rf"(?i){LEAD}(\d{{1,2}})[-/](\d{{4}})$", "$2|$1||"),
]
#: What follows a date: hour, minute, second, a.m. or p.m., zone. An hour alone needs a.m. or p.m.
TIME = r"(?i)^[T,]?\s*(?:at\s|-\s)?\s*(\d{1,2})(?:[:.h](\d{2}))?(?:[:.](\d{2}))?(?:[.,]\d+)?\s*(?:([ap])\.?m\b\.?)?\s*(.*)$"
COMPACT_TIME = r"^T(\d{2})(\d{2})(\d{2})?()(.*)$"
SHIFT = r"(?i)^(?:gmt|utc)?\s*([+-])(\d{1,2})(?::?(\d{2}))?$"


def _spans(zone: str, first_year: int, last_year: int) -> list[tuple[int, int, int]]:
    """(from, to, offset) of a zone in seconds of UTC; changes are found by steps of a week and then by halving."""
    from zoneinfo import ZoneInfo

    tz = ZoneInfo(zone)
    at = lambda s: int((datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=s)).astimezone(tz).utcoffset().total_seconds())
    begin = int(datetime(first_year, 1, 1, tzinfo=timezone.utc).timestamp()) - 2 * 86400
    end = int(datetime(last_year + 1, 1, 1, tzinfo=timezone.utc).timestamp()) + 2 * 86400
    spans, since, offset, here = [], begin, at(begin), begin
    while here < end:
        there = min(here + 7 * 86400, end)
        if at(there) != offset:
            low, high = here, there
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if at(mid) == offset else (low, mid)
            spans.append((since, high, offset))
            since, offset, here = high, at(high), high
        else:
            here = there
    spans.append((since, end, offset))
    return spans


#: Years whose intervals are listed. Before them no zone changed its offset; after them each follows a yearly rule, so a year is
#: as one of the last that begins on the same weekday and has as many days (``_TWINS``).
FIRST_YEAR, LAST_YEAR = 1830, 2100
_TWINS = {(y % 4 == 0) * 10 + datetime(y, 1, 1).isoweekday() % 7 + 1: y for y in range(2071, 2099)}


def zone_intervals(zones: DataFrame, first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> DataFrame:
    """One row per zone of ``zones`` (first column) and local year: its offset intervals ``spans`` in local seconds.

    At most 600 IANA zones x 271 years x a few intervals (about 20 MB) whatever the data, so it may be broadcast.
    Names that are no zone give no row.
    """

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for zone in batch["zone"].dropna().unique():
                try:
                    spans = _spans(zone, first_year, last_year)
                except Exception:  # an unknown key, or a name that is no path
                    continue
                year = lambda s: (datetime(1970, 1, 1) + timedelta(seconds=s)).year
                by_year: dict[int, list] = {}
                for u0, u1, offset in spans:
                    # A day more on both sides: whoever falls into a gap finds the intervals beside it.
                    for y in range(year(u0 + offset - 86400), year(u1 + offset + 86400) + 1):
                        by_year.setdefault(y, []).append({"since": u0 + offset, "until": u1 + offset, "offset": offset})
                out += [(zone, y, v) for y, v in by_year.items() if first_year <= y <= last_year]
            yield pd.DataFrame(out, columns=["zone", "year", "spans"])

    one = zones.select(F.col(zones.columns[0]).alias("zone")).where("zone is not null").distinct()
    return one.mapInPandas(explode, "zone string, year int, spans array<struct<since:bigint,until:bigint,offset:int>>")


def _fields(text: Column, pattern: str, groups: int) -> Column:
    """The groups of a pattern as an array, or null; one match for all groups."""
    mark = "\u0001"
    return F.when(text.rlike(pattern), F.split(F.regexp_replace(text, pattern, mark.join(f"${i + 1}" for i in range(groups))), mark))


def parsed(rows: DataFrame, value: str, month_first: str) -> DataFrame:
    """``rows`` with what the written time ``value`` says, all null where nothing can be read.

    ``_day`` is a date, ``_month`` is yyyy-MM where no day is stated, ``_local`` the wall clock in seconds where a time of
    day is stated, ``_offset`` its minutes east of UTC where given, ``_named`` a zone named in full, ``_wants_local``
    whether it is said to be the place's own time. ``month_first`` orders purely numeric dates; an order that can't be is
    turned round.
    """
    col = F.col
    months = {name: n for n, names in MONTH_NAMES.items() for name in names.split()}

    rows = step(rows, s=F.trim(F.regexp_replace(F.col(value), r"[\s\u00a0\u202f]+", " ")))
    rows = step(
        rows,
        epoch=F.regexp_extract("_s", r"^(?:/Date\()?(-?\d{10}|-?\d{13})(?:[+-]\d{4})?(?:\)/)?$", 1),
        part=F.split(F.coalesce(*[F.when(col("_s").rlike(p), F.regexp_replace("_s", p, order)) for p, order in DATES]), r"\|", 4),
    )
    numeric = F.split(col("_part")[1], "/")
    rows = step(
        rows,
        epoch_s=F.when(col("_epoch") != "", F.floor(col("_epoch").try_cast("bigint") / F.when(F.length(F.replace("_epoch", F.lit("-"))) == 13, 1000).otherwise(1)).cast("bigint")),
        year=F.when(F.length(col("_part")[0]) <= 2, col("_part")[0].try_cast("int") + 2000).otherwise(col("_part")[0].try_cast("int")),
        pair=col("_part")[2] == "n",
        a=numeric[0].try_cast("int"),
        b=F.try_element_at(numeric, F.lit(2)).try_cast("int"),
        rest=F.coalesce(col("_part")[3], F.lit("")),
    )
    american = (col(month_first) & (col("_a") <= 12)) | (~F.coalesce(col(month_first), F.lit(False)) & (col("_b") > 12) & (col("_a") <= 12))
    rows = step(rows, american=F.coalesce(american, F.lit(False)), clock=F.coalesce(_fields(col("_rest"), COMPACT_TIME, 5), _fields(col("_rest"), TIME, 5)))
    rows = step(
        rows,
        m=F.when(col("_pair"), F.when(col("_american"), col("_a")).otherwise(col("_b"))).otherwise(F.coalesce("_a", lookup(months, F.lower(col("_part")[1])).try_cast("int"))),
        d=F.when(col("_pair"), F.when(col("_american"), col("_b")).otherwise(col("_a"))).otherwise(col("_part")[2].try_cast("int")),
        hour=col("_clock")[0].try_cast("int"),
        minute=col("_clock")[1].try_cast("int"),
        second=F.coalesce(col("_clock")[2].try_cast("int"), F.lit(0)),
        half=F.coalesce(F.lower(col("_clock")[3]), F.lit("")),
        zone=F.trim(F.regexp_replace(col("_clock")[4], r"^\(|\)$", "")),
    )
    rows = step(
        rows,
        date=F.when(col("_year") > 0, F.try_to_date(F.format_string("%04d-%02d-%02d", "_year", "_m", "_d"), "yyyy-MM-dd")),
        h=F.when((col("_half") != "") & col("_hour").between(1, 12), col("_hour") % 12 + F.when(col("_half") == "p", 12).otherwise(0)).otherwise(col("_hour")),
        timed=F.coalesce(col("_minute").isNotNull() | (col("_half") != ""), F.lit(False)),
        shift=_fields(col("_zone"), SHIFT, 3),
    )
    rows = step(rows, good=F.coalesce(col("_timed") & col("_h").between(0, 23) & F.coalesce("_minute", F.lit(0)).between(0, 59) & col("_second").between(0, 60), F.lit(False)))
    shifted = F.when(col("_shift")[0] == "-", -1).otherwise(1) * (col("_shift")[1].try_cast("int") * 60 + F.coalesce(col("_shift")[2].try_cast("int"), F.lit(0)))
    clock = F.unix_date("_date").cast("bigint") * 86400 + col("_h") * 3600 + F.coalesce("_minute", F.lit(0)) * 60 + F.least("_second", F.lit(59))
    return step(
        rows,
        day=F.when(col("_epoch_s").isNull() & (col("_good") | ~col("_timed")), col("_date")),
        month=F.when(col("_epoch_s").isNull() & (col("_part")[2] == "") & (col("_year") > 0) & col("_m").between(1, 12), F.format_string("%04d-%02d", "_year", "_m")),
        local=F.coalesce("_epoch_s", F.when(col("_good"), clock)),
        offset=F.when(col("_epoch_s").isNotNull(), 0).otherwise(F.coalesce(F.when(col("_shift").isNotNull(), shifted), lookup(ZONE_MINUTES, F.lower("_zone")).try_cast("int"))).cast("int"),
        named=F.when(col("_zone").rlike(r"^[A-Z][A-Za-z]+/[A-Za-z_/-]+$"), col("_zone")),
        wants_local=F.coalesce(col("_zone").rlike(r"(?i)\blocal\b"), F.lit(False)),
    ).drop(*(f"_{x}" for x in "s epoch part epoch_s year pair a b rest american clock m d hour minute second half zone date h timed shift good".split()))


def normalised_times(
    rows: DataFrame,
    value: str,
    *,
    clock_zone: str,
    place_zone: str,
    month_first: str,
    intervals: DataFrame,
) -> DataFrame:
    """``rows`` with ``value`` replaced by its one unambiguous form and a column ``status``.

    Instants come out as ``yyyy-MM-ddTHH:mm:ssZ`` in UTC, days as ``yyyy-MM-dd``, months as ``yyyy-MM``, all else as null.
    ``status`` is ``instant``, ``ambiguous`` (the wall clock showed it twice: the first is taken), ``nonexistent`` (the
    clock skipped it: read with the offset before the gap), ``no_zone`` (null), ``day``, ``month`` or ``unreadable`` (null).
    A time without an offset is read on the clock of column ``clock_zone``, one that is said to be local on that of ``place_zone``.

    As-of join: the local time meets the offset intervals of its zone and year; two intervals that hold it mean
    ambiguous, none means nonexistent, one gives the offset. The interval table is bounded (see ``zone_intervals``).
    """
    read = fenced(parsed(rows, value, month_first))
    zone = F.when(F.col("_wants_local"), F.col(place_zone)).otherwise(F.coalesce("_named", clock_zone))
    read = step(read, asked=F.when(F.col("_offset").isNull() & F.col("_local").isNotNull(), zone))
    year = F.year("_day")
    new_year = F.make_date(year, F.lit(1), F.lit(1))
    twin = F.element_at(F.create_map(*[F.lit(x) for kv in _TWINS.items() for x in kv]), F.when(F.dayofyear(F.make_date(year, F.lit(12), F.lit(31))) == 366, 10).otherwise(0) + F.dayofweek(new_year))
    read = step(read, asked_year=F.when(F.col("_asked").isNotNull(), F.when(year < FIRST_YEAR, FIRST_YEAR).when(year > LAST_YEAR, twin).otherwise(year)))
    away = (F.unix_date(new_year) - F.unix_date(F.make_date(F.col("_asked_year"), F.lit(1), F.lit(1)))).cast("bigint") * 86400
    read = step(read, seen=F.when(year < FIRST_YEAR, F.lit(int(datetime(FIRST_YEAR, 1, 2, tzinfo=timezone.utc).timestamp()))).when(year > LAST_YEAR, F.col("_local") - away).otherwise(F.col("_local")))
    table = F.broadcast(intervals.select(F.col("zone").alias("_iz"), F.col("year").alias("_iy"), F.col("spans").alias("_spans")))
    met = read.join(table, (F.col("_asked") == F.col("_iz")) & (F.col("_asked_year") == F.col("_iy")), "left")
    t, seen = F.col("_local"), F.col("_seen")
    met = step(
        met,
        hits=F.array_sort(F.filter("_spans", lambda x: (x["since"] <= seen) & (seen < x["until"]))),
        before=F.array_sort(F.filter("_spans", lambda x: x["until"] <= seen)),
    )
    offset = F.when(F.size("_hits") > 0, F.try_element_at("_hits", F.lit(1))["offset"]).otherwise(F.try_element_at("_before", F.lit(-1))["offset"])
    met = step(met, seconds=F.when(F.col("_offset").isNotNull(), t - F.col("_offset") * 60).otherwise(t - offset))
    met = step(
        met,
        status=F.when(t.isNotNull() & F.col("_seconds").isNull(), "no_zone")
        .when(t.isNotNull() & F.col("_offset").isNull() & (F.size("_hits") > 1), "ambiguous")
        .when(t.isNotNull() & F.col("_offset").isNull() & (F.size("_hits") == 0), "nonexistent")
        .when(t.isNotNull(), "instant")
        .when(F.col("_day").isNotNull(), "day")
        .when(F.col("_month").isNotNull(), "month")
        .otherwise("unreadable"),
        text=F.when(t.isNotNull(), F.date_format(F.to_utc_timestamp(F.timestamp_seconds("_seconds"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("_day").isNotNull(), F.col("_day").cast("string"))
        .otherwise(F.col("_month")),
    )
    kept = [c for c in rows.columns if c not in (value, "status")]
    return fenced(met.select(*kept, F.col("_text").alias(value), F.col("_status").alias("status")))
