import pytest

from wrenfield.operators.times import normalised_times, zone_intervals

ROW = "id int, clock_zone string, place_zone string, month_first boolean, value string"
CASES = [
    ("2025-11-22T01:19:29Z", "2025-11-22T01:19:29Z", "instant"),
    ("2024-09-08T11:40:43+01:00", "2024-09-08T10:40:43Z", "instant"),
    ("2025-10-13 at 1:05 PM GMT-5", "2025-10-13T18:05:00Z", "instant"),
    ("Sat, 06 Dec 2025 18:04:00 +0000", "2025-12-06T18:04:00Z", "instant"),
    (" 1764568086714 ", "2025-12-01T05:48:06Z", "instant"),
    ("/Date(1741120565000)/", "2025-03-04T20:36:05Z", "instant"),
    ("20251105T113500Z", "2025-11-05T11:35:00Z", "instant"),
    ("2025-07-01 12:00", "2025-07-01T11:00:00Z", "instant"),
    ("2025-07-01 12.30 local time", "2025-07-01T08:30:00Z", "instant"),
    ("2025-10-26 01:30", "2025-10-26T00:30:00Z", "ambiguous"),
    ("2025-03-30 01:30", "2025-03-30T01:30:00Z", "nonexistent"),
    ("12/06/2025", "2025-06-12", "day"),
    ("12/20/2025", "2025-12-20", "day"),
    ("20th August 2025", "2025-08-20", "day"),
    ("1. Januar 2026", "2026-01-01", "day"),
    ("Saturday, November 30 2024", "2024-11-30", "day"),
    ("September, 2026", "2026-09", "month"),
    ("09/2026", "2026-09", "month"),
    ("31/02/2026", None, "unreadable"),
    ("2025-02-30T09:00:00Z", None, "unreadable"),
    ("Term 3", None, "unreadable"),
    ("", None, "unreadable"),
    ("x" * 100_000, None, "unreadable"),
]


def run(spark, rows):
    df = spark.createDataFrame(rows, ROW)
    zones = spark.createDataFrame([("Europe/London",), ("Asia/Dubai",), ("America/New_York",), ("no/zone",), (None,)], "z string")
    out = normalised_times(df, "value", clock_zone="clock_zone", place_zone="place_zone", month_first="month_first", intervals=zone_intervals(zones, 2020, 2030))
    return {r.id: (r.value, r.status) for r in out.collect()}


def test_written_times(spark):
    got = run(spark, [(i, "Europe/London", "Asia/Dubai", False, raw) for i, (raw, _, _) in enumerate(CASES)])
    assert [got[i] for i in range(len(CASES))] == [(value, status) for _, value, status in CASES]


def test_month_first_nulls_and_unknown_zones(spark):
    got = run(
        spark,
        [(1, "America/New_York", None, True, "07/03/25"), (2, None, None, None, "2025-07-01 12:00"), (3, "no/zone", None, None, "2025-07-01 12:00"), (4, "Europe/London", None, None, None), (5, "Europe/London", None, None, "2025-07-01 12:00 local")],
    )
    assert got == {1: ("2025-07-03", "day"), 2: (None, "no_zone"), 3: (None, "no_zone"), 4: (None, "unreadable"), 5: (None, "no_zone")}


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], ROW + ", status string, zone string, year int")
    zones = spark.createDataFrame([("Europe/London",)], "z string")
    out = normalised_times(df, "value", clock_zone="clock_zone", place_zone="place_zone", month_first="month_first", intervals=zone_intervals(zones, 2025, 2025))
    assert out.count() == 0 and "status" in out.columns and "zone" in out.columns


@pytest.mark.parametrize("zone", ["Europe/London", "Asia/Kolkata", "America/New_York"])
def test_intervals_agree_with_zoneinfo(spark, zone):
    import random
    from datetime import datetime, timezone
    from zoneinfo import ZoneInfo

    rng = random.Random(1)
    stamps = [rng.randrange(1_600_000_000, 1_900_000_000) for _ in range(40)]
    rows = [(i, zone, None, False, datetime.fromtimestamp(s, ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M:%S")) for i, s in enumerate(stamps)]
    zones = spark.createDataFrame([(zone,)], "z string")
    out = normalised_times(spark.createDataFrame(rows, ROW), "value", clock_zone="clock_zone", place_zone="place_zone", month_first="month_first", intervals=zone_intervals(zones, 2019, 2031)).collect()
    for r in out:
        if r.status == "instant":
            assert r.value == datetime.fromtimestamp(stamps[r.id], timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


@pytest.mark.parametrize("zone", ["Europe/London", "America/New_York", "Australia/Sydney", "Asia/Kolkata"])
def test_far_years(spark, zone):
    import random
    from datetime import datetime, timezone
    from zoneinfo import ZoneInfo

    rng = random.Random(2)
    moments = [datetime(y, rng.randrange(1, 13), rng.randrange(1, 29), rng.randrange(24), rng.randrange(60), tzinfo=timezone.utc) for y in [*rng.sample(range(1000, 1830), 8), *rng.sample(range(1830, 1970), 10), *rng.sample(range(2101, 9998), 30)]]
    rows = [(i, zone, None, False, m.astimezone(ZoneInfo(zone)).replace(tzinfo=None, fold=0).strftime("%Y-%m-%d %H:%M:%S").zfill(19)) for i, m in enumerate(moments)]
    zones = spark.createDataFrame([(zone,)], "z string")
    out = normalised_times(spark.createDataFrame(rows, ROW), "value", clock_zone="clock_zone", place_zone="place_zone", month_first="month_first", intervals=zone_intervals(zones)).collect()
    assert all(r.status in ("instant", "ambiguous") for r in out)
    for r in out:
        if r.status == "instant":
            want = moments[r.id].replace(tzinfo=None)
            # Proleptic days before 1582 are those of datetime; zones before 1830 have their mean time to the second.
            assert r.value == want.strftime("%Y-%m-%dT%H:%M:%SZ").zfill(20), (zone, rows[r.id])
