import json

from wrenfield.operators.units import advert_figures, annual_dollars, fee_figures

CASES = [
    ({"min": 30000, "max": 33500, "currency": "CNY", "period": "MONTHLY"}, (360000, 402000)),
    ({"min": 5, "max": 6, "currency": "EUR", "period": "month", "text": "figures in '000s"}, (60000, 72000)),
    ({"min": 210000, "max": 235000, "currency": "£", "period": "MONTHLY", "unit": "pence"}, (25200, 28200)),
    ({"min": "46 500", "max": "48.000", "currency": "euros", "period": "ANNUALLY"}, (46500, 48000)),
    ({"max": 50000, "currency": "EUR", "period": "p.a."}, (50000, 50000)),
    ({"text": "Pay 2.125 lakh – 2.5 lakh rupees pcm"}, (2550000, 3000000)),
    ({"text": "We offer $14.5K to $15,000/year; relocation grant on arrival"}, (14500, 15000)),
    ({"text": "S$ 1 750 – 2 100 per month plus housing"}, (21000, 25200)),
    ({"text": "23万 yuan yearly (gross)"}, (230000, 230000)),
    ({"min": 40000, "max": 30000, "currency": "USD", "text": "paid p.a."}, (30000, 40000)),
    ({"min": 40000, "period": "ANNUALLY"}, None),
    ({"min": 40000, "currency": "USD"}, None),
    ({"text": "Housing deposit of 1,000 USD a month paid by the school"}, None),
    ({"text": "Band C of the school pay scale"}, None),
    ({}, None),
]


def dims(spark):
    fx = spark.createDataFrame([(c, 1.0) for c in "CNY EUR GBP INR USD SGD JPY OMR".split()], "currency string, usd_per_unit double")
    periods = spark.createDataFrame([("ANNUALLY", 1), ("TERMLY", 3), ("MONTHLY", 12)], "period string, per_year bigint")
    return fx, periods


def test_pay(spark):
    rows = [(str(i), json.dumps(o)) for i, (o, _) in enumerate(CASES)] + [("null", None), ("broken", '{"min": 5, "curr'), ("empty", ""), (None, '{"min": 1}'), ("long", json.dumps({"text": "9 " * 50_000}))]
    jobs = spark.createDataFrame(rows, "id string, salary_json string")
    got = {r.rec: (r.usd_low, r.usd_high) for r in annual_dollars(advert_figures(jobs), *dims(spark)).collect()}
    assert got == {str(i): want for i, (_, want) in enumerate(CASES) if want}


def test_fees_repeats_and_empty_tables(spark):
    schema = "rec_id bigint, fee_low bigint, fee_high bigint, fee_currency string"
    rows = [(1, 42500, 44000, "EUR per term"), (1, 42500, 44000, "EUR per term"), (2, None, 900, "usd (cents) monthly"), (3, 5, 6, "GBP x1000/term"), (4, 5, 6, "local"), (5, 5, 6, None), (6, None, None, "EUR"), (7, 1500000, 2000000, "JPY minor units")]
    got = {(r.rec, r.usd_low, r.usd_high) for r in annual_dollars(fee_figures(spark.createDataFrame(rows, schema)), *dims(spark)).collect()}
    assert {g for g in got if g[0] != "7"} == {("1", 127500, 132000), ("2", 108, 108), ("3", 15000, 18000)}
    assert annual_dollars(fee_figures(spark.createDataFrame([], schema)), *dims(spark)).count() == 0


def test_combinations_that_are_not_unique_are_flagged(spark):
    fx = spark.createDataFrame([("OMR", 1.0), ("JPY", 1.0)], "currency string, usd_per_unit double")
    periods = spark.createDataFrame([("ANNUALLY", 1)], "period string, per_year bigint")
    # The level of OMR is 10,000; minor units of it may be a hundredth or a thousandth.
    rows = [(i, 10_000, 10_000, "OMR per year") for i in range(40)] + [(100, 3_162_277, 3_162_277, "OMR minor units per year"), (101, 1_000_000, 1_000_000, "OMR minor units per year"), (102, 10_000_000, 10_000_000, "OMR minor units per year")]
    # JPY has too few figures for a level of its own.
    rows += [(200, 9_000, 9_000, "JPY per year"), (201, 1_000_000, 1_000_000, "JPY minor units per year")]
    figures = fee_figures(spark.createDataFrame(rows, "rec_id bigint, fee_low bigint, fee_high bigint, fee_currency string"))
    got = {r.rec: (r.usd_high, r.unique) for r in annual_dollars(figures, fx, periods).collect()}
    assert {k: got[k] for k in ("0", "100", "101", "102", "201")} == {"0": (10_000, True), "100": (got["100"][0], False), "101": (10_000, True), "102": (10_000, True), "201": (10_000, True)}
    assert got["100"][0] in (3_162, 31_623)
