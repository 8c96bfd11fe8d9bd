import itertools

from pyspark.sql import functions as F

from wrenfield.operators import extraction
from wrenfield.operators.identity import role_of


def test_figures(spark):
    want = {"about 1,410 on roll, 30 children": 1410, "A school of 900 pupils": 900, "12 students": None, "480 children": 480, "": None, None: None, "x" * 50_000: None}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r.t: r.v for r in df.select("t", extraction.student_count(F.col("t"))["value"].alias("v")).collect()} == want
    teams = {"The department has 44 specialists": 44, "a team of three": 3, "a team of many": None, "7 PE teachers": 7, "a team of 99": None}
    df = spark.createDataFrame([(t,) for t in teams], "t string")
    assert {r.t: r.v for r in df.select("t", extraction.team_size(F.col("t"))["value"].alias("v")).collect()} == teams


def test_best_sentence(spark):
    rows = [("a", "You lead a house. You teach PE! Coach swimming.\nCoach rugby."), ("b", "Nothing here."), ("c", None), ("d", "")]
    out = extraction.best_sentence(spark.createDataFrame(rows, "id string, t string"), "id", "t", [("(?i)coach", 3), ("(?i)teach", 2)])
    assert [tuple(r) for r in out.collect()] == [("a", "Coach swimming.", 3)]
    assert extraction.best_sentence(spark.createDataFrame([], "id string, t string"), "id", "t", [("x", 1)]).count() == 0


def test_pages_of_schools(spark):
    text = "Bryfurin school and its pupils: curriculum, admissions"
    rows = [(text, "Bryfurin Primary School", True), (text, "Zinurwoth Academy", False), (text, "The School", False), ("Bryfurin school school school school", "Bryfurin", False), (None, "Bryfurin", False), (text, None, False)]
    got = spark.createDataFrame(rows, "t string, n string, want boolean").select("want", extraction.page_is_school(F.col("t"), F.col("n")).alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_points(spark):
    row = spark.range(1).select(extraction.points({"a": (F.lit(True), 3), "b": (F.lit(False), 5), "c": (F.lit(None).cast("boolean"), 7)}).alias("p")).first().p
    assert row.score == 3 and row.why == ["a"]


def test_decided_before_against_plain_version(spark):
    titles = ["PE Teacher", "Secondary PE Teacher", "Primary PE Teacher", "Head of PE", "Swim Coach", "Female PE Teacher", None]
    adverts = [(f"j{i}", f"k{i}" if i % 5 else None, s, t) for i, (s, t) in enumerate(itertools.product(["s1", "s2", None], titles))]
    ledger = [("e1", "k3", "s1", "Golf Coach"), ("e2", "x", "s1", "Physical Education Teacher"), ("e3", None, "s2", "Swimming Coach"), ("e4", None, None, "Head of PE"), ("e0", "k3", "s2", "Head of Sport")]
    a = spark.createDataFrame(adverts, "id string, dedupe_key string, school_key string, title string")
    l = spark.createDataFrame(ledger, "entry string, dedupe_key string, school_key string, title string")  # noqa: E741
    got = {r.id: r.entry for r in extraction.decided_before(a, l).collect()}
    roles = {r.title: r.r for r in spark.createDataFrame([(t,) for t in {x[3] for x in adverts + ledger}], "title string").select("title", role_of(F.col("title")).alias("r")).collect()}

    def same(x, y):
        x, y = roles[x], roles[y]
        return None not in (x.kind, x.sport, x.cover, x.audience) and (x.kind, x.sport, x.cover, x.audience) == (y.kind, y.sport, y.cover, y.audience) and (x.phase == y.phase or "any" in (x.phase, y.phase))

    want = {}
    for i, k, s, t in adverts:
        by_key = [e for e, ek, _, _ in ledger if k is not None and ek == k]
        by_role = [e for e, _, es, et in ledger if s is not None and es == s and same(t, et)]
        if by_key or by_role:
            want[i] = min(by_key or by_role)
    assert got == want and len(want) > 5
