import itertools
import random
from datetime import datetime

from pyspark.sql import functions as F

from wrenfield.operators import keyed, state
from wrenfield.operators.identity import collapsed_roles, entity_pairs, keyed_entities, role_audience, role_signature
from wrenfield.operators.rules import Term, hits, relevance


def test_upsert_rules(spark):
    old = spark.createDataFrame([("a", "x", "d", "closed", "mine"), ("b", "y", None, "open", None)], "id string, title string, description string, status string, note string")
    new = spark.createDataFrame([("a", None, "", None), ("c", "z", "n", None)], "id string, title string, description string, note string")
    out = state.upserted(old, new, "id", overwrite=["title"], fill=[], fill_empty=["description"], keep=["note"], constants={"status": F.lit("open")})
    assert {tuple(r) for r in out.collect()} == {("a", None, "d", "mine", "open", "updated"), ("b", "y", None, None, "open", "kept"), ("c", "z", "n", None, "open", "inserted")}


def test_sweep_is_two_steps_unless_compat(spark):
    s = spark.createDataFrame([("a", "s", "open", None), ("b", "s", "stale", None), ("c", "t", "open", None), ("d", "s", "open", None)], "id string, source string, status string, closed_at timestamp")
    seen, src = spark.createDataFrame([("d",)], "id string"), spark.createDataFrame([("s",)], "source string")
    at = F.lit(datetime(2026, 1, 1))
    run = lambda compat: {r.id: r.status for r in state.swept(s, seen, src, "id", "source", at, compat=compat).collect()}
    assert run(False) == {"a": "stale", "b": "closed", "c": "open", "d": "open"}
    assert run(True) == {"a": "closed", "b": "closed", "c": "open", "d": "open"}


def test_sweep_leaves_sources_that_did_not_run(spark):
    boards = spark.createDataFrame([("s",), ("moved",), ("failed",), ("mail",)], "source string")
    delivered = spark.createDataFrame([("d", "s"), ("e", "failed"), ("f", "other")], "id string, source string")
    failed = spark.createDataFrame([("failed",)], "source string")
    names = lambda df: {r.source for r in df.collect()}
    assert names(state.ran_sources(boards, delivered, "source")) == {"s", "failed"}
    assert names(state.ran_sources(boards, delivered, "source", failed=failed, may_be_empty=["mail"])) == {"s", "mail"}


def test_lifecycle_sweep_without_rows_of_a_source(spark, tmp_path):
    from wrenfield.plans.stateful import QUERIES

    at = datetime(2026, 1, 1)
    rows = [(5, at, "a", "s", "open"), (5, at, "b", "s", "stale"), (6, at, "d", "s", "open"), (5, at, "c", "moved", "open"), (5, at, "e", "moved", "stale"), (5, at, "f", "loose", "open"), (6, at, "g", "loose", "open")]
    spark.createDataFrame([(*r, None) for r in rows], "run_id bigint, delivered_at timestamp, job_id string, source string, status string, closed_at timestamp").write.parquet(f"{tmp_path}/job_snapshots.parquet")
    spark.createDataFrame([("s", True), ("moved", True), ("loose", False)], "source string, enumerated boolean").write.parquet(f"{tmp_path}/boards.parquet")
    out = {r.job_id: r.status for r in QUERIES["lifecycle_sweep"](spark, str(tmp_path)).collect()}
    assert out == {"a": "stale", "b": "closed", "c": "open", "e": "stale", "f": "open"}


def test_fold_against_plain_version(spark):
    rng, rows = random.Random(3), []
    for key in range(30):
        rows += [(key, i, rng.choice(["applied", "unapplied", "skipped", "unskipped"])) for i in range(rng.randrange(1, 8))]
    out = state.folded(spark.createDataFrame(rows, "k int, i int, e string"), "k", ["i"], "e", on="applied", off="unapplied", skip="skipped", unskip="unskipped").collect()
    for r in out:
        applied = skipped = False
        for _, _, e in sorted(x for x in rows if x[0] == r.k):
            if e == "applied":
                applied, skipped = True, False
            elif e == "unapplied":
                applied = False
            elif e == "skipped":
                skipped = skipped or not applied
            else:
                skipped = False
        assert (r.applied, r.skipped) == (applied, skipped)


def test_merge_snapshots(spark):
    schema = "id string, at int, v string, w string"
    a = spark.createDataFrame([("x", 2, "", "a"), ("y", 1, "old", None)], schema)
    b = spark.createDataFrame([("x", 1, "b", "b"), ("y", 5, "new", "w"), ("z", None, None, "z")], schema)
    out = {r.id: (r.v, r.w) for r in state.merged_snapshots(a, b, "id", "at", ["v", "w"]).collect()}
    assert out == {"x": ("b", "a"), "y": ("new", "w"), "z": (None, "z")}


def test_merged_group(spark):
    rows = [("k", 1, None, "", ["a"]), ("k", 2, "s2", "d2", ["b", "a"]), ("k", 3, "s3", "d3", None), ("l", 1, None, None, None)]
    df = spark.createDataFrame(rows, "k string, o int, s string, d string, u array<string>")
    out = {r.k: (r.copies, r.o, r.s, r.d, r.u) for r in keyed.merged_group(df, "k", [F.col("o")], fill=["s"], fill_empty=["d"], unite=["u"], keep=["o"]).collect()}
    assert out == {"k": (3, 1, "s2", "d2", ["a", "b"]), "l": (1, 1, None, None, [])}


def test_nearest_rank_and_empty(spark):
    for n in (1, 2, 9, 10, 11):
        df = spark.createDataFrame([("g", (i * 7) % n) for i in range(n)], "g string, v int")
        assert keyed.nearest_rank(df, ["g"], "v", 0.9, "p").first().p == sorted((i * 7) % n for i in range(n))[min(n - 1, int(0.9 * n))]
    assert keyed.nearest_rank(spark.createDataFrame([], "g string, v int"), ["g"], "v", 0.9, "p").count() == 0


def test_nearest_within_against_all_pairs(spark):
    rng = random.Random(5)
    left = [(d, i, rng.randrange(2000)) for d in range(4) for i in range(8)]
    right = [(d, i, rng.randrange(2000)) for d in range(4) for i in range(8)]
    out = {(r.d, r.a): r.gap for r in keyed.nearest_within(spark.createDataFrame(left, "d int, a int, at int"), spark.createDataFrame(right, "d int, b int, bt int"), "d", 100).collect()}
    want = {(d, a): min(abs(at - bt) for e, _, bt in right if e == d) for d, a, at in left}
    assert out == {k: v for k, v in want.items() if v < 100}


def test_ladder_and_collisions(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "key string")
    first = spark.createDataFrame([("a", 1)], "key string, t int")
    second = spark.createDataFrame([("a", 2), ("b", 3), ("c", 4), ("c", 5)], "key string, t int")
    assert {tuple(r) for r in keyed.laddered(rows, "key", [first, second]).collect()} == {("a", 1, 1), ("b", 3, 2)}
    claims = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "i"), ("c", "i"), ("d", None)], "k string, host string")
    assert {r.k for r in keyed.without_collisions(claims, "k", "host").collect()} == {"c", "d"}


def test_entity_pairs_against_all_pairs(spark):
    rng, rows = random.Random(7), []
    for i in range(40):
        rows.append((f"k{i:02}", rng.choice(["Alba School", "The Alba School", "Bora School", "Porto", "Cala College"]), rng.choice([None, "Spain", "Kenya"]), rng.choice([None, "Porto", "Lund"]), rng.choice([None, "https://www.a.example/x", "b.example"]), rng.choice(["job", "directory"])))
    schema = "key string, name string, country string, city string, website string, origin string"
    entities = keyed_entities(spark.createDataFrame(rows, schema))
    got = {frozenset((r.survivor, r.folded)) for r in entity_pairs(entities).collect()}
    kept = entities.collect()
    peers = {}
    for e in kept:
        peers.setdefault(e.host, set()).add(e.core)

    def same(a, b):
        if a.t and b.t and a.t != b.t:
            return False
        host = a.host is not None and a.host == b.host
        if a.core == b.core:
            return host if a.place_only or b.place_only else not a.c or not b.c or a.c == b.c or host
        return host and len(peers[a.host]) <= 2

    assert got == {frozenset((a.key, b.key)) for a, b in itertools.combinations(kept, 2) if same(a, b)}


def test_role_collapse_is_greedy(spark):
    rows = [("1", "s", "PE Teacher", "x" * 300), ("2", "s", "Primary PE Teacher", "x" * 200), ("3", "s", "Secondary PE Teacher", "x" * 100), ("4", None, "PE Teacher", None), ("5", "s", "Head of PE", None), ("6", "s", "PE Teacher", None)]
    df = spark.createDataFrame(rows, "id string, school_key string, title string, description string").selectExpr("*", "cast(null as string) deadline_at", "cast(null as string) application_url", "cast(null as string) my_status", "cast(null as timestamp) first_seen_at")
    assert {r.id: r.seed for r in collapsed_roles(df).collect()} == {"1": "1", "2": "1", "3": "1", "4": "4", "5": "5", "6": "1"}
    sig = spark.createDataFrame([("Primary & Secondary Swimming Coach (maternity cover)",)], "t string").select(role_signature(F.col("t")).alias("s")).first().s
    assert tuple(sig) == ("coach", "swimming", True, "any")


def test_role_signature_reads_all_that_sets_openings_apart(spark):
    want = {
        "Trampolining Coach": ("coach", "gymnastics", False, "any", "open"), "Head of Water Polo": ("head", "swimming", False, "any", "open"), "Soccer Coach (Boys)": ("coach", "football", False, "any", "male"),
        "Girls PE Teacher": ("teacher", "pe", False, "any", "female"), "PE Teacher (M)": ("teacher", "pe", False, "any", "male"), "Karate Instructor, parental leave": ("teacher", "martial", True, "any", "open"),
        "PE Teacher - Head of Primary": ("teacher", "pe", False, "primary", "open"), "PE Teacher and Head of PE": ("head", "pe", False, "any", "open"), "Teacher, Director of Sport": ("director", "pe", False, "any", "open"),
        "Assistant Team Leader": ("support", "pe", False, "any", "open"), "Lead PE Teacher": ("lead", "pe", False, "any", "open"), "PE TA, Lower School": ("support", "pe", False, "primary", "open"),
        "Professor(a) de Educação Física - Educação Infantil": ("teacher", "pe", False, "early", "open"), "Professor de Educação Física, Ensino Médio": ("teacher", "pe", False, "secondary", "open"),
        "PE Teacher, Grade 7": ("teacher", "pe", False, "secondary", "open"), "PE Teacher, Fund I": ("teacher", "pe", False, "primary", "open"), "Track and Field Coach": ("coach", "athletics", False, "any", "open"),
    }
    out = spark.createDataFrame([(t,) for t in want], "t string").select("t", role_signature(F.col("t")).alias("s"), role_audience(F.col("t")).alias("a"))
    assert {r.t: (*r.s, r.a) for r in out.collect()} == want


def test_role_collapse_keeps_audiences_and_sports_apart(spark):
    titles = ["PE Coach", "Trampolining Coach", "Girls PE Coach", "Boys PE Coach", "Gymnastics Coach", "Female PE Coach"]
    df = spark.createDataFrame([(str(i), "s", t, "x" * (900 - 100 * i)) for i, t in enumerate(titles)], "id string, school_key string, title string, description string")
    df = df.selectExpr("*", "cast(null as string) deadline_at", "cast(null as string) application_url", "cast(null as string) my_status", "cast(null as timestamp) first_seen_at")
    assert {r.id: r.seed for r in collapsed_roles(df).collect()} == {"0": "0", "1": "1", "2": "2", "3": "3", "4": "1", "5": "2"}


def test_relevance(spark):
    core, veto = [Term("pe", "(?i)physical education", 55)], [Term("maths", "(?i)maths", 60)]
    df = spark.createDataFrame([(1, "Teacher of Physical Education", ""), (2, "Maths Teacher", "physical education helps"), (3, "Teacher", "maths"), (4, "", "")], "i int, t string, b string")
    out = df.select("i", hits(core, F.col("t"), F.col("b")).alias("c"), hits([Term("sport", "(?i)sport", 20)], F.col("t"), F.col("b")).alias("s"), hits(veto, F.col("t"), F.col("b")).alias("v"))
    assert {r.i: r.x for r in out.select("i", relevance(F.col("c"), F.col("s"), F.col("v")).alias("x")).collect()} == {1: 55, 2: 0, 3: 0, 4: 0}


def test_classifier_reads_the_whole_body(spark, tmp_path):
    from wrenfield.plans.stateful import QUERIES

    late = "x" * 7000 + " physical education"
    rows = [("a", "Teacher", late), ("b", "Teacher of Physical Education", "x" * 7000 + " swimming"), ("c", "Teacher", None)]
    df = spark.createDataFrame(rows, "id string, title string, description string")
    df.selectExpr("*", "timestamp '2026-01-01' last_checked_at").write.parquet(f"{tmp_path}/jobs.parquet")
    score = lambda **x: {r.id: r.score for r in QUERIES["classifier_score"](spark, str(tmp_path), **x).collect()}
    assert score() == {"a": 14, "b": 61, "c": 0}
    assert score(body_limit=6000) == {"a": 0, "b": 55, "c": 0}


def test_same_openings(spark):
    from wrenfield.operators.identity import role_of, same_role

    same = [
        ("Secondary PE Teacher", "Secondary Physical Education (PE) Teacher"), ("PE Teacher", "PE Teacher - January 2027"), ("Teacher - Physical Education (Female)", "Physical Education Teacher - Female"),
        ("Netball Coach (Part-Time) | Enrich ME", "Netball Coach | Enrich ME Sports"), ("Physical Education Primary Teacher", "Job Title Physical Education Primary Teacher"),
        ("PE Teacher [Female Primary Specialist] - Yasmina British Academy - Jan 27", "Teacher - Physical Education [Female]"), ("Primary Physical Education Teacher", "Physical Education Teacher"),
    ]
    other = [
        ("Lead PE Teacher - January 2027", "Physical Education Teacher - January 2027"), ("Head of PE - Sec(BTEC)", "PE Teacher - Maternity Cover"), ("Golf Coach (Service Agreement)", "Lead Football Coach"), ("Lead Football Coach", "Lead Gymnastics Coach"),
        ("Head of Sport and Physical Education", "Physical Education and Sports Teacher"), ("PE Technician - January 2027 Start", "Teacher of PE - August 2027 Start"), ("Physical Education Teacher | Maternity Cover", "Female Physical Education Teacher"),
        ("Physical Education Teacher - Female", "Physical Education Teacher"), ("Physical Education Teacher (Secondary Girls)", "Physical Education Teacher (Secondary Boys)"), ("Physical Education Teacher - Middle and High School", "Physical Education Teacher - Primary School"),
        ("Primary PE Teacher", "Secondary PE Teacher"), ("Early Years PE Teacher", "Primary PE Teacher"), ("Professor(a) de Educação Fisica - Educação Infantil", "Professor(a) Educação Física - Fund I"),
    ]
    df = spark.createDataFrame([(a, b, True) for a, b in same] + [(a, b, False) for a, b in other], "a string, b string, want boolean")
    wrong = df.withColumn("got", same_role(role_of(F.col("a")), role_of(F.col("b")))).where("got <> want").collect()
    assert not wrong
    kinds = {"Head of Physical Education": "head", "Director of Sport": "director", "PE Teacher - Head of Primary": "teacher", "Lead PE Teacher": "lead", "Head of P.E.": "head", "Teaching Assistant (TA)": "support", "Second in PE": "lead", "PE Co-ordinator": "coordinator"}
    got = spark.createDataFrame([(t,) for t in kinds], "t string").select("t", role_of(F.col("t"))["kind"].alias("k")).collect()
    assert {r.t: r.k for r in got} == kinds


def test_spooled_tables_are_dropped(spark):
    from wrenfield.session import drop_spools, spooled

    drop_spools(spark)
    table = spooled(spark.range(3))
    path = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    import os

    assert table.count() == 3 and os.path.isdir(path) and drop_spools(spark) == 1 and not os.path.exists(path) and drop_spools(spark) == 0
