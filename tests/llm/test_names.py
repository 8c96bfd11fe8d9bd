import random
import string

import pytest
from pyspark.sql import functions as F

from wrenfield.llm import names
from wrenfield.llm.matching import bit_vector, calibration, candidates, hamming_pairs, matched, qgrams
from wrenfield.llm.names import edits, known_place, name_clusters, name_reader, near_pairs

PLACES = ["Al Safwa", "Tanjong Melur", "Valmorel-sur-Orne"]


@pytest.mark.parametrize(
    ("name", "kinds", "proper"),
    [
        ("The Bryfurin Primary School", ["primary"], "bryfurin"), ("Primary Sch., Bryfurin", ["primary"], "bryfurin"), ("BRYFURIN PS (Al Safwa campus)", ["primary", "preparatory"], "bryfurin"),
        ("Acad. of Zinurwoth", ["academy"], "zinurwoth"), ("Int'l Acdmy of Wakíssund Ltd", ["academy international"], "wakissund"), ("Hil unraane British Int. Skool", ["british international"], "hilunraane"),
        ("Dora Lesorban Bi-lingual School, Tanjong Melur", ["bilingual"], "lesorban"), ("Lesorban Bilingual School, Theodora", ["bilingual"], "lesorban"), ("Parni-bis College Valmorel-sur-Orne", ["college"], "parnibis"),
        ("Croda-ssoth Grammar Sc…", ["grammar"], "crodassoth"), ("", [""], ""), ("…", [""], ""), ("The School", ["school"], ""),
    ],
)
def test_readings(name, kinds, proper):
    got = name_reader(PLACES)(name)
    assert (got[0], got[1]) == (kinds, proper)


def test_edits_against_full_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 7))) for _ in "ab")
        rows = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    rows[i][j] = min(rows[i][j], rows[i - 2][j - 2] + 1)
        assert edits(a, b, 2) == min(rows[-1][-1], 3)


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_segment_join_loses_nothing(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randrange(3, 10))) for _ in range(250)}
    df = spark.createDataFrame([("k", w, i) for i, w in enumerate(words)] + [("other", "abcabc", 0), ("k", "", 0)], "kind string, proper string, size int")
    got = {(r.other, r.proper): r.edits for r in near_pairs(df, 2).where("kind = 'k'").collect()}
    want = {}
    for a in words:
        for b in words:
            d = _levenshtein(a, b)
            short, long = sorted((a, b), key=lambda w: (len(w), w))
            if a != b and d <= (2 if len(short) > 5 else 1):
                want[short, long] = d
    assert {frozenset(k): v for k, v in got.items()} == {frozenset(k): v for k, v in want.items()}


def test_clusters(spark):
    rows = [("Bryfurin Primary School", "CN", "yunhe"), ("Bryfurtn PS", "CN", None), ("Primary School of Bryf…", "CN", "yunhe"), ("Bryfurin International Academy", "CN", "yunhe"), ("Bryfurun Primary School", "KE", None), (None, "CN", None), ("", None, None), ("!", None, None)]
    out = {r.name: r.cluster for r in name_clusters(spark.createDataFrame(rows, "name string, country string, place string"), PLACES).collect()}
    assert out["Bryfurin Primary School"] == out["Bryfurtn PS"] == out["Primary School of Bryf…"]
    assert len({out["Bryfurin Primary School"], out["Bryfurin International Academy"], out["Bryfurun Primary School"], out[""], out["!"]}) == 5
    assert name_clusters(spark.createDataFrame([], "name string, country string, place string"), PLACES).count() == 0


def test_shuffles_follow_the_number_of_names(spark, monkeypatch):
    """The session has partitions for its largest input; what the driver keeps of shuffles of names is to follow the names."""
    key, used = "spark.sql.shuffle.partitions", []
    before, written = spark.conf.get(key), names.spooled
    monkeypatch.setattr(names, "spooled", lambda df: used.append(int(spark.conf.get(key))) or written(df))
    rows = [(f"Bryfur{a}{b} Primary School", "CN", None) for a in "aeiou" for b in "lmnst"]
    try:
        spark.conf.set(key, "61")
        out = name_clusters(spark.createDataFrame(rows, "name string, country string, place string"), PLACES)
        assert spark.conf.get(key) == "61"
    finally:
        spark.conf.set(key, before)
    assert out.count() == len(rows) and used[0] == 61 and set(used[1:]) == {2 * spark.sparkContext.defaultParallelism}


def test_places(spark):
    df = spark.createDataFrame([("VALMOREL SUR ORNE",), ("al  safwa",), ("Elsewhere",), (None,)], "c string")
    assert [r.p for r in df.select(known_place(F.col("c"), PLACES).alias("p")).collect()] == ["valmorel sur orne", "al safwa", None, None]


def test_hamming_pairs_are_exact(spark):
    rng = random.Random(6)
    names = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(4, 9))) for _ in range(120)]
    left, right = names[:60], names[60:] + [n[:-1] for n in names[:30]] + [n[1:] for n in names[:10]]
    a = spark.createDataFrame([("k", n) for n in left], "kind string, proper string")
    b = spark.createDataFrame([("k", n) for n in right] + [("l", n) for n in left], "kind string, proper string")
    vectors = {r.proper: r.v for r in a.union(b).distinct().select("proper", bit_vector(qgrams(F.col("proper"))).alias("v")).collect()}
    got = {(r.proper, r.other) for r in hamming_pairs(a, b).collect()}
    assert got == {(x, y) for x in left for y in right if bin((vectors[x] ^ vectors[y]) & (2**64 - 1)).count("1") <= 8} and len(got) > 30


def test_matching(spark):
    adverts = spark.createDataFrame(
        [("1", ["primary"], "bryfurin", "CN", None, []), ("2", [""], "", None, None, ["own.example"]), ("3", [""], "", None, None, ["shared.example"]), ("4", ["college"], "bryfurin", "CN", None, ["own.example"]), ("5", ["primary"], "zzzzzz", None, None, [])],
        "id string, kinds array<string>, proper string, country string, place string, domains array<string>",
    )
    entities = spark.createDataFrame(
        [("A", "primary", "bryfurinn", "CN", None, None), ("A", None, None, None, None, "own.example"), ("A", None, None, None, None, "shared.example"), ("B", "high", "dalo", "KE", None, "shared.example")],
        "key string, kind string, proper string, country string, place string, domain string",
    )
    scored = candidates(adverts, entities).cache()
    confidences = calibration(scored, spark.createDataFrame([("1", "A")], "id string, key string"), bins=10)
    assert confidences == sorted(confidences) and len(confidences) == 10
    assert {(r.id, r.key) for r in matched(scored, confidences, least=0.0).collect()} == {("1", "A"), ("2", "A")}


def test_names_without_a_kind_meet_schools_of_one_kind(spark):
    schools = [("b", "british international", "bleveton"), ("c", "college", "zinurwoth"), ("d", "academy", "zinurwoth"), ("e", "high", "lesorban")]
    entities = spark.createDataFrame([(*s, None, None, None) for s in schools], "key string, kind string, proper string, country string, place string, domain string")
    names = [("1", [""], "bleveton"), ("2", [""], "zinurwoth"), ("3", [""], "lesorbam"), ("4", ["college"], "zinurwoth"), ("5", ["high"], "bleveton"), ("6", [""], "")]
    adverts = spark.createDataFrame([(*n, None, None, []) for n in names], "id string, kinds array<string>, proper string, country string, place string, domains array<string>")
    assert {(r.id, r.key) for r in candidates(adverts, entities).collect()} == {("1", "b"), ("3", "e"), ("4", "c")}


def test_candidates_join_names_once(spark):
    """What the driver plans and runs as one query is to stay small: no join of close names may be in the plan that is left."""
    adverts = spark.createDataFrame([("1", [""], "bryfurin", "CN", None, ["own.example"])], "id string, kinds array<string>, proper string, country string, place string, domains array<string>")
    entities = spark.createDataFrame([("A", "primary", "bryfurinn", "CN", None, "own.example")], "key string, kind string, proper string, country string, place string, domain string")
    scored = candidates(adverts, entities)
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 6
    assert [(r.id, r.key) for r in scored.collect()] == [("1", "A")]
