import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wrenfield.llm.garbled import LOST, SWITCH, UNTOLD, best_stretches, lattice, reread, restored
from wrenfield.llm.survivor import consensus, representatives, surviving_addresses

CLEAN = ["Größere Gruppen üben für die Prüfung im März.", "L’école préfère la natation à Évrine.", "Школа ищет учителя плавания.", "学校现招聘游泳教师，每周十课时。", "Szkoła poszukuje nauczyciela języka, także w październiku.", "At least 25 °C – prices from £39,500 • “school”."]


def test_consensus_takes_the_closest_existing_value():
    assert consensus(["info@a.example", "info@a.example.org", "office@a.example"], [1, 1, 1]) == "info@a.example"
    assert consensus(["a.example", "b.example"], [1, 3]) == "b.example"
    assert consensus(["x"], [1]) == "x"
    assert consensus(["", "a"], [1, 1]) in ("", "a")


def test_representatives(spark):
    at = lambda d: datetime(2025, 1, d)
    rows = [("k", "f", "old", 0.8, at(1)), ("k", "f", "new", 0.75, at(2)), ("k", "f", "newest", 0.3, at(9)), ("l", "f", "a", None, None), ("l", "f", "a", None, None), ("m", "f", None, 0.9, at(1)), (None, "f", "x", 1.0, at(1)), ("n", "f", "x" * 20_000, 0.5, at(1))]
    rows += [("hot", "f", f"v{i:04}", 0.5, at(1 + i % 28)) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, field string, value string, confidence double, at timestamp").selectExpr("*", "1 as chunk", "2 as top")
    got = {r.key: r.value for r in representatives(df).collect()}
    # Of 3,000 values each is one token, so none has votes but its own and its chunk's: one of the latest day is left.
    assert got.pop("hot") in {f"v{i:04}" for i in range(3000) if 1 + i % 28 == 28}
    assert got == {"k": "new", "l": "a", "n": "x" * 20_000}
    assert representatives(df.where("false")).count() == 0


def test_tokens_outvote_the_latest_value(spark):
    at = lambda d: datetime(2025, 1, d)
    rows = [("k", "school_email", "office@alba.example", 0.8, at(1)), ("k", "school_email", "office@alba.example.org", 0.85, at(3)), ("k", "school_email", "offfice@alba.example", 0.8, at(5))]
    # Two values alike in confidence: the later; one clearly surer: that, however old; repeated records don't add up.
    rows += [("two", "website", "a.example", 0.8, at(1)), ("two", "website", "a.example", 0.9, at(1)), ("two", "website", "b.example", 0.8, at(4))]
    rows += [("sure", "website", "a.example", 0.9, datetime(2015, 1, 1)), ("sure", "website", "b.example", 0.6, at(4)), ("sure", "website", "c.other.example", 0.5, at(5))]
    rows += [("tie", "website", "a.example", 0.5, None), ("tie", "website", "b.example", 0.5, None)]
    df = spark.createDataFrame(rows, "key string, field string, value string, confidence double, at timestamp")
    latest = {r.key: r.value for r in df.groupBy("key").agg(F.max_by("value", "at").alias("value")).collect()}
    got = {r.key: r.value for r in representatives(df).collect()}
    assert got == {"k": "office@alba.example", "two": "b.example", "sure": "a.example", "tie": "b.example"} and latest["k"] != got["k"]


def test_groups_of_many_values(spark):
    rows = [("k", "f", f"info{i}@alba.example", 0.5, datetime(2025, 1, 1)) for i in range(3000)] + [("k", "f", "info@alba.example", 0.5, datetime(2025, 1, 1))]
    got = representatives(spark.createDataFrame(rows, "key string, field string, value string, confidence double, at timestamp")).collect()
    assert len(got) == 1 and got[0].value.endswith("@alba.example")


def test_addresses(spark):
    p = '{"website": {"confidence": 0.9, "source": "x"}, "schoolEmail": {"confidence": 0.8}}'
    at = datetime(2025, 1, 1)
    rows = [("dora-alba-school|es", 1, "HTTPS://www.alba.example/x", " INFO@Alba.example ", None, p, at), ("dora-alba-school|es", 2, "https://jobs.hire.example", "alba@jobs.hire.example", "[email]", "{broken", at), ("bora-college|es", 3, "jobs.hire.example", None, "name@yourdomain.example", None, None), ("bora-college|es", 3, None, None, None, None, None), (None, 4, "x.example", None, None, None, None)]
    df = spark.createDataFrame(rows, "school_key string, rec_id bigint, website string, school_email string, career_email string, provenance_json string, enriched_at timestamp")
    assert {tuple(r) for r in surviving_addresses(df).collect()} == {("dora-alba-school|es", "website", "alba.example"), ("dora-alba-school|es", "school_email", "info@alba.example")}
    assert surviving_addresses(df.where("false")).count() == 0


def garble(text, written, read):
    # Bytes that the reading encoding lacks stand as control characters.
    return "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in text.encode(written))


CASES = [(0, "utf-8", "cp1252"), (0, "utf-8", "latin-1"), (1, "utf-8", "mac_roman"), (2, "utf-8", "cp1252"), (3, "utf-8", "cp1252"), (4, "utf-8", "cp1250"), (5, "utf-8", "cp850"), (2, "cp1251", "cp1252"), (3, "gbk", "cp1252"), (4, "cp1250", "cp1252")]


def test_restores_what_was_garbled_and_leaves_the_rest(spark):
    corpus = [(i, t, "x") for i, t in enumerate(CLEAN * 30)]
    decoys = ["“school” ÀÉ 17½ (£)", "MISSÃO É A ATENÇÃO", "Peñalta, ¿te animas?", "", None, "x" * 50_000]
    rows = corpus + [(1000 + i, t, "x") for i, t in enumerate(decoys)]
    rows += [(2000 + i, garble(CLEAN[k], w, r), "x") for i, (k, w, r) in enumerate(CASES)]
    twice = garble(garble(CLEAN[0], "utf-8", "cp1252"), "utf-8", "cp1252")
    rows += [(3000, twice, "x"), (3001, CLEAN[0] + " Gr��ere", "x"), (3002, CLEAN[1] + "\n" + garble(CLEAN[5], "utf-8", "cp1252"), "x")]
    two = [CLEAN[4], "plain words between", CLEAN[0]]
    rows += [(3003, "\n".join([garble(two[0], "utf-8", "mac_roman"), two[1], garble(two[2], "utf-8", "cp1252")]), "x")]
    rows += [(3004, CLEAN[4].encode().decode("latin-1").translate({c: LOST for c in range(0x80, 0xA0)}), "x"), (3005, CLEAN[2].encode("cp1251").decode("cp1252") + " èùåì", "x")]
    got = {r.doc_id: r for r in restored(spark.createDataFrame(rows, "doc_id bigint, text string, channel string")).collect()}
    want = {2000 + i: CLEAN[k] for i, (k, _, _) in enumerate(CASES)} | {3000: CLEAN[0], 3002: CLEAN[1] + "\n" + CLEAN[5], 3003: "\n".join(two)}
    want |= {3001: CLEAN[0] + " Größere", 3004: CLEAN[4], 3005: CLEAN[2] + " ищем"}  # the last word is in no other text
    assert set(got) == set(want) and {k for k in got if got[k].lost} == {3001, 3004}
    assert {k: got[k].text for k in want} == want and hashlib.md5(got[3000].text.encode()).hexdigest()


def test_empty_corpus(spark):
    assert restored(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize(
    "places",
    [
        [],
        [{"a": (5.0, True)}],
        [{"a": (-1.0, True)}, {"a": (9.0, True), "b": (9.5, False)}, {}, {"b": (-2.0, False)}, {"a": (9.0, True)}],
        [{"a": (2.0, True)}, {"a": (2.0, False)}],
        [{"b": (20.0, False)}, {"a": (4.0, True), "b": (3.0, True)}, {"b": (6.0, False)}],
        [{"b": (11.0, False)}],
        [{"b": (16.0, False)}, {"a": (9.0, True)}],
    ],
)
def test_viterbi_against_all_paths(places):
    import itertools

    def score(states):  # of each chunk a channel or None; chunks that a channel doesn't read may lie within its stretch
        total = 0.0
        stretches = [(c, [i for i, _ in own]) for c, own in itertools.groupby(enumerate(states), key=lambda x: x[1])]
        for c, own in stretches:
            if c is not None:
                total -= SWITCH + (0.0 if any(places[i].get(c, (0, False))[1] for i in own) else UNTOLD)
                total += sum(places[i].get(c, (0.0, False))[0] for i in own)
        return total

    channels = [None, *sorted({c for p in places for c in p})]
    best = max((score(p) for p in itertools.product(channels, repeat=len(places))), default=0.0)
    total, path = best_stretches(places)
    assert total == pytest.approx(best) and len(path) == len(places) and all(c is None or c in p for c, p in zip(path, places))


def test_lost_bytes_are_wildcards():
    assert lattice("á»\ufffd", "cp1252") == (LOST, ["á»\ufffd"]) and lattice("Ã©Ã\ufffd–", "cp1252") == ("é" + LOST + "–", ["Ã\ufffd"])
    assert reread("gá»\ufffdi", "cp1252", "utf-8", 1) == ("g" + LOST + "i", 2, ["á»\ufffd"])
    assert reread("café", "cp1252", "utf-8", 1) is None and reread("für", "cp1252", "cp1251", 1) is None
    long = "é" * 3000
    assert reread(garble(long, "utf-8", "cp1252"), "cp1252", "utf-8", 1)[0] == long
