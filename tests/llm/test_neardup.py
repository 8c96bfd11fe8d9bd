import random
import re

import numpy as np
import pyarrow as pa

from wrenfield.llm import neardup
from wrenfield.llm.graph import components
from wrenfield.llm.neardup import SKETCH, band_keys, most_alike, near_duplicates, normal_words, shingle_sets, sketches, super_min_hash
from pyspark.sql import functions as F


def sets_of(texts, words):
    owner, h = shingle_sets(pa.array(texts), words)
    return [set(h[owner == i].tolist()) for i in range(len(texts))]


def test_shingles_are_runs_of_words():
    texts = ["a b c d", "a b", "", "x a b c", "a b c a b c", "é ü ñ ł"]
    got = sets_of(texts, 3)
    plain = [{tuple(t.split()[i : i + 3]) for i in range(max(1, len(t.split()) - 2))} if t else set() for t in texts]
    names = {}
    for hashes, shingles in zip(got, plain):
        assert len(hashes) == len(shingles)
    assert len(got[0] & got[3]) == 1 and got[4] >= got[0] & got[4] and got[1].isdisjoint(got[0]), names


def test_signatures_estimate_jaccard_better_than_chance():
    rng, errors = random.Random(2), []
    for share in (0.2, 0.5, 0.8):
        for _ in range(30):
            both, n = [rng.getrandbits(63) for _ in range(int(200 * share))], 200 - int(200 * share)
            a, b = both + [rng.getrandbits(63) for _ in range(n // 2)], both + [rng.getrandbits(63) for _ in range(n - n // 2)]
            owner = np.array([0] * len(a) + [1] * len(b))
            sig = super_min_hash(owner, np.array(a + b, dtype=np.uint64), 2, 128)
            errors.append((sig[0] == sig[1]).mean() - len(both) / 200)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.042


def test_signature_of_small_and_empty_sets():
    sig = super_min_hash(np.array([0, 2]), np.array([5, 5], dtype=np.uint64), 3, 16)
    assert (sig[0] == sig[2]).all() and len(set(sig[0].tolist())) == 16 and (sig[1] == sig[1].max()).all()
    assert band_keys(sig, 4, 4).shape == (3, 4)


def test_pairs_against_brute_force(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(60)) for _ in range(25)]
    rows = []
    for i, t in enumerate(base):
        rows.append((f"d{i}", t))
        for k in range(4):
            w = t.split()
            for _ in range(rng.randrange(0, 12)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
            rows.append((f"d{i}-{k}", " ".join(w).upper() + "!"))
    rows += [("null", None), ("empty", ""), ("blank", " !? "), ("short", "one"), ("short2", "One."), (None, "x y z"), ("long", "word " * 30_000)]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "id string, text string, key string, class int")
    by_spread = []
    for spread in (1, 2, 12):
        members, pairs = near_duplicates(df.repartition(spread), id="id", text=normal_words(F.col("text")), words=3, threshold=0.6, bands=112, band_rows=5, partitions=spread)
        by_spread.append(({(r.a, r.b): r.similarity for r in pairs.collect()}, {r.id: r["class"] for r in members.collect()}))
    assert by_spread[0] == by_spread[1] == by_spread[2]
    got, klass = by_spread[0]
    sets = {}
    for i, t in rows:
        if i and t is not None:
            w = re.findall(r"[a-z0-9]+", t.lower())
            sets[klass[i]] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    keys = sorted(k for k in sets if k)
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert set(got) == want and len(want) > 50
    assert klass["short"] == klass["short2"] and klass["empty"] == klass["blank"] == klass["null"] == 0 and None not in klass


def test_sketches_rule_out_no_pair(spark):
    rng, rows, want = random.Random(5), [], []
    for _ in range(200):
        n = rng.choice([1, 5, 60, 200, 900])
        a = [rng.getrandbits(63) for _ in range(n)]
        b = rng.sample(a, rng.randrange(n + 1)) + [rng.getrandbits(63) for _ in range(rng.randrange(n + 1))] or [1]
        size, bits = (len(a), len(b)), sketches(np.array([0] * len(a) + [1] * len(b)), np.array(a + b, dtype=np.uint64), 2).tolist()
        want.append(len(set(a) & set(b)) / len(set(a) | set(b)))
        rows.append((len(rows), size[0], *bits[0], size[1], *bits[1]))
    names = ["i"] + [f"{x}_{c}" for x in "ab" for c in ["size", *[f"s{i}" for i in range(SKETCH)]]]
    got = {r.i: r.m for r in spark.createDataFrame(rows, names).select("i", most_alike().alias("m")).collect()}
    assert all(got[i] >= w - 1e-12 for i, w in enumerate(want)) and any(got[i] < 0.6 for i in got)


def test_hot_keys_are_met_in_blocks_and_no_pair_is_lost(spark, monkeypatch):
    from wrenfield.llm import neardup

    monkeypatch.setattr(neardup, "BLOCK", 7)
    base = "one two three four five six seven eight nine ten " * 20
    rows = [(f"h{i}", base + f"w{i} x{i}") for i in range(40)] + [(f"c{i}", base) for i in range(30)]
    df = spark.createDataFrame(rows, "id string, text string")
    members, pairs = neardup.near_duplicates(df.repartition(5), id="id", text=normal_words(F.col("text")), words=3, threshold=0.6, bands=112, band_rows=5)
    assert pairs.count() == 41 * 40 // 2 and members.select("class").distinct().count() == 41
    none, nothing = neardup.near_duplicates(df.where("false"), id="id", text=normal_words(F.col("text")), words=3, threshold=0.6, bands=112, band_rows=5)
    assert none.count() == 0 and nothing.count() == 0


def test_p7_misses_less_than_one_in_seven_thousand():
    from wrenfield.llm.queries import P7

    assert (1 - P7["threshold"] ** P7["band_rows"]) ** P7["bands"] < 1 / 7000


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (20, 20), (7, 6), (6, 5), (4, 9), (None, 3)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 9: 1, 10: 10, 11: 10, 5: 5, 6: 5, 7: 5} | {100 + i: 100 for i in range(41)}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def _edited(n):
    base = [f"w{i * 7919 % 1000} " + " ".join(f"x{(i * 31 + j * j) % 97}" for j in range(40)) for i in range(n)]
    return [(f"{i}-{k}", t + f" end{k}") for i, t in enumerate(base) for k in range(2)]


def test_entries_take_the_same_bytes_in_any_number_of_buckets(spark):
    rows = spark.createDataFrame(_edited(40), "id string, t string")
    for partitions in (2, 600):
        sign = neardup.signed(rows, id="id", text=F.col("t"), words=3, bands=8, band_rows=4, partitions=partitions)
        binary = [c for c, kind in sign.dtypes if kind == "binary"]
        taken = sign.select(sum(F.coalesce(F.length(c), F.lit(0)) for c in binary).alias("n")).agg(F.sum("n")).first()[0]
        assert taken == 80 * 8 * 8


def test_classes_of_one_short_are_told_apart(spark, monkeypatch):
    rows = spark.createDataFrame(_edited(6), "id string, t string")

    def found():
        members, pairs = neardup.near_duplicates(rows, id="id", text=F.col("t"), words=3, threshold=0.6, bands=40, band_rows=3, partitions=3)
        ids = {r["class"]: r.id for r in members.collect()}
        got = pairs.collect()
        assert all(r.a < r.b for r in got)
        return sorted(tuple(sorted((ids[r.a], ids[r.b]))) for r in got)

    whole, hashes = found(), neardup.set_hashes
    monkeypatch.setattr(neardup, "set_hashes", lambda *a: hashes(*a) & np.uint64(0xFFFFFFFF) | np.uint64(5 << 32))
    assert len(whole) >= 6 and found() == whole
