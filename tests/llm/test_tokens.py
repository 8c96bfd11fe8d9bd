import os

import pytest
from pyspark.sql import functions as F

from wrenfield.llm.mixing import mix_report, mixed, packed_blocks, permuted, planned_counts, shard_counts
from wrenfield.llm.tokens import decoded, encoded, ranks_path

needs_files = pytest.mark.skipif(not os.path.exists(ranks_path()), reason="no tokenizer files here")
TEXTS = [None, "", " ", "\n\n  x", "It's  <|endoftext|> we'll\tgo\r\n", "Łękawka 学校现招聘 1,234 ½ ﷽", "é́ a b　c​", "🙂🙂 !!??  ", "a" * 5000, "word " * 20_000, "مرحبا بالعالم", "don'T I'M", "   trailing   "]


@needs_files
def test_ids_equal_the_library_and_come_back(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(ranks_path().replace(".tiktoken", ".json"))
    reference.encode_special_tokens = True
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, word string, salt int")
    ids = {r.doc_id: r.ids for r in encoded(docs).collect()}
    assert ids == {i: reference.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.text for r in decoded(encoded(docs)).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


@needs_files
def test_rare_words_come_back_in_their_places(spark, monkeypatch):
    from wrenfield.llm import tokens

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, "the same words") for i in range(9)], "doc_id bigint, text string")
    want = {r.doc_id: r.ids for r in encoded(docs).collect()}
    monkeypatch.setattr(tokens, "FREQUENT", {5: 3, 8: 1})
    assert {r.doc_id: r.ids for r in encoded(docs.repartition(3)).collect()} == want


@needs_files
def test_empty_corpus(spark):
    assert encoded(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def docs(spark):
    rows = [(i, s, [i * 100 + k for k in range(n)]) for i, (s, n) in enumerate([("a", 70), ("a", 33), ("b", 5), ("a", 1), ("b", 64), ("c", 900), (None, 9), ("d", 0)])]
    return rows, spark.createDataFrame(rows, "doc_id bigint, source string, ids array<int>")


def test_blocks_hold_every_token_once(spark):
    rows, df = docs(spark)
    blocks = packed_blocks(df, block=32, buckets=4).collect()
    for source in "abc":
        mine = sorted((b for b in blocks if b.source == source), key=lambda b: b.block)
        assert [b.block for b in mine] == list(range(len(mine))) and all(b.n_tokens == 32 for b in mine[:-1])
        flat, whole = [t for b in mine for t in b.tokens], {tuple(ids) for _, s, ids in rows if s == source}
        assert sorted(flat) == sorted(t for ids in whole for t in ids)
        assert all(flat[flat.index(ids[0]) : flat.index(ids[0]) + len(ids)] == list(ids) for ids in whole)
    assert {b.source for b in blocks} == {"a", "b", "c"}


def test_plans():
    blocks, tokens = {"a": 10, "b": 10, "c": 0}, {"a": 100, "b": 100, "c": 0}
    assert planned_counts(blocks, tokens, {"a": 0.5, "b": 0.5, "c": 0.1}, {"a": 1, "b": 3, "c": 9}) == {"a": 10, "b": 10}
    assert planned_counts(blocks, tokens, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3}, 300) == {"a": 10, "b": 20}
    assert planned_counts({}, {}, {"a": 1.0}, {"a": 1}) == {}
    drawn = shard_counts({"a": 100, "b": 57}, 32, 1)
    assert sum(n for _, s, _, n in drawn if s == "a") == 100 and sum(n for _, s, _, n in drawn if s == "b") == 57
    assert shard_counts({}, 32, 1) == []
    many = shard_counts({"a": 30_000, "b": 9_000, "c": 1, "d": 0}, 100, 3)
    sizes = {k: sum(n for j, _, _, n in many if j == k) for k in {j for j, *_ in many}}
    assert set(sizes.values()) == {100, 1} and [sum(n for _, s, _, n in many if s == x) for x in "abcd"] == [30_000, 9_000, 1, 0]
    own = [(f, n) for _, s, f, n in many if s == "a"]
    assert all(f + n == g for (f, n), (g, _) in zip(own, own[1:]))
    # As multinomial draws vary: 100 slots of which each is "a" with 0.769 have a deviation of 4.2.
    full = [n for k, s, _, n in many if s == "a" and sizes[k] == 100]
    assert 3.6 < (sum((n - 76.9) ** 2 for n in full) / len(full)) ** 0.5 < 4.8


def test_groups_of_shards(spark, monkeypatch):
    from wrenfield.llm import mixing

    monkeypatch.setattr(mixing, "GROUPS", 3)
    _, df = docs(spark)
    blocks = packed_blocks(df, block=8).cache()
    targets = spark.createDataFrame([("a", 0.4, 1), ("c", 0.6, 1)], "source string, target_share double, max_repeats bigint")
    mixture = mixed(blocks, targets, shard=2).collect()
    assert len({(r.shard, r.slot) for r in mixture}) == len(mixture) == len({(r.source, r.block) for r in mixture})
    assert {r.slot for r in mixture} == {0, 1} and {r.shard for r in mixture} == set(range(-(-len(mixture) // 2)))


@pytest.mark.parametrize("size", [1, 2, 3, 5, 17, 257, 1000, 4097, 65_537])
def test_permutations(spark, size):
    out = spark.range(size).select(permuted(F.col("id"), F.lit(size), F.lit(5)).alias("p")).collect()
    assert sorted(r.p for r in out) == list(range(size))


def test_mixture_keeps_caps_and_shares(spark):
    _, df = docs(spark)
    blocks = packed_blocks(df, block=8).cache()
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 1), ("none", 0.1, 5)], "source string, target_share double, max_repeats bigint")
    mixture = mixed(blocks, targets, shard=7)
    uses = {(r.source, r.block): r["count"] for r in mixture.groupBy("source", "block").count().collect()}
    assert max(n for (s, _), n in uses.items() if s != "b") == 1 and max(uses.values()) <= 2
    assert mixture.select("shard", "slot").distinct().count() == mixture.count()
    report = {r.source: r for r in mix_report(mixture, blocks, targets).collect()}
    assert abs(report["a"].actual_share - 0.5) < 0.06 and report["none"].mixed_tokens == 0
