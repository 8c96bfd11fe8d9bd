"""Problem 9: mixing sources to target weights."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenfield.session import spooled


def packed_blocks(tokens: DataFrame, *, id: str = "doc_id", source: str = "source", ids: str = "ids", block: int = 256, buckets: int | None = None) -> DataFrame:
    """(source, block, n_tokens, tokens): each source's tokens end to end in blocks of ``block``; the last may be shorter.
    Rows without a source and without tokens have no part in it.

    Documents stand in the order of a hash of their id. Positions are a two-level prefix sum: totals of hash ranges of a
    source, then sums within each range, so no source is one task's work; ``buckets`` of them a source, by default so many
    that one holds 20,000 documents at most. Blocks are put together where a range is; only what lies over its ends moves on.
    """
    docs = tokens.select(F.col(source).alias("source"), F.col(id).alias("id"), F.col(ids).alias("ids")).where("source is not null and size(ids) > 0")
    buckets = buckets or max(16, -(-tokens.count() // 20_000))
    docs = docs.select("*", F.size("ids").cast("bigint").alias("n"), F.xxhash64("id").alias("h")).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    totals = docs.groupBy("source", "bucket").agg(F.sum("n").alias("n_bucket"))
    base = totals.select("source", "bucket", (F.sum("n_bucket").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n_bucket")).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(base, ["source", "bucket"])
    start = F.col("base") + F.col("before")
    spans = placed.select("source", "bucket", "ids", start.alias("start"), F.col("n")).select(
        "source", "bucket", "ids", "start", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("n") - 1) / block))).alias("block")
    )
    first = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    last = F.least((F.col("block") + 1) * block - F.col("start"), F.size("ids"))
    pieces = spans.select("source", "bucket", "block", (F.col("start") + first).alias("at"), F.slice("ids", (first + 1).cast("int"), (last - first).cast("int")).alias("part"))
    # A block holds at most ``block`` tokens, so its group is bounded. The ranges are where they are: no shuffle here.
    together = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]))
    grown = spooled(pieces.groupBy("source", "bucket", "block").agg(F.min("at").alias("at"), together.alias("part")))
    ends = grown.where(F.size("part") < block).groupBy("source", "block").agg(together.alias("tokens"))
    whole = grown.where(F.size("part") == block).select("source", "block", F.col("part").alias("tokens"))
    return whole.unionByName(ends).select("source", "block", F.size("tokens").alias("n_tokens"), "tokens")


def planned_counts(blocks: dict[str, int], tokens: dict[str, int], shares: dict[str, float], repeats: dict[str, int], total: int | None = None) -> dict[str, int]:
    """How many block slots each source gets. Without ``total`` (tokens), as many as keep every share within the caps; with
    it, sources at their cap leave the rest to the others in proportion. Sources without tokens, share or repeats get none."""
    live = {s: w for s, w in shares.items() if w > 0 and tokens.get(s, 0) > 0 and repeats.get(s, 0) > 0}
    caps = {s: float(tokens[s] * repeats[s]) for s in live}
    if not live:
        return {}
    if total is None:
        weight = sum(live.values())
        left = min(caps[s] * weight / w for s, w in live.items())
    else:
        left = float(total)
    want, open_ = dict.fromkeys(live, 0.0), dict(live)
    while open_ and left > 1e-9:
        weight = sum(open_.values())
        full = [s for s, w in open_.items() if left * w / weight >= caps[s] - 1e-6]
        if not full:
            want |= {s: left * w / weight for s, w in open_.items()}
            break
        for s in full:
            want[s] = caps[s]
            left -= caps[s]
            del open_[s]
    # A source's last block may be short: its average block counts.
    return {s: min(math.floor(x * blocks[s] / tokens[s] + 0.5), blocks[s] * repeats[s]) for s, x in want.items()}


def shard_counts(counts: dict[str, int], shard: int, seed: int) -> list[tuple[int, str, int, int]]:
    """(shard, source, first index, count): multinomial draws of the sources of each shard's slots. ``shard`` is the number of
    slots of one. What a source was drawn too often, some roots of its total, goes from shards by chance to the sources that
    were drawn too seldom, so that the totals are those of ``counts``."""
    rng = np.random.default_rng(seed)
    sources = sorted(s for s in counts if counts[s] > 0)
    want = np.array([counts[s] for s in sources], dtype=np.int64)
    total = int(want.sum())
    if not total:
        return []
    sizes = np.full(-(-total // shard), shard, dtype=np.int64)
    sizes[-1] = total - shard * (len(sizes) - 1)
    drawn = rng.multinomial(sizes, want / total).astype(np.int64)
    over = drawn.sum(axis=0) - want
    free = np.zeros(len(sizes), dtype=np.int64)
    for i in np.flatnonzero(over > 0):
        gone = rng.multivariate_hypergeometric(drawn[:, i], int(over[i]), method="marginals")
        drawn[:, i] -= gone
        free += gone
    for i in np.flatnonzero(over < 0):
        come = rng.multivariate_hypergeometric(free, int(-over[i]), method="marginals")
        drawn[:, i] += come
        free -= come
    first = np.cumsum(drawn, axis=0) - drawn
    return [(int(k), sources[i], int(first[k, i]), int(drawn[k, i])) for k, i in zip(*np.nonzero(drawn))]


def permuted(index: Column, size: Column, key: Column, rounds: int = 4) -> Column:
    """A pseudorandom permutation of 0..size-1 by ``key``: a Feistel network over a x b, the least such rectangle of two nearly
    equal sides, walked until it falls inside. At most a quarter lies outside, for large sizes one of its root; a walk that
    is outside after 64 steps, which has a chance below 4^-64, is an error."""
    size = size.cast("bigint")
    a = F.ceil(F.sqrt(size.cast("double")))
    b = F.ceil(size / a)

    def network(x: Column) -> Column:
        def one(s: Column, r: Column) -> Column:
            left = F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], key, r), s["a"]), s["a"])
            right = F.pmod(s["r"] + F.pmod(F.xxhash64(left, key, -r), s["b"]), s["b"])
            return F.struct(left.alias("l"), right.alias("r"), s["a"].alias("a"), s["b"].alias("b"))

        start = F.struct(F.floor(x / b).alias("l"), (x % b).alias("r"), a.alias("a"), b.alias("b"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, one, lambda s: s["l"] * s["b"] + s["r"])

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(64)), network(index.cast("bigint")), lambda x, _: F.when(x < size, x).otherwise(network(x)), lambda x: F.struct(x.alias("x")))
    return F.when(walk["x"] < size, walk["x"]).otherwise(F.raise_error(F.lit("a walk of the permutation fell outside")).cast("bigint"))


#: Groups of shards that are drawn in the driver; the shards of each are drawn where it lies.
GROUPS = 1024


def mixed(blocks: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, shard: int = 4096, seed: int = 7) -> DataFrame:
    """(shard, slot, source, block, round, n_tokens, tokens): the mixture, one row a slot.

    ``targets`` has ``source``, ``target_share`` and ``max_repeats``. Each shard's slots are split over the sources by a
    multinomial draw; a source's k-th slot takes block ``permutation(round)(k mod blocks)`` in round ``k div blocks``, so
    no block comes more often than ``max_repeats`` and none a second time before all came once. Blocks join by index.

    To the driver come one row a source, and it draws for ``GROUPS`` groups of shards at most; each group is drawn on into
    its shards by the task that has it.
    """
    spark = blocks.sparkSession
    stock = blocks.groupBy("source").agg(F.count("*").alias("blocks"), F.sum("n_tokens").alias("tokens"))
    plan = targets.groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).join(stock, "source", "left").collect()
    have, shares = {r.source: r.blocks or 0 for r in plan}, {r.source: r.share or 0.0 for r in plan}
    counts = planned_counts(have, {r.source: r.tokens or 0 for r in plan}, shares, {r.source: r.repeats or 0 for r in plan}, total_tokens)
    shards = max(1, -(-sum(counts.values()) // shard))
    per_group = -(-shards // GROUPS)
    groups = pd.DataFrame([(k, s, f, n, have[s]) for k, s, f, n in shard_counts(counts, per_group * shard, seed)], columns=["group", "source", "first", "count", "stock"])
    schema = "group bigint, source string, first bigint, count bigint, stock bigint"
    drawn = spark.createDataFrame(groups, schema) if len(groups) else spark.createDataFrame([], schema)

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        group, own = int(rows["group"].iloc[0]), rows.set_index("source")
        parts = shard_counts({s: int(n) for s, n in own["count"].items()}, shard, seed * 1_000_003 + group + 1)
        return pd.DataFrame([(group * per_group + k, s, int(own["first"][s]) + f, n, int(own["stock"][s])) for k, s, f, n in parts], columns=["shard", "source", "first", "count", "stock"])

    # A group has one row a source.
    parts = drawn.groupBy("group").applyInPandas(split, "shard bigint, source string, first bigint, count bigint, stock bigint")
    slots = parts.select("shard", "source", "stock", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("k"))
    slots = slots.select("shard", "source", "k", F.floor(F.col("k") / F.col("stock")).alias("round"), (F.col("k") % F.col("stock")).alias("i"), "stock")
    slots = slots.withColumn("block", permuted(F.col("i"), F.col("stock"), F.xxhash64("source", "round", F.lit(seed))))
    # The order within a shard is pseudorandom too; a shard is a bounded window.
    order = Window.partitionBy("shard").orderBy(F.xxhash64("source", "k", F.lit(seed)), "source", "k")
    slots = slots.select("shard", (F.row_number().over(order) - 1).alias("slot"), "source", "block", "round")
    return slots.join(blocks, ["source", "block"]).select("shard", "slot", "source", "block", "round", "n_tokens", "tokens")


def mix_report(mixture: DataFrame, blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source with a target: its tokens, its tokens in the mixture, target and actual share, and the most repeats of a block."""
    stock = blocks.groupBy("source").agg(F.sum("n_tokens").alias("own_tokens"))
    uses = mixture.groupBy("source", "block").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("t")).groupBy("source").agg(F.max("uses").alias("most_repeats"), F.sum("t").alias("mixed_tokens"))
    rows = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).join(stock, "source", "left").join(uses, "source", "left")
    whole = F.sum(F.coalesce("mixed_tokens", F.lit(0))).over(Window.partitionBy(F.lit(1)))
    return rows.select(
        "source", F.coalesce("own_tokens", F.lit(0)).alias("own_tokens"), F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), "target_share",
        F.round(F.coalesce("mixed_tokens", F.lit(0)) / F.when(whole > 0, whole), 6).alias("actual_share"), "max_repeats", F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
