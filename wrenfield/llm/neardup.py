"""Problem 7: near-duplicate records with small edits.

Shingles are hashed runs of words. SuperMinHash (Ertl 2017) gives each set a signature in which every element takes the
slots in an order of its own: ranks are whole numbers plus a fraction, so most slots are settled by the first few ranks and
the rest of the permutation is never drawn. Signatures are cut into bands; sets that share a band are verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenfield.llm.bitmap import kept_by_bitmap
from wrenfield.session import spooled

_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def normal_words(*texts: Column) -> Column:
    """Words (longest runs of letters and digits, lower case) with single blanks between."""
    return F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", *texts)), r"[^\p{L}\p{N}]+", " "))


#: Rows, and bytes of text, that Python works on at once: each word of a text takes about 200 bytes.
SLICE, SLICE_BYTES = 1024, 1 << 22
#: Bits of a shingle's hash; with the number of its set before them it makes one whole number, which sorts fast.
HASH_BITS = np.uint64(52)


def _slices(batches: Iterator[pa.RecordBatch], column: str = "words") -> Iterator[pa.RecordBatch]:
    """Batches of at most ``SLICE`` rows and, but for single rows, ``SLICE_BYTES`` bytes of text."""
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        upto = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(upto, upto[start] - size[start] + SLICE_BYTES, side="right"))
            stop = min(max(stop, start + 1), start + SLICE, batch.num_rows)
            yield batch.take(pa.array(np.arange(start, stop)))  # a copy of its own
            start = stop


def _mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse, at least n of each."""
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", inverse)):
                p = np.full(size, base, dtype=np.uint64)
                p[0] = 1
                _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash), sorted and distinct: the hashed runs of ``words`` words of each normalised text, of which there are at
    most 4,096. A text of fewer words has its whole as its one shingle, an empty one has none. All texts are hashed at once,
    over their joined bytes."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    if len(texts) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8, count=offsets[-1])[offsets[0] :]
    offsets = offsets - offsets[0]
    n = len(data)
    up, down = _powers(n + 1)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    blank = np.flatnonzero(data == 32)
    lengths = np.diff(offsets)
    full = np.flatnonzero(lengths > 0)
    starts = np.sort(np.concatenate([offsets[full], blank + 1]))
    ends = np.sort(np.concatenate([offsets[full] + lengths[full], blank]))
    count = np.diff(np.searchsorted(starts, np.append(offsets[full], n + 1)))
    owner = np.repeat(np.arange(len(full)), count)
    first = np.cumsum(count) - count
    last = first + count - 1
    at = np.arange(len(starts))
    keep = (at == first[owner]) | (at + words - 1 <= last[owner])
    at, owner = at[keep], owner[keep]
    stop = ends[np.minimum(at + words - 1, last[owner])]
    begin = starts[at]
    with np.errstate(over="ignore"):
        h = _mix((prefix[stop] - prefix[begin]) * down[begin] + (stop - begin).astype(np.uint64))
    both = np.sort((full[owner].astype(np.uint64) << HASH_BITS) | (h >> (np.uint64(64) - HASH_BITS)))
    both = both[np.append(True, both[1:] != both[:-1])]
    return (both >> HASH_BITS).astype(np.int64), both & ((np.uint64(1) << HASH_BITS) - np.uint64(1))


def super_min_hash(owner: np.ndarray, h: np.ndarray, sets: int, slots: int) -> np.ndarray:
    """Signatures (sets x slots) of sets given as sorted (owner, hash). Empty sets keep the largest value everywhere.

    Level j gives every element the j-th slot of its own permutation: two affine maps whose numbers come from its hash, with
    the digits of a slot turned about in between. What a level can fill is never beaten by a later one, so slots that are
    full are passed over, and elements of full sets are drawn no further.
    """
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(sets * slots, full, dtype=np.uint64)
    taken = np.zeros(sets * slots, dtype=bool)
    if len(owner) == 0:
        return sig.reshape(sets, slots)
    units = np.array([a for a in range(1, slots + 1) if math.gcd(a, slots) == 1], dtype=np.uint32)
    low = max(d for d in range(1, math.isqrt(slots) + 1) if slots % d == 0)
    turned = np.array([(x % low) * (slots // low) + x // low for x in range(slots)], dtype=np.uint32)
    with np.errstate(over="ignore"):
        r, q = _mix(h ^ np.uint64(_BASE)), _mix(h + _M1)
    part = lambda x, shift, n: ((x >> np.uint64(shift)) & np.uint64(0xFFFFFF)).astype(np.uint32) % np.uint32(n)
    a, x, c, d = units[part(r, 0, len(units))], part(r, 24, slots), units[part(q, 0, len(units))], part(q, 24, slots)
    base, size = owner * slots, np.uint32(slots)
    for j in range(slots):
        y = c * turned[x] + d
        cell = base + (y - y // size * size)
        free = np.flatnonzero(~taken[cell])
        cell = cell[free]
        with np.errstate(over="ignore"):
            rank = (np.uint64(j) << np.uint64(40)) | ((h[free] * np.uint64((_BASE * (2 * j + 1)) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(24))
        np.minimum.at(sig, cell, rank)
        taken[cell] = True
        x = x + a
        x -= size * (x >= size)
        if j % 4 == 3:
            live = ~taken.reshape(sets, slots).all(axis=1)[owner]
            if not live.any():
                break
            if not live.all():
                owner, h, a, x, c, d, base = (v[live] for v in (owner, h, a, x, c, d, base))
    return sig.reshape(sets, slots)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash a band of a signature, of ``HASH_BITS`` bits."""
    cut = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    with np.errstate(over="ignore"):
        key = np.zeros(cut.shape[:2], dtype=np.uint64)
        for r in range(rows):
            key = _mix(key * np.uint64(_BASE) + cut[:, :, r])
        return _mix(key + (np.arange(bands, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE)) >> (np.uint64(64) - HASH_BITS)


def set_hashes(owner: np.ndarray, h: np.ndarray, sets: int) -> np.ndarray:
    """An order-free hash of each set; 0 for the empty one. Of n sets two have one hash with a chance of n^2 / 2^65."""
    total = np.zeros(sets, dtype=np.uint64)
    if len(owner):
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        with np.errstate(over="ignore"):
            total[owner[first]] = np.add.reduceat(_mix(h + np.uint64(1)), first)
    return np.where(total == 0, total, _mix(total))


#: Words of 64 bits in a sketch.
SKETCH = 4


def sketches(owner: np.ndarray, h: np.ndarray, sets: int) -> np.ndarray:
    """(sets x SKETCH): a bit for each place that a set's hashes fall on."""
    bits = np.zeros((sets, 64 * SKETCH), dtype=bool)
    bits[owner, (h & np.uint64(64 * SKETCH - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1).view(np.int64)


def most_alike() -> Column:
    """What the similarity of sets ``a`` and ``b`` is at most, from a_size, a_s0, .. and b_size, b_s0, ..: each bit that only
    one sketch has is at least one element that only this set has."""
    alone = lambda x, y: sum(F.bit_count(F.col(f"{x}_s{i}").bitwiseAND(F.bitwise_not(f"{y}_s{i}"))) for i in range(SKETCH))
    common = F.least(F.col("a_size") - alone("a", "b"), F.col("b_size") - alone("b", "a"))
    return common / (F.col("a_size") + F.col("b_size") - common)


_DRAWN = "size int, " + ", ".join(f"s{i} bigint" for i in range(SKETCH))
#: Sets that a task remembers as signed; beyond it begins anew, and some copies are signed once more.
REMEMBERED = 200_000
#: Classes of one band key that meet in one place; larger groups are met block by block.
BLOCK = 512


def short(class_: Column) -> Column:
    """The upper 32 bits of a class, by which classes meet; two classes may have one."""
    return F.shiftright(class_, 32).cast("int")


def signed(rows: DataFrame, *, id: str, text: Column, words: int, bands: int, band_rows: int, partitions: int) -> DataFrame:
    """Two kinds of rows. Of each record: id, class (the hash of its shingle set) and, but for copies that the same task has
    met before, the size and sketch of the set. Of each slice of records and ``bucket``: as ``entries`` the band keys that fall
    into the bucket, 32 bits of each before the ``short`` of its class, so an entry takes 8 bytes however many buckets there are.

    Texts without a word, null ones too, have class 0 and are like nothing; records without an id are left out.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in _slices(batches):
            n, texts = batch.num_rows, batch.column("words")
            owner, h = shingle_sets(texts, words)
            hashes = set_hashes(owner, h, n)
            fresh = np.zeros(n, dtype=bool)
            if len(seen) > REMEMBERED:
                seen.clear()
            for i, c in enumerate(hashes.tolist()):
                if c and c not in seen:
                    seen.add(c)
                    fresh[i] = True
            slot = np.cumsum(fresh) - 1
            mine = fresh[owner]
            count = int(fresh.sum())
            new_owner, new_h = slot[owner[mine]], h[mine]
            keys = band_keys(super_min_hash(new_owner, new_h, count, bands * band_rows), bands, band_rows).ravel()
            size, bits = np.bincount(owner, minlength=n).astype(np.int32), np.zeros((n, SKETCH), dtype=np.int64)
            bits[fresh] = sketches(new_owner, new_h, count)
            spread = (hashes % np.uint64(partitions)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(spread), batch.column("id"), pa.array(hashes.view(np.int64)), pa.array(size, mask=~fresh), *[pa.array(bits[:, i], mask=~fresh) for i in range(SKETCH)], pa.nulls(n, pa.binary())],
                schema=kinds,
            )
            bucket = (keys % np.uint64(partitions)).astype(np.int32)
            entry = (keys // np.uint64(partitions) << np.uint64(32)) | np.repeat(hashes[fresh] >> np.uint64(32), bands)
            order = np.argsort(bucket, kind="stable")
            bucket, entry = bucket[order], entry[order]
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, dtype=np.int64)
            entries = [entry[lo:hi].tobytes() for lo, hi in zip(first, [*first[1:], len(bucket)])]
            m = len(first)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[first]), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), *[pa.nulls(m, pa.int64()) for _ in range(SKETCH)], pa.array(entries, pa.binary())],
                schema=kinds,
            )

    kinds = pa.schema([("bucket", pa.int32()), ("id", pa.string()), ("class", pa.int64()), ("size", pa.int32()), *[(f"s{i}", pa.int64()) for i in range(SKETCH)], ("entries", pa.binary())])
    read = rows.where(F.col(id).isNotNull()).select(F.col(id).cast("string").alias("id"), text.alias("words")).where("words is not null")
    return read.mapInArrow(sign, f"bucket int, id string, class bigint, {_DRAWN}, entries binary")


def _pairs_of(key: np.ndarray, classes: np.ndarray) -> Iterator[tuple[str, np.ndarray | list, np.ndarray | list]]:
    """("pairs", a, b): classes that share a key, a < b, once a call as far as they come at once; ("blocks", left, right):
    lists of classes that are to be met all with all, for keys of more than ``BLOCK`` classes."""
    order = np.argsort(key)
    key, classes = key[order], classes[order]
    new = np.append(True, key[1:] != key[:-1])
    group = np.cumsum(new) - 1
    shared = (np.bincount(group) > 1)[group]
    group, classes = group[shared], classes[shared]
    order = np.lexsort((classes, group))
    group, classes = group[order], classes[order]
    one = np.append(True, (group[1:] != group[:-1]) | (classes[1:] != classes[:-1]))[: len(group)]
    group, classes = group[one], classes[one]
    size = np.bincount(group) if len(group) else np.zeros(0, dtype=np.int64)
    big = np.flatnonzero(size > BLOCK)
    for g in big:
        lo, hi = np.searchsorted(group, [g, g + 1])
        chunks = [classes[i : min(i + BLOCK, hi)] for i in range(lo, hi, BLOCK)]
        for i, left in enumerate(chunks):
            yield "blocks", [left] * (len(chunks) - i), chunks[i:]
    small = (size <= BLOCK)[group] if len(group) else np.zeros(0, dtype=bool)
    group, classes = group[small], classes[small]
    a, b, held, at, d = [], [], 0, np.arange(len(group)), 0
    while len(at):
        d += 1
        at = at[at + d < len(group)]
        at = at[group[at] == group[at + d]]
        a.append(classes[at])
        b.append(classes[at + d])
        held += len(at)
        if held > 2_000_000 or not len(at):
            x, y = np.concatenate(a), np.concatenate(b)
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            one = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(x)]
            yield "pairs", x[one], y[one]
            a, b, held = [], [], 0


def met(sign: DataFrame, partitions: int) -> DataFrame:
    """(id, class, size, sketch, a, b, left, right): the records of ``signed``, and pairs of shorts of classes that share a band.

    The entries of a bucket come together in one task, 8 bytes a band and class; ``partitions`` is to be so large that a
    bucket takes a few ten MB. A key that very many classes have is not met there: its classes leave in blocks, of which
    every two are a row of their own (``left``, ``right``), to be met wherever there is room.
    """
    none = lambda n, kind: pa.nulls(n, kind)
    out = pa.schema([("id", pa.string()), ("class", pa.int64()), ("size", pa.int32()), *[(f"s{i}", pa.int64()) for i in range(SKETCH)], ("a", pa.int32()), ("b", pa.int32()), ("left", pa.list_(pa.int32())), ("right", pa.list_(pa.int32()))])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, classes = [], []
        for batch in batches:
            records = batch.filter(batch.column("entries").is_null())
            n = records.num_rows
            yield pa.RecordBatch.from_arrays([*[records.column(c) for c in out.names[: 3 + SKETCH]], none(n, pa.int32()), none(n, pa.int32()), none(n, out.field("left").type), none(n, out.field("left").type)], schema=out)
            for entry in batch.column("entries"):
                if entry.is_valid:
                    x = np.frombuffer(entry.as_buffer(), dtype=np.uint64)
                    keys.append((x >> np.uint64(32)).astype(np.uint32))
                    classes.append(x.astype(np.uint32).view(np.int32))
        if not keys:
            return
        for kind, a, b in _pairs_of(np.concatenate(keys), np.concatenate(classes)):
            step = 100_000 if kind == "pairs" else 16
            for i in range(0, len(a), step):
                x, y = a[i : i + step], b[i : i + step]
                n = len(x)
                lists = [none(n, pa.int32()), none(n, pa.int32()), pa.array(x, out.field("left").type), pa.array(y, out.field("left").type)] if kind == "blocks" else [pa.array(x), pa.array(y), none(n, out.field("left").type), none(n, out.field("left").type)]
                yield pa.RecordBatch.from_arrays([none(n, out.field(c).type) for c in out.names[: 3 + SKETCH]] + lists, schema=out)

    return sign.repartition(partitions, "bucket").mapInArrow(meet, f"id string, class bigint, {_DRAWN}, a int, b int, left array<int>, right array<int>")


def near_duplicates(rows: DataFrame, *, id: str, text: Column, words: int, threshold: float, bands: int, band_rows: int, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Members (id, class) and pairs (a, b, similarity), a < b, of classes whose shingle sets are at least ``threshold`` alike.

    Records of one shingle set are one class, and only classes are signed and meet; so copies are never paired here. Classes
    that share one of ``bands`` bands are candidates. Sketches rule out those that can't be alike enough, losing none; each
    other pair is verified once, on its whole sets. What comes out doesn't depend on how rows are spread over tasks.
    """
    spark = rows.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    all_ = spooled(met(signed(rows, id=id, text=text, words=words, bands=bands, band_rows=band_rows, partitions=partitions), partitions))
    members = all_.where("id is not null").select("id", "class")
    drawn = all_.where("size is not null").groupBy("class").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ["size", *[f"s{i}" for i in range(SKETCH)]]])
    blocks = all_.where("left is not null").select("left", "right").repartition(partitions)
    blocks = blocks.select(F.explode("left").alias("a"), "right").select("a", F.explode("right").alias("b")).where("a < b")
    # Classes of one short don't tell each other from themselves where bands meet; they are few, and all of them are candidates.
    twins = drawn.groupBy(short(F.col("class")).alias("a")).agg(F.count("*").alias("n")).where("n > 1").select("a", F.col("a").alias("b"))
    candidates = all_.where("a is not null").select("a", "b").union(blocks).distinct().union(twins)
    side = lambda x: drawn.select(short(F.col("class")).alias(x), F.col("class").alias(f"{x}_class"), *[F.col(c).alias(f"{x}_{c}") for c in drawn.columns[2:]])
    near = candidates.join(side("a"), "a").join(side("b"), "b").where("a <> b or a_class < b_class").where(most_alike() >= threshold - 1e-12)
    pairs = spooled(near.select(F.least("a_class", "b_class").alias("a"), F.greatest("a_class", "b_class").alias("b")))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(drawn.select("class", "id"), "class").select(F.col("id").alias("_id"))
    read = rows.where(F.col(id).isNotNull()).select(F.col(id).cast("string").alias("_id"), text.alias("words")).where("words is not null")

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            hashes = set_hashes(*shingle_sets(batch.column("words"), words), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column("words")], names=["class", "words"])

    texts = kept_by_bitmap(read, "_id", wanted).select("words").mapInArrow(classed, "class bigint, words string")
    with_a = pairs.join(texts.select(F.col("class").alias("a"), F.col("words").alias("wa")), "a")
    both = with_a.join(texts.select(F.col("class").alias("b"), F.col("words").alias("wb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "wa"):
            n = batch.num_rows
            owner, h = shingle_sets(pa.concat_arrays([batch.column("wa"), batch.column("wb")]), words)
            size = np.bincount(owner, minlength=2 * n)
            merged = np.sort(((owner % n).astype(np.uint64) << HASH_BITS) | h)
            common = np.bincount((merged[1:][merged[1:] == merged[:-1]] >> HASH_BITS).astype(np.int64), minlength=n)
            union = size[:n] + size[n:] - common
            alike = np.where(union > 0, common / np.maximum(union, 1), 0.0)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(alike)], names=["a", "b", "similarity"])
            yield out.filter(pa.array(alike >= threshold - 1e-12))

    # A class has a text for each of its records that the bitmap lets through: the same set, so one verdict.
    found = both.select("a", "b", "wa", "wb").mapInArrow(verify, "a bigint, b bigint, similarity double")
    return members, found.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
