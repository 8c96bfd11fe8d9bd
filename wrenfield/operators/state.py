"""State over snapshots: every mutation is a function of the old snapshot and the changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, key: str, *, overwrite: list[str], fill: list[str], fill_empty: list[str] = (), keep: list[str] = (), constants: dict[str, Column] | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` put in by ``key`` (one row a key on both sides).

    Of keys in both, ``overwrite`` columns are the new ones, even null; ``fill`` are the new ones unless null, ``fill_empty``
    unless null or empty; ``keep`` are the old ones. ``constants`` are set wherever a new row came. ``change`` says
    ``inserted``, ``updated`` or ``kept``.
    """
    constants = constants or {}
    a, b = old.alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    came, was = F.col("b._new").isNotNull(), F.col(f"a.{key}").isNotNull()
    get = lambda side, c, df: F.col(f"{side}.{c}") if c in df.columns else F.lit(None)

    def rule(c: str) -> Column:
        x, y = get("a", c, old), get("b", c, new)
        if c in constants:
            return F.when(came, constants[c]).otherwise(x)
        if c in overwrite:
            return F.when(came, y).otherwise(x)
        if c in fill_empty:
            return F.coalesce(F.when(y != "", y), x)
        if c in fill:
            return F.coalesce(y, x)
        return F.when(was, x).otherwise(y)

    columns = [*overwrite, *fill, *fill_empty, *keep, *[c for c in constants if c not in (*overwrite, *fill, *fill_empty, *keep)]]
    change = F.when(~was, "inserted").when(came, "updated").otherwise("kept")
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[rule(c).alias(c) for c in columns], change.alias("change"))


def ran_sources(sources: DataFrame, delivered: DataFrame, source: str, *, failed: DataFrame | None = None, may_be_empty: list[str] = ()) -> DataFrame:
    """Those of ``sources`` that a run may be swept by: not among the ``failed``, and with rows ``delivered`` in the run, as a
    source that moved returns nothing without an error. Only sources of ``may_be_empty`` may deliver nothing."""
    came = delivered.select(source).distinct().withColumn("_came", F.lit(True))
    kept = sources if failed is None else sources.join(failed, source, "left_anti")
    return kept.join(came, source, "left").where(F.col("_came").isNotNull() | F.col(source).isin(*may_be_empty)).drop("_came")


def swept(state: DataFrame, seen: DataFrame, sources: DataFrame, key: str, source: str, at: Column, *, compat: bool = False) -> DataFrame:
    """``state`` after a run: rows of the enumerated ``sources`` that the run hasn't ``seen`` go from open to stale, and from
    stale to closed; ``closed_at`` is set on closing. Both steps read the status before the sweep; with ``compat`` a row that
    just went stale closes at once. Sources that failed or returned nothing must not be given (``ran_sources``)."""
    hit = seen.select(key).distinct().withColumn("_seen", F.lit(True))
    enumerated = sources.select(source).distinct().withColumn("_swept", F.lit(True))
    joined = state.join(hit, key, "left").join(enumerated, source, "left")
    missing = F.col("_swept").isNotNull() & F.col("_seen").isNull()
    closing = missing & F.col("status").isin(*(("open", "stale") if compat else ("stale",)))
    status = F.when(closing, "closed").when(missing & (F.col("status") == "open"), "stale").otherwise(F.col("status"))
    return joined.withColumn("closed_at", F.when(closing, at).otherwise(F.col("closed_at"))).withColumn("status", status).drop("_seen", "_swept")


def expired(state: DataFrame, deadline: Column, as_of: Column) -> DataFrame:
    """Rows whose deadline is past are closed; null deadlines never are."""
    past = F.coalesce((F.col("status") != "closed") & (deadline < as_of), F.lit(False))
    return state.withColumn("closed_at", F.when(past, as_of).otherwise(F.col("closed_at"))).withColumn("status", F.when(past, "closed").otherwise(F.col("status")))


def folded(events: DataFrame, key: str, order: list[str], kind: str, *, on: str, off: str, skip: str, unskip: str) -> DataFrame:
    """(key, applied, skipped): state of each key after its ordered events. Skipping is ignored while applied, and applying
    removes a skip. A running maximum over the key's events replaces a fold of collected lists: whether a key is applied
    before an event follows from the last ``on`` or ``off`` before it."""
    w = Window.partitionBy(key).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    place = F.row_number().over(w)
    marked = events.withColumn("_at", place).withColumn("_was", F.last(F.when(F.col(kind).isin(on, off), F.col(kind)), ignorenulls=True).over(before))
    counts = F.col(kind).isin(on, unskip) | ((F.col(kind) == skip) & F.coalesce(F.col("_was") != on, F.lit(True)))
    return marked.groupBy(key).agg(
        F.coalesce(F.max_by(kind, F.when(F.col(kind).isin(on, off), F.col("_at"))) == on, F.lit(False)).alias("applied"),
        F.coalesce(F.max_by(kind, F.when(counts, F.col("_at"))) == skip, F.lit(False)).alias("skipped"),
    )


def merged_snapshots(a: DataFrame, b: DataFrame, key: str, fresh: str, columns: list[str]) -> DataFrame:
    """Union of keys: the fresher row (ties: ``a``'s) is the base, its null and empty cells are filled from the other."""
    x, y = a.alias("x"), b.alias("y")
    both = x.join(y, F.col(f"x.{key}") == F.col(f"y.{key}"), "full")
    left = F.col(f"y.{key}").isNull() | F.coalesce(F.col(f"x.{fresh}") >= F.col(f"y.{fresh}"), F.col(f"x.{fresh}").isNotNull() | F.col(f"y.{fresh}").isNull()) & F.col(f"x.{key}").isNotNull()
    filled = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    cell = lambda c: F.when(left, F.coalesce(filled(f"x.{c}"), filled(f"y.{c}"))).otherwise(F.coalesce(filled(f"y.{c}"), filled(f"x.{c}")))
    return both.select(F.coalesce(f"x.{key}", f"y.{key}").alias(key), F.greatest(f"x.{fresh}", f"y.{fresh}").alias(fresh), *[cell(c).alias(c) for c in columns])


def health(counts: DataFrame, source: str, run: str, raw: str, failed: str) -> DataFrame:
    """(source, status, raw, usual): the latest run of each source against the median of up to ten sound runs before it.

    ``failed``, then fewer than three sound runs are ``new``; a usual of five or more makes nothing ``empty`` and less than 40 per
    cent ``low``; all else is ``ok``."""
    w = Window.partitionBy(source).orderBy(F.col(run).desc())
    ranked = counts.withColumn("_rn", F.row_number().over(w))
    history = F.when(F.col("_rn").between(2, 11) & ~F.col(failed), F.col(raw))
    per = ranked.groupBy(source).agg(
        F.max(F.when(F.col("_rn") == 1, F.col(raw))).alias("raw"), F.bool_or(F.when(F.col("_rn") == 1, F.col(failed))).alias("bad"), F.count(history).alias("n"), F.median(history).alias("usual")
    )
    status = F.when(F.col("bad"), "failed").when(F.col("n") < 3, "new").when((F.col("usual") >= 5) & (F.col("raw") == 0), "empty").when((F.col("usual") >= 5) & (F.col("raw") < 0.4 * F.col("usual")), "low").otherwise("ok")
    return per.select(source, status.alias("status"), "raw", "usual")
