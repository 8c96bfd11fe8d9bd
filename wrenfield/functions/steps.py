"""Stepwise projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def step(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns ``_name``: values that later steps use more than once. As a projection of their own they are
    computed once, and generated code stays small."""
    return rows.withColumns({f"_{name}": c for name, c in columns.items()})


def fenced(rows: DataFrame, keep: Column | None = None) -> DataFrame:
    """``rows`` for which ``keep`` holds. Unlike ``where`` this is never moved below the projections that made its columns,
    so their expressions are computed once; later filters stop here too."""
    whole = F.array(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    return rows.select(F.explode(whole if keep is None else F.when(keep, whole)).alias("_row")).select("_row.*")
