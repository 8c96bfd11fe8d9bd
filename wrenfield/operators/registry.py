"""A registry of named columns: adding a column means adding one entry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    key: str
    label: str
    group: str
    scope: str
    expr: Column


def first_filled(*columns: str | Column) -> Column:
    """The first value that is neither null nor empty, as text; else the empty text."""
    filled = [F.nullif(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")) for c in columns]
    return F.coalesce(*filled, F.lit(""))


def resolve(fields: list[Field], ticked: list[str], scope: str) -> list[Field]:
    """The ticked fields in their order; unknown keys, repeats and fields of another scope are dropped. Nothing ticked means all."""
    by_key = {f.key: f for f in fields if f.scope in (scope, "both")}
    return [by_key[k] for k in dict.fromkeys(ticked or list(by_key)) if k in by_key]


def project(rows: DataFrame, fields: list[Field]) -> DataFrame:
    """All cells as text; what can't be read is the empty text."""
    return rows.select(*[F.coalesce(f.expr.cast("string"), F.lit("")).alias(f.label) for f in fields])


def empty_cells(rows: DataFrame, fields: list[Field]) -> DataFrame:
    """(field, empty, n): how many cells of each field are empty, in one pass."""
    one = project(rows, fields)
    counts = one.agg(F.count("*").alias("_n"), *[F.count_if(F.col(f"`{f.label}`") == "").alias(f.label) for f in fields])
    pairs = F.explode(F.array(*[F.struct(F.lit(f.label).alias("field"), F.col(f"`{f.label}`").alias("empty")) for f in fields]))
    return counts.select("_n", pairs.alias("x")).select("x.field", "x.empty", F.col("_n").alias("n"))
