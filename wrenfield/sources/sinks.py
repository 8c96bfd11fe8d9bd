"""Sinks: guarded CSV, tab-separated text, keyed JSON and append-only lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenfield.functions.text import guarded_cell


def _texts(df: DataFrame, cell) -> DataFrame:
    return df.select(*[F.coalesce(cell(F.col(f"`{c}`").cast("string")), F.lit("")).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted CSV whose cells can't be taken for formulas; nulls are empty cells."""
    _texts(df, guarded_cell).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("lineSep", "\r\n").csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated cells without quotes that can't be taken for formulas; tabs and line ends within cells are blanks."""
    _texts(df, lambda c: guarded_cell(F.regexp_replace(c, r"[\t\r\n]+", " "))).write.mode("overwrite").option("header", True).option("sep", "\t").option("quote", "\u0000").option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str, generated_at: str | None = None) -> None:
    """Rows as JSON lines below ``path``/rows, and their headers, with when they were made, in ``path``/about."""
    df.write.mode("overwrite").json(f"{path}/rows")
    about = df.sparkSession.createDataFrame([(generated_at, df.columns)], "generatedAt string, headers array<string>")
    about.coalesce(1).write.mode("overwrite").json(f"{path}/about")


def append_jsonl(df: DataFrame, path: str, known: DataFrame | None = None, keys: list[str] | None = None) -> None:
    """Append rows; with ``known`` and ``keys`` only those whose keys aren't there yet, so a repeat adds nothing."""
    if known is not None and keys:
        df = df.dropDuplicates(keys).join(known.select(*keys), keys, "left_anti")
    df.write.mode("append").json(path)
