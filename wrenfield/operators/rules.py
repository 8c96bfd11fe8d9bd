"""Vocabularies as expressions: best hit of each family, discounts and vetoes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Term:
    label: str
    pattern: str
    weight: float


def hits(terms: list[Term], title: Column, body: Column, discount: float = 0.25) -> Column:
    """Array of struct(label, weight, in_title) of the terms found; one found in the title isn't looked for in the body."""
    found = [
        F.when(title.rlike(t.pattern), F.struct(F.lit(t.label).alias("label"), F.lit(float(t.weight)).alias("weight"), F.lit(True).alias("in_title"))).when(
            body.rlike(t.pattern), F.struct(F.lit(t.label).alias("label"), F.lit(t.weight * discount).alias("weight"), F.lit(False).alias("in_title"))
        )
        for t in terms
    ]
    return F.array_compact(F.array(*found))


def best(found: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(found, lambda h: h["weight"])), F.lit(0.0))


def relevance(core: Column, related: Column, veto: Column) -> Column:
    """0 to 100 from the hits of three families: the best core hit, the best related one (at 0.35 beside a core hit), up to 12
    for corroboration, less the veto: whole if it stands in a title without a core hit there, 0.6 without any core hit, else
    0.15. Halves round up."""
    has_core = F.size(core) > 0
    core_in_title = F.exists(core, lambda h: h["in_title"])
    veto_in_title = F.exists(veto, lambda h: h["in_title"])
    more = F.greatest(F.lit(0), F.least(F.lit(12), (F.size(core) + F.size(related) - 1) * 4))
    raw = best(core) + best(related) * F.when(has_core, 0.35).otherwise(1.0) + more
    off = best(veto) * F.when(~core_in_title & veto_in_title, 1.0).when(~has_core, 0.6).otherwise(0.15)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(raw - off + 0.5))).cast("int")


def labels_found(text: Column, patterns: dict[str, str]) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(label)) for label, p in patterns.items()]))


def first_label(text: Column, patterns: list[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern that matches: an ordered ladder of rules."""
    chain = reduce(lambda c, lp: F.when(text.rlike(lp[1]), lp[0]) if c is None else c.when(text.rlike(lp[1]), lp[0]), patterns, None)
    return F.coalesce(chain, F.lit(default))


def weighted_score(text: Column, weights: dict[str, float], whole: float) -> Column:
    """Weights of the patterns found as a share of ``whole``, 0 to 100, halves up."""
    total = reduce(lambda a, b: a + b, [F.when(text.rlike(p), float(w)).otherwise(0.0) for p, w in weights.items()])
    return F.least(F.lit(100), F.floor(total / whole * 100 + 0.5)).cast("int")
