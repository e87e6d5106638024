"""Faceted search with three outcomes: match, miss, unverified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH, UNVERIFIED, MISS = 0, 1, 2


def facet(value: Column, accepted: list[str], hold: Column | None = None) -> Column:
    """Outcome of one facet: any accepted value matches, an unknown one is unverified.

    ``value`` is a string or an array of them; null and empty are unknown. Where
    ``hold`` is true a miss stays visible as unverified.
    """
    values = F.array_compact(value)
    known = F.coalesce(F.size(values) > 0, F.lit(False))
    hit = F.arrays_overlap(values, F.array(*[F.lit(a) for a in accepted]))
    miss = F.lit(MISS) if hold is None else F.when(F.coalesce(hold, F.lit(False)), UNVERIFIED).otherwise(MISS)
    return F.when(~known, UNVERIFIED).when(hit, MATCH).otherwise(miss)


def filtered(df: DataFrame, outcomes: list[Column]) -> DataFrame:
    """Rows without a miss; ``outcome`` is match or unverified. Facets are joined by AND, none gives a match."""
    worst = F.greatest(*outcomes) if len(outcomes) > 1 else outcomes[0] if outcomes else F.lit(MATCH)
    return df.withColumn("outcome", F.when(worst == MATCH, "match").when(worst == UNVERIFIED, "unverified")).where(F.col("outcome").isNotNull())


def found(query: str, columns: list[Column], lists: list[Column] = ()) -> Column:
    """Accent-blind substring search over columns and elements of lists; an empty query finds all."""
    from ..functions.text import search_key

    wanted = search_key(F.lit(query))
    hit = wanted == ""
    for c in columns:
        hit = hit | F.coalesce(F.contains(search_key(c), wanted), F.lit(False))
    for a in lists:
        hit = hit | F.coalesce(F.exists(a, lambda x: F.contains(search_key(x), wanted)), F.lit(False))
    return hit


def kept_chips(chosen: Column, panel: list[str]) -> tuple[Column, Column]:
    """The chosen facets that a panel has, in their order, and those it hasn't."""
    inside = F.array(*[F.lit(p) for p in panel])
    return F.filter(chosen, lambda c: F.array_contains(inside, c)), F.array_except(chosen, inside)


def fact_problem(tokens: dict[str, tuple[Column, list[str], bool]], ranges: dict[str, tuple[Column, Column]]) -> Column:
    """The first field whose tokens aren't of its vocabulary (or are none, where that isn't allowed), or whose range is upside down.

    A range may lack one bound, not both.
    """
    out = F.lit(None).cast("string")
    checks = [(n, (F.size(c) == 0 if not empty else F.lit(False)) | (F.size(F.array_except(c, F.array(*map(F.lit, known)))) > 0)) for n, (c, known, empty) in tokens.items()]
    checks += [(n, (low.isNull() & high.isNull()) | F.coalesce(low > high, F.lit(False))) for n, (low, high) in ranges.items()]
    for name, bad in reversed(checks):
        out = F.when(F.coalesce(bad, F.lit(True)), name).otherwise(out)
    return out


def partition_sizes(df: DataFrame, *keys: str) -> DataFrame:
    """Of rows with an ``outcome``: ``matches``, ``unverified`` and ``visible``, both together."""
    sizes = df.groupBy(*keys).agg(F.count_if(F.col("outcome") == "match").alias("matches"), F.count_if(F.col("outcome") == "unverified").alias("unverified"))
    return sizes.withColumn("visible", F.col("matches") + F.col("unverified"))
