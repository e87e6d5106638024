"""Joins by key: lookups with aliases, first row wins, overrides, exclusions by many keys, division."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed
from .ordering import marked_rows

#: Rows of a table that is sent to every task of a join at most; larger ones are shuffled.
MOST_SENT = 200_000


def sent(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """``df``, written once and marked to be sent to every task if it has at most ``most`` rows.

    Spark can't know beforehand how small the outcome of a window or a distinct
    is, and shuffles the large side of a join for it, by a handful of keys.
    """
    own = checkpointed(df)
    return F.broadcast(own) if own.limit(most + 1).count() <= most else own


def first_per(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in ``order``, which must be total for a defined result."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def alias_lookup(df: DataFrame, name: str, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """``id`` of each name: from ``names(key, id, priority)``, else through ``aliases(key, target)``.

    Of several definitions of a key the smallest priority wins.
    """
    first = first_per(names, ["key"], "priority", "id").select("key", "id")
    through = aliases.join(first, F.col("target") == first["key"]).select(aliases["key"].alias("alias"), F.col("id").alias("alias_id"))
    key = F.lower(F.trim(F.col(name)))
    return (
        df.join(first, key == first["key"], "left").drop("key")
        .join(through, key == through["alias"], "left")
        .withColumn("id", F.coalesce("id", "alias_id"))
        .drop("alias", "alias_id")
    )


def merged_keys(sets: list[DataFrame]) -> DataFrame:
    """The distinct rows of several key sets of the same columns; none at all is an error."""
    if not sets:
        raise ValueError("no key sets")
    out = sets[0]
    for more in sets[1:]:
        out = out.unionByName(more)
    return out.distinct()


def enriched(df: DataFrame, key: str, dimension: DataFrame, fields: list[str], *order) -> DataFrame:
    """Left join in which the last definition of a key wins; unmatched rows keep nulls."""
    own = first_per(dimension, [key], *order).select(key, *fields)
    return df.join(own, key, "left")


def labelled(df: DataFrame, key: str, dimension: DataFrame, options: list[Column], label: str) -> DataFrame:
    """Inner lookup that takes the first of ``options`` that isn't blank as ``label``; rows without one go."""
    text = F.coalesce(*[F.nullif(F.trim(o), F.lit("")) for o in options])
    return df.join(dimension, key).withColumn(label, text).where(F.col(label).isNotNull())


def fill_from_first(df: DataFrame, key: str, meta: DataFrame, fields: list[str], *order) -> DataFrame:
    """Left join in which the first ``meta`` row of a key fills what is missing (null or blank) in ``fields``."""
    own = first_per(meta, [key], *order).select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in fields])
    filled = {c: F.coalesce(F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)), F.col(f"_{c}")) for c in fields}
    joined = df.join(own, df[key] == own["_key"], "left")
    return joined.withColumns(filled).withColumn("matched", F.col("_key").isNotNull()).drop("_key", *[f"_{c}" for c in fields])


def override(df: DataFrame, key: str, evidence: DataFrame, fields: list[str], *order) -> DataFrame:
    """Left join that takes ``fields`` from the first evidence row alone: without one they are null."""
    own = first_per(evidence, [key], *order).select(key, *fields)
    return df.drop(*fields).join(own, key, "left")


def excluded(df: DataFrame, tokens: Column, reference: DataFrame, token: str = "token") -> DataFrame:
    """Rows one of whose ``tokens`` is in ``reference``: a semi-join on any of many keys."""
    rows = marked_rows(df)
    hit = rows.select("_row", F.explode(tokens).alias(token)).join(reference.select(token).distinct(), token, "left_semi").select("_row").distinct()
    return rows.join(hit, "_row", "left_semi").drop("_row")


def without_tainted(df: DataFrame, key: str, tainted: Column) -> DataFrame:
    """Rows whose key isn't held by a tainted row; rows with a null key stay unless tainted themselves."""
    bad = df.where(tainted).select(key).distinct()
    return df.where(~F.coalesce(tainted, F.lit(False))).join(bad, key, "left_anti")


def all_agree(df: DataFrame, key: str, holds: Column) -> DataFrame:
    """Keys all of whose rows (one at least) hold; a null counts as no."""
    return df.groupBy(key).agg(F.bool_and(F.coalesce(holds, F.lit(False))).alias("_all"), F.count(F.lit(1)).alias("n")).where("_all").drop("_all")


def divided(df: DataFrame, key: str, item: str, wanted: DataFrame) -> DataFrame:
    """Keys that meet every row of ``wanted(item)``: relational division."""
    need = wanted.select(item).distinct()
    count = need.agg(F.count(F.lit(1)).alias("need"))  # one row
    met = df.join(need, item, "left_semi").groupBy(key).agg(F.count_distinct(item).alias("met"))
    return met.join(F.broadcast(count), met["met"] == count["need"]).select(key)


def by_position(left: DataFrame, right: DataFrame, position: str) -> DataFrame:
    """Full join on an explicit position, so rows missing on either side show."""
    return left.join(right, position, "full_outer")


def allowlisted(df: DataFrame, key: str, fields: dict[str, list]) -> DataFrame:
    """``key`` and ``fields`` only; a filled field outside its listed values fails the load with the key and the field."""
    own = df.select(key, *fields)
    problem = F.coalesce(*[F.when(F.col(c).isNotNull() & ~F.col(c).isin(*values), c) for c, values in fields.items()])
    bad = own.select(key, problem.alias("_field")).where("_field IS NOT NULL").orderBy(key).limit(1).collect()
    if bad:
        raise ValueError(f"invalid: {bad[0][0]}.{bad[0][1]}")
    return own


def public(df: DataFrame, *more: str) -> DataFrame:
    """The columns that may be shown: none that begins with an underscore, and none of ``more``."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("_") and c not in more])


def from_evidence(df: DataFrame, key: str, fields: list[str], evidence: DataFrame) -> DataFrame:
    """``fields`` as a report of evidence has them: what rows say themselves doesn't count, and without evidence they are null."""
    own = evidence.select(F.col(key).alias("_key"), *fields)
    return df.drop(*fields).join(own, F.col(key) == F.col("_key"), "left").drop("_key")
