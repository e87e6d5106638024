"""Caps, quotas, fills and guards over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import Scan


def per_key(df: DataFrame, keys: list[str], cap: int, *order) -> DataFrame:
    """The first ``cap`` rows of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where(F.col("_n") <= cap).drop("_n")


def priority_fill(df: DataFrame, key: str, group: list[str], passes: str, position: str, cap: int) -> DataFrame:
    """Rows taken pass by pass until each group holds ``cap``; a key counts in its earliest pass only."""
    once = F.row_number().over(Window.partitionBy(*group, key).orderBy(passes, position))
    taken = F.row_number().over(Window.partitionBy(*group).orderBy(passes, position))
    return df.withColumn("_k", once).where("_k = 1").withColumn("_n", taken).where(F.col("_n") <= cap).drop("_k", "_n")


def islands(df: DataFrame, pool: list[str], label: str, position: str) -> DataFrame:
    """Numbers runs of equal ``label`` within a pool as ``island``, from 1; a pool of any size spreads over many tasks."""
    return Scan(df, pool, position).runs("island", label).result("island")


def whole_islands(df: DataFrame, pool: list[str], label: str, position: str, cap: int) -> DataFrame:
    """Admits whole runs of a pool while they fit in ``cap``, skipping those that don't.

    Only a first run larger than the cap is cut to it, which ends the pool.
    The walk over a pool's runs is one fold over their sizes. Room never comes
    back, so once a run of some size is skipped all later ones of that size
    are; of each size at most cap / size runs can be admitted, and only the
    first so many enter the fold. A pool's list is bounded by the cap, not by
    the pool.
    """
    if cap < 1:
        return df
    runs = Scan(df, pool, position).runs("island", label).result("island", "_place")
    sizes = runs.groupBy(*pool, "island").agg(F.count(F.lit(1)).alias("size")).where((F.col("size") <= cap) | (F.col("island") == 1))
    place = F.row_number().over(Window.partitionBy(*pool, "size").orderBy("island"))
    listed = sizes.withColumn("_k", place).where(F.col("_k") <= cap).where(F.col("_k") * F.col("size") <= F.greatest(F.lit(cap), F.col("size")))
    listed = listed.groupBy(*pool).agg(F.array_sort(F.collect_list(F.struct("island", "size"))).alias("runs"))
    start = F.struct(F.lit(cap).cast("long").alias("room"), F.array().cast("array<bigint>").alias("taken"), F.lit(False).alias("cut"))

    def step(s, r):
        fits = r["size"] <= s["room"]
        first = (r["island"] == 1) & ~fits
        return F.struct(
            F.when(fits, s["room"] - r["size"]).when(first, F.lit(0).cast("long")).otherwise(s["room"]).alias("room"),
            F.when(fits | first, F.concat(s["taken"], F.array(r["island"].cast("long")))).otherwise(s["taken"]).alias("taken"),
            (s["cut"] | first).alias("cut"),
        )

    admitted = listed.select(*pool, F.aggregate("runs", start, step).alias("s")).select(*pool, F.explode("s.taken").alias("island"), F.col("s.cut").alias("_cut"))
    return runs.join(admitted, [*pool, "island"]).where(~F.col("_cut") | (F.col("_place") <= cap)).drop("_place", "_cut", "island")


def unsafe_guard(df: DataFrame, group: list[str], position: str, unsafe: str, least: int = 20, share: float = 0.05) -> DataFrame:
    """Running counts, and whether the share of unsafe rows has ever passed the limit after ``least`` rows."""
    scan = Scan(df, group, position).fold(attempts=("sum", F.lit(1).cast("long")), unsafe_so_far=("sum", F.col(unsafe).cast("long")))
    over = (F.col("attempts") >= least) & (F.col("unsafe_so_far") > share * F.col("attempts"))
    return scan.fold(aborted=("max", over)).result("attempts", "unsafe_so_far", "aborted")


def _streaks(scan: Scan, failed: Column) -> Scan:
    """Adds ``_bad``, failures so far, and ``streak``: those since the last success."""
    scan.fold(_bad=("sum", failed.cast("long"))).fold(_healed=("max", F.when(~failed, F.col("_bad"))))
    scan.rows = scan.rows.withColumn("streak", F.col("_bad") - F.coalesce("_healed", F.lit(0)))
    return scan


def failure_streaks(df: DataFrame, group: list[str], position: str, failed: str) -> DataFrame:
    """Length of the failure streak that ends at each row; 0 after a success."""
    return _streaks(Scan(df, group, position), F.col(failed)).result("streak")


def fill_to_cap(df: DataFrame, group: list[str], position: str, ok: str, cap: int, streak: int = 50) -> DataFrame:
    """Attempts made until ``cap`` successes, cap + max(cap, 20) failures, or ``streak`` failures in a row."""
    scan = _streaks(Scan(df, group, position), ~F.col(ok))
    scan.fold(_good=("sum", F.col(ok).cast("long"), False), _longest=("max", F.col("streak"), False))
    bad = F.col("_bad") - F.coalesce((~F.col(ok)).cast("long"), F.lit(0))  # before the row
    go = (F.col("_good") < cap) & (bad < cap + max(cap, 20)) & (F.coalesce("_longest", F.lit(0)) < streak)
    scan.rows = scan.rows.where(go)
    return scan.result()


def quotas(df: DataFrame, group: list[str], position: str, priority: str, cap: int, per_item: int, priority_ask: int) -> DataFrame:
    """How much each item of a group may ask for.

    Priority items are filled first, in order; what is left is spread evenly
    over the others, and then topped up in order.
    """
    w = Window.partitionBy(*group)
    upto = w.orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    ask = min(per_item, priority_ask)
    first = F.col(priority).cast("long")
    ahead = F.coalesce(F.sum(first).over(upto), F.lit(0))
    own = F.when(F.col(priority), F.greatest(F.lit(0), F.least(F.lit(ask), F.lit(cap) - ahead * ask)))
    left = F.greatest(F.lit(0), F.lit(cap) - F.sum(first).over(w) * ask)
    rest = F.sum(1 - first).over(w)
    each = F.greatest(F.lit(1), F.least(F.lit(per_item), F.floor(left / F.greatest(rest, F.lit(1)))))
    place = F.coalesce(F.sum(1 - first).over(upto), F.lit(0))
    even = F.greatest(F.lit(0), F.least(each, left - place * each))
    spread = df.withColumn("_left", left).withColumn("_even", F.when(~F.col(priority), even)).withColumn("_own", own)
    spare = F.greatest(F.lit(0), F.col("_left") - F.coalesce(F.sum("_even").over(w), F.lit(0)))
    room = F.lit(per_item) - F.col("_even")
    used = F.coalesce(F.sum(room).over(upto), F.lit(0))
    top_up = F.greatest(F.lit(0), F.least(room, spare - used))
    return spread.withColumn("_top", top_up).withColumn("quota", F.coalesce(F.col("_own"), F.col("_even") + F.col("_top")).cast("long")).drop("_left", "_even", "_own", "_top")
