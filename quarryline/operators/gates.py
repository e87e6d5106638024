"""Checks that hold a release back: ownership, pinned lists, floors, reconciliation, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import whole_count


def owned_twice(df: DataFrame, key: str, owner: str) -> DataFrame:
    """Keys that more than one owner claims; a key may repeat within one owner."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(owner)).alias("owners")).where("size(owners) > 1")


def unlike_pinned(found: DataFrame, pinned: DataFrame, key: str) -> DataFrame:
    """``key, fault``: what is ``missing`` of a pinned list, and what is ``unknown`` to it."""
    a, b = found.select(key).distinct(), pinned.select(key).distinct()
    return b.join(a, key, "left_anti").withColumn("fault", F.lit("missing")).unionByName(a.join(b, key, "left_anti").withColumn("fault", F.lit("unknown")))


def below_floor(df: DataFrame, floors: DataFrame, name: str, value: str) -> DataFrame:
    """``seq, name, value, floor`` of floors ``(seq, name, floor)`` that aren't reached; a missing or unfit count doesn't reach any."""
    got = floors.join(df.select(name, whole_count(F.col(value)).alias("_v")), name, "left")
    return got.where(F.col("_v").isNull() | (F.col("_v") < F.col("floor"))).select("seq", name, F.col("_v").alias("value"), "floor")


def group_floors(members: DataFrame, counts: DataFrame, floor: int) -> DataFrame:
    """``grp, total, short``: sums over the members of a group; a missing member leaves the total null, which is short."""
    both = members.join(counts, "name", "left")
    out = both.groupBy("grp").agg(F.when(F.bool_and(F.col("n").isNotNull()), F.sum("n")).alias("total"))
    return out.withColumn("short", F.coalesce(F.col("total") < floor, F.lit(True)))


def reconciled(rows: DataFrame, expected: int | Column, forbidden: Column) -> DataFrame:
    """One row: the count of rows, whether it is what was announced, and whether a forbidden row is among them."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or(forbidden), F.lit(False)).alias("forbidden")).withColumn("agrees", F.col("n") == expected)


def agreement(pairs: DataFrame, rates: dict[str, Column], least: float, images: int | None = None) -> DataFrame:
    """``metric, value, passed`` of the shares of pairs that agree; all fail unless there are ``images`` pairs, where that is given."""
    one = pairs.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(n) for n, c in rates.items()])
    long = one.unpivot(["_n"], list(rates), "metric", "value")
    whole = F.lit(True) if images is None else F.col("_n") == images
    return long.select("metric", "value", (F.coalesce(F.col("value") >= least, F.lit(False)) & whole).alias("passed"))


def blockers(statuses: DataFrame, acknowledged: DataFrame, label: str) -> DataFrame:
    """Classes that hold a release back: acknowledged ones as ``blocker``, hard stops nobody acknowledged as ``stop``."""
    known = statuses.join(acknowledged.select(label).distinct(), label, "left_semi").where("status <> 'ok'").select(label, F.lit("blocker").alias("kind"))
    open_ = statuses.where("status = 'stop'").join(acknowledged.select(label), label, "left_anti").select(label, F.lit("stop").alias("kind"))
    return known.unionByName(open_)


def install_target(wanted_small: Column, full_ok: Column, small_ok: Column) -> Column:
    """``small`` if it is wanted and may ship, else ``full`` if that may, else ``none``; what isn't known may not ship."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    return F.when(ok(wanted_small) & ok(small_ok), "small").when(ok(full_ok), "full").otherwise("none")


def sample_reasons(counts: DataFrame, expected: DataFrame, groups: DataFrame, floor: int, rare: int, total: int) -> DataFrame:
    """``seq, level, name, reason``: why a sample of named items is too small or unsafe, in order: items, groups, all.

    ``counts(name, support, confident)`` may lack names or hold what isn't a
    count; ``expected(name, place, grp, exempt)`` lists the names in order,
    the group that each belongs to, if any, and whether the lower floor
    ``rare`` holds for it; ``groups(grp, place, minimum)``. Names that weren't
    expected count for the total. An item that is missing or unfit counts
    nowhere, and it suppresses the sum of its group, which then is short
    whatever the others have, and the sum of all. One pass over grouping sets
    gives all three levels; a level's sum is null if one of its members is.
    """
    given = counts.select("name", whole_count(F.col("support").cast("string")).alias("support"), whole_count(F.col("confident").cast("string")).alias("confident"), F.lit(True).alias("_given"))
    both = expected.join(given, "name", "full_outer").join(groups.select("grp", F.col("place").alias("_gplace"), "minimum"), "grp", "left")
    fit = both.withColumn("support", F.when(F.col("confident").isNotNull(), F.col("support")))
    whole = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))
    sums = fit.groupingSets([["grp", "name"], ["grp"], []], "grp", "name").agg(
        F.grouping_id().alias("gid"), whole("support").alias("support"), F.sum("confident").alias("confident"), F.min("place").alias("place"), F.min("_gplace").alias("gplace"),
        F.min("minimum").alias("minimum"), F.bool_or(F.coalesce("exempt", F.lit(False))).alias("exempt"), F.coalesce(F.bool_or("_given"), F.lit(False)).alias("given"),
    )
    item, group, s, c = F.col("gid") == 0, (F.col("gid") == 1) & F.col("minimum").isNotNull(), F.col("support"), F.col("confident")
    found = {
        (1, "missing"): item & ~F.col("given"), (2, "not_a_count"): item & F.col("given") & s.isNull(),
        (3, "below_floor"): item & ~F.col("exempt") & (s < floor), (4, "below_rare_floor"): item & F.col("exempt") & (s < rare), (5, "exempt_but_unsafe"): item & F.col("exempt") & (c > 0) & s.isNotNull(),
        (6, "member_missing"): group & s.isNull(), (7, "group_below_minimum"): group & (s < F.col("minimum")),
        (8, "total_unknown"): (F.col("gid") == 3) & s.isNull(), (9, "total_below_minimum"): (F.col("gid") == 3) & (s < total), (10, "unsafe_outcomes"): (F.col("gid") == 3) & (c > 0),
    }
    reasons = F.array_compact(F.array(*[F.when(holds, F.struct(F.lit(n).alias("rule"), F.lit(why).alias("reason"))) for (n, why), holds in found.items()]))
    level = F.when(item, "item").when(F.col("gid") == 1, "group").otherwise("all")
    rows = sums.select(level.alias("level"), F.coalesce("name", "grp", F.lit("")).alias("name"), F.coalesce("place", F.lit(1 << 40)).alias("_p"), F.coalesce("gplace", F.lit(0)).alias("_g"), F.explode(reasons).alias("r"))
    # reasons are few: a row for each that holds a release back
    order = Window.orderBy(F.when(F.col("level") == "item", 1).when(F.col("level") == "group", 2).otherwise(3), F.when(F.col("level") == "item", F.col("_p")).otherwise(F.col("_g")), "name", "r.rule")
    return rows.select(F.row_number().over(order).alias("seq"), "level", "name", F.col("r.reason").alias("reason"))


def recorded_threshold(df: DataFrame, group: str, value: str, recorded: DataFrame, rate: float = 0.97, least: int = 8) -> DataFrame:
    """``n`` and ``outcome`` of each group: whether ``recorded(group, recorded)`` is the threshold that its values give.

    ``too_few`` values give none; else the record is the ``same``, ``differs``,
    or is ``missing``, which doesn't pass either.
    """
    exact = F.expr(f"percentile_disc({rate}) WITHIN GROUP (ORDER BY {value})")
    found = df.groupBy(group).agg(F.count(value).alias("n"), exact.alias("_t")).join(recorded.select(group, "recorded"), group, "left")
    outcome = F.when(F.col("n") < least, "too_few").when(F.col("recorded").isNull(), "missing").when(F.col("recorded") == F.col("_t"), "same").otherwise("differs")
    return found.select(group, "n", outcome.alias("outcome"))


def device_reasons(report: DataFrame, model: str, sample: str, images: int, risky: int, platforms: list[str], fields: list[str], least: float = 0.99) -> DataFrame:
    """``seq, reason``: why measurements of a device, a row each, don't pass; a report without rows is ``missing``.

    Platform, place, digests of the model and of the sample, both counts of
    images and the compared fields must be those expected, four rates of
    agreement reach ``least``, and the largest gap of energies be known. What
    is null doesn't hold.
    """
    rates = ("top1_agreement", "high_risk_top1_agreement", "decision_agreement", "high_risk_decision_agreement")
    holds = {
        "platform": F.col("platform").isin(*platforms), "measured_on": F.col("measured_on") == "device", "model_sha256": F.col("model_sha256") == (model or None), "sample_sha256": F.col("sample_sha256") == (sample or None),
        "images": (F.col("images") == images) & (F.col("images") >= 1), "high_risk_images": (F.col("high_risk_images") == risky) & (F.col("high_risk_images") >= 1),
        "decision_fields": F.col("decision_fields") == F.array(*map(F.lit, fields)), **{r: F.col(r).between(least, 1.0) for r in rates},
        "max_energy_difference": (F.col("max_energy_difference") >= 0) & (F.col("max_energy_difference") < float("inf")),
    }
    names = F.array(*[F.struct(F.lit(i).alias("seq"), F.when(~F.coalesce(h, F.lit(False)), n).alias("reason")) for i, (n, h) in enumerate(holds.items(), 1)])
    found = report.select(F.explode(names).alias("r")).select("r.*").where("reason IS NOT NULL").distinct()
    none = report.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(0).alias("seq"), F.lit("missing").alias("reason"))
    return found.unionByName(none)
