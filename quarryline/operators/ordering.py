"""Running sums over a global order, without one task for all rows or for a large group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed


def marked_rows(df: DataFrame, name: str = "_row") -> DataFrame:
    """``df`` with a number for each row that stays the same wherever it is read.

    Numbers made on the fly change when a plan is run twice over a shuffle, as
    in a join of a frame with itself; these are written once.
    """
    return checkpointed(df.withColumn(name, F.monotonically_increasing_id()))


def running_sums(df: DataFrame, group: list[str], amounts: dict[str, str], *order) -> DataFrame:
    """``df`` with the sums of earlier rows of the same group, as ``amounts`` names them: {new column: amount}.

    Rows are range-sorted by group and order, so a group of any size spreads
    over many parts; only a row per part and group is summed up across parts.
    ``order`` must be total for a defined result.
    """
    rows = checkpointed(df.orderBy(*group, *order)).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    parts = rows.groupBy("_part", *group).agg(*[F.sum(a).alias(f"_sum_{name}") for name, a in amounts.items()])
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    starts = parts.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], *[before(f"_sum_{n}", earlier).alias(f"_start_{n}") for n in amounts])
    within = Window.partitionBy("_part", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumns({f"_own_{n}": before(a, within) for n, a in amounts.items()})
    same = own["_part"] == starts["_p"]
    for i, g in enumerate(group):
        same = same & own[g].eqNullSafe(starts[f"_g{i}"])
    joined = own.join(starts, same).withColumns({n: F.col(f"_own_{n}") + F.col(f"_start_{n}") for n in amounts})
    return joined.select(*df.columns, *amounts)
