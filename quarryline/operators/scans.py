"""Folds over ordered rows of a group, cut where the rows are and not where groups end.

Rows are range-sorted by group and order, so one large group spreads over many
parts. Each part folds its own rows and is reduced to one summary of a group
that goes on in the next part; summaries are composed in the order of parts,
and what comes out goes back to the rows. All folds here are associative: sums,
maxima and the last value; streaks, runs and first violations are made of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed


class Scan:
    """The rows of ``df`` by ``group``, in ``order``, which must be total for a defined result."""

    def __init__(self, df: DataFrame, group: list[str], *order):
        self.group, self.columns = group, df.columns
        self.rows = checkpointed(df.orderBy(*group, *order)).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())

    def fold(self, **folds: tuple) -> Scan:
        """Adds columns ``name=(how, value)``: the ``sum`` or ``max`` of ``value`` over the rows of the group so far, or its ``last`` value before the row.

        ``(how, value, False)`` leaves the row itself out. A sum of nothing is
        0, a maximum or last value of nothing is null. Folds of one call go
        through the rows together; the summaries that groups take over are
        written at once, so that later folds don't repeat the plan of earlier
        ones.
        """
        rows = self.rows.withColumns({f"_value_{n}": f[1] for n, f in folds.items()})
        within = Window.partitionBy("_part", *self.group).orderBy("_at")
        earlier = Window.partitionBy(*self.group).orderBy("_part")
        here, summaries, carried, out = {}, [], [], {}
        for n, (how, _, *own) in folds.items():
            value, total, now, carry = f"_value_{n}", f"_sum_{n}", F.col(f"_here_{n}"), F.col(f"_carry_{n}")
            if how == "last":
                here[f"_here_{n}"] = F.lag(value).over(within)
                summaries.append(F.max_by(F.struct(value), "_at")[value].alias(total))
                carried.append(F.lag(total).over(earlier).alias(f"_carry_{n}"))
                out[n] = F.when(F.col("_first"), carry).otherwise(now)
            else:
                f = {"sum": F.sum, "max": F.max}[how]
                here[f"_here_{n}"] = f(value).over(within.rowsBetween(Window.unboundedPreceding, -1 if own == [False] else 0))
                summaries.append(f(value).alias(total))
                carried.append(f(total).over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_carry_{n}"))
                out[n] = F.coalesce(now, F.lit(0)) + F.coalesce(carry, F.lit(0)) if how == "sum" else F.greatest(now, carry)
        # a group that a part takes over from an earlier one is the first of that part: a row a part at most
        parts = rows.groupBy("_part", *self.group).agg(*summaries)
        over = parts.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(self.group)], *carried, F.lag(F.lit(1)).over(earlier).alias("_on"))
        over = checkpointed(over.where("_on = 1").drop("_on"))
        same = F.col("_part") == F.col("_p")
        for i, c in enumerate(self.group):
            same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
        kept = [*self.rows.columns]
        joined = rows.withColumns(here).withColumn("_first", F.row_number().over(within) == 1).join(F.broadcast(over), same, "left")
        self.rows = joined.select(*kept, *[c.alias(n) for n, c in out.items()])
        return self

    def runs(self, name: str, label: str) -> Scan:
        """Adds ``name``, the number of the run of equal ``label`` from 1, and ``_place``, the row's place in it from 1."""
        self.fold(_n=("sum", F.lit(1)), _before=("last", F.col(label)))
        new = (F.col("_n") == 1) | ~F.col(label).eqNullSafe(F.col("_before"))
        self.fold(**{name: ("sum", new.cast("int")), "_begin": ("max", F.when(new, F.col("_n")))})
        self.rows = self.rows.withColumn("_place", F.col("_n") - F.col("_begin") + 1)
        return self

    def result(self, *names: str) -> DataFrame:
        """The rows with their own columns and ``names``."""
        return self.rows.select(*self.columns, *names)
