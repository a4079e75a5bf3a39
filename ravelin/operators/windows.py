"""Ranking and frame windows over ordered groups.

A group is what one window sees, here a user, a pair's side or a part; groups
that may hold most of a table take `ravelin.plans.staging.running_before`.
Nulls in a value sort last and never rank; ties are broken by the order columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.plans.staging import running_before


def positive_percentile(df: DataFrame, value: str, group: Sequence[str], out: str) -> DataFrame:
    """Share of the group's positive values that are at most this one; 0 for others."""
    positive = F.coalesce(F.col(value) > 0, F.lit(False))
    w = Window.partitionBy(*group, positive).orderBy(value)
    return df.withColumn(out, F.when(positive, F.cume_dist().over(w)).otherwise(F.lit(0.0)))


def positive_percentile_spread(df: DataFrame, value: str, group: Sequence[str], out: str) -> DataFrame:
    """As `positive_percentile`, for groups that may hold most of a table.

    Equal values are counted first; the counts are range-partitioned and
    prefix-summed, so that no task holds a group, and the shares are joined
    back by value. `df` is read twice and should be staged where it is dear.
    Rows with a null in a group column get 0.
    """
    sound = F.col(value) > 0
    for c in group:
        sound = sound & F.col(c).isNotNull()
    counts = df.where(sound).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    before = running_before(counts, list(group), [value], F.col("_n"), "_before", "value-ranks").withColumn("_upto", F.col("_before") + F.col("_n"))
    totals = before.groupBy(*group).agg(F.max("_upto").alias("_all"))
    shares = before.join(totals, list(group)).select(*group, value, (F.col("_upto") / F.col("_all")).alias(out))
    return df.join(shares, [*group, value], "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def top_gate(df: DataFrame, value: str, group: Sequence[str], ties: Sequence[str], n: int, out: str) -> DataFrame:
    """The group's `n` largest positive values over their maximum; 0 for others."""
    order = [F.col(value).desc_nulls_last(), *ties]
    kept = (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) <= n) & (F.col(value) > 0)
    top = F.max(value).over(Window.partitionBy(*group))
    return df.withColumn(out, F.when(F.coalesce(kept, F.lit(False)), F.col(value) / top).otherwise(F.lit(0.0)))


def average_rank(value: str, group: Sequence[str]) -> Column:
    """Rank with ties averaged, as a share of the group; smallest value first."""
    w = Window.partitionBy(*group)
    rank = F.rank().over(w.orderBy(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*group, value))
    return (rank + (ties - 1) / F.lit(2.0)) / F.count(F.lit(1)).over(w)


def rolling(value: str | Column, group: Sequence[str], order: Sequence[str], half: int, how: str) -> Column:
    """Mean, max or sum over `half` rows to each side, fewer at the ends."""
    column = F.col(value) if isinstance(value, str) else value
    return {"mean": F.avg, "max": F.max, "sum": F.sum}[how](column).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(-half, half))


def positive_quantile(value: str, group: Sequence[str], q: float) -> Column:
    """Exact quantile of the group's positive values, linear between neighbours; null if there are none."""
    return F.percentile(F.when(F.col(value) > 0, F.col(value)), F.lit(q)).over(Window.partitionBy(*group))


def run_length(df: DataFrame, flag: Column, group: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Length of the run of flagged rows that a row stands in; 0 for others."""
    w = Window.partitionBy(*group).orderBy(*order)
    marked = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    island = F.sum(F.when(F.col("_flag"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = marked.withColumn("_island", island)
    size = F.count(F.lit(1)).over(Window.partitionBy(*group, "_island", "_flag"))
    return marked.withColumn(out, F.when(F.col("_flag"), size).otherwise(F.lit(0)).cast("long")).drop("_flag", "_island")


def nearest_flag(position: str, flag: Column, group: Sequence[str]) -> Column:
    """Distance in `position` to the nearest flagged row of the group; null if there is none."""
    w = Window.partitionBy(*group).orderBy(position)
    at = F.when(flag, F.col(position))
    before = F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.least(F.col(position) - before, after - F.col(position))


def group_order(df: DataFrame, group: Sequence[str], order: Sequence[str], position: str, length: str) -> DataFrame:
    """Position from 1 in the group's order, nulls last, and the group's length."""
    w = Window.partitionBy(*group)
    keys = [F.col(c).asc_nulls_last() for c in order]
    return df.withColumn(position, F.row_number().over(w.orderBy(*keys)).cast("long")).withColumn(length, F.count(F.lit(1)).over(w))


def seed_kernel(df: DataFrame, group: Sequence[str], position: str, seeds: DataFrame, radius: int, out: str, height: str | None = None) -> DataFrame:
    """Sum of triangular kernels around the group's seeds, (r + 1 - d) / (r + 1) at distance d, times the seed's `height`.

    A seed is dealt to the 2r + 1 positions that it reaches, so the join is on
    equal keys and no row meets a seed that is out of reach.
    """
    reach = seeds.select(*group, F.explode(F.sequence(F.col(position) - radius, F.col(position) + radius)).alias("_at"), F.col(position).alias("_seed"), (F.col(height) if height else F.lit(1.0)).alias("_height"))
    weight = F.col("_height") * (F.lit(radius + 1.0) - F.abs(F.col("_at") - F.col("_seed"))) / F.lit(radius + 1.0)
    signal = reach.groupBy(*group, F.col("_at").alias(position)).agg(F.sum(weight).alias(out))
    return df.join(signal, [*group, position], "left").withColumn(out, F.coalesce(out, F.lit(0.0)))
