"""Aggregations: provenance roll-ups, best rows, vote matrices, marginals, distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_writer(df: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str], seen: str | None = None) -> DataFrame:
    """One row per key: `columns` of the row that introduced it, the first in `order`, and its number of rows as `seen`."""
    first = F.min_by(F.struct(*columns), F.struct(*order)).alias("_first")
    count = [F.count(F.lit(1)).alias(seen)] if seen else []
    return df.groupBy(*key).agg(first, *count).select(*key, *[F.col(f"_first.{c}").alias(c) for c in columns], *([seen] if seen else []))


def best_row(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in `order`, which must order a key's rows totally.

    Takes a minimum, not a window, so that it combines before the shuffle.
    """
    ranked = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return df.groupBy(*key).agg(F.min_by(F.struct(*df.columns), ranked).alias("_best")).select("_best.*")


def best_unambiguous(df: DataFrame, key: Sequence[str], priority: str, value: str, out: str) -> DataFrame:
    """The value at a key's best (smallest) priority; null if there are several."""
    by_level = df.where(F.col(value).isNotNull()).groupBy(*key, priority).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return by_level.groupBy(*key).agg(F.min_by(F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")), priority).alias(out))


def vote_share(df: DataFrame, row: str, column: str, out: str) -> DataFrame:
    """Votes of each (row, column) cell as a share of all votes."""
    cells = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("votes"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return cells.crossJoin(F.broadcast(total)).withColumn(out, F.col("votes") / F.col("_total")).drop("_total")


def column_profile(df: DataFrame, text: str) -> DataFrame:
    """(position, letters, rows, top_share): per position the non-blank letters, the rows that reach it and the commonest letter's share."""
    letters = df.where(F.length(text) > 0).select(F.posexplode(F.split(text, "")).alias("position", "letter")).where("letter <> ''")
    counts = letters.groupBy("position", "letter").agg(F.count(F.lit(1)).alias("n"))
    blank = F.col("letter").isin(" ", "-")
    sums = counts.groupBy("position").agg(F.sum(F.when(~blank, F.col("n")).otherwise(0)).alias("letters"), F.sum("n").alias("rows"), F.max(F.when(~blank, F.col("n"))).alias("_top"))
    return sums.select((F.col("position") + 1).cast("long").alias("position"), "letters", "rows", (F.col("_top") / F.col("letters")).alias("top_share"))


def top_values(value: str, k: int) -> Column:
    """The k largest positive values of a group, falling."""
    return F.slice(F.sort_array(F.collect_list(F.when(F.col(value) > 0, F.col(value))), asc=False), 1, k)


def weighted_top_k(df: DataFrame, group: Sequence[str], value: str, k: int, out: str, specificity: str) -> DataFrame:
    """Largest value plus half the next k - 1, and the largest over the sum of all k.

    Rows below the k-th are dropped by a rank first, so that no list grows with
    a group.
    """
    w = Window.partitionBy(*group).orderBy(F.col(value).desc_nulls_last())
    top = df.where(F.col(value) > 0).withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)
    largest, total = F.max(value), F.sum(value)
    return top.groupBy(*group).agg((largest + (total - largest) * F.lit(0.5)).alias(out), (largest / total).alias(specificity))


def reliability(df: DataFrame, group: Sequence[str], row: str, column: str, rows: int, columns: int, out: str) -> DataFrame:
    """Trust in a matrix with few cells in many rows: 0.75 (1 - density) + 0.25 clip((1 - breadth) / 0.5), within [0.05, 1]."""
    cells = df.groupBy(*group).agg(F.count_distinct(row, column).alias("_n"), F.count_distinct(row).alias("_r"), F.count_distinct(column).alias("_c"))
    density = F.col("_n") / F.lit(float(rows * columns))
    breadth = (F.col("_r") / F.lit(float(rows)) + F.col("_c") / F.lit(float(columns))) / F.lit(2.0)
    spread = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(1.0) - breadth) / F.lit(0.5)))
    trust = F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.lit(0.75) * (F.lit(1.0) - density) + F.lit(0.25) * spread))
    return cells.select(*group, density.alias("density"), breadth.alias("breadth"), F.when(F.col("_n") == 0, F.lit(0.0)).otherwise(trust).alias(out))


def require_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key with its count; a key that occurs twice stops the job."""
    name = F.concat_ws(",", *[F.col(c).cast("string") for c in key])
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("duplicate key "), name)).cast("long")).otherwise(F.col("n")))


def size_distribution(df: DataFrame, size: str, bins: Sequence[tuple[int, int]]) -> DataFrame:
    """Count, mean, exact quartiles, extremes and a histogram of `size`, in one row."""
    quantiles = [F.percentile(size, F.lit(q)).alias(n) for q, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))]
    counts = [F.count_if(F.col(size).between(lo, hi)).alias(f"bin_{lo}_{hi}") for lo, hi in bins]
    return df.agg(F.count(size).alias("n"), F.avg(size).alias("mean"), *quantiles, F.min(size).alias("min"), F.max(size).alias("max"), *counts, F.count_if(F.col(size) > bins[-1][1]).alias("bin_more"))


def best_by_metric(df: DataFrame, group: Sequence[str], metric: str, name: str) -> DataFrame:
    """Name and value of the row with the largest metric per group, ties by name; null metrics never win."""
    known = df.where(F.col(metric).isNotNull())
    return best_row(known.select(*group, name, metric), group, [-F.col(metric), F.col(name)])


def roll_up(df: DataFrame, key: Sequence[str], largest: Sequence[str], summed: Sequence[str], lists: Sequence[str]) -> DataFrame:
    """One row per key: maxima of flags and scores, sums of counts, sorted unions of lists parted by `;` or `,`.

    Text that is no number counts as 0, blank list entries are left out, and a
    key without entries has an empty list.
    """
    whole = lambda c: F.coalesce(F.col(c).cast("string").try_cast("long"), F.lit(0))
    entries = lambda c: F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda x: x != "")
    # Entries are made distinct per row and per partition before sets meet.
    unions = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_sort(F.array_distinct(entries(c))))))).alias(c) for c in lists]
    return df.groupBy(*key).agg(*[F.max(whole(c)).alias(c) for c in largest], *[F.sum(whole(c)).alias(c) for c in summed], *unions)


def conservation_profile(rows: DataFrame, group: Sequence[str], query: str, row: str) -> DataFrame:
    """(group, position, conservation, coverage, profile) of aligned rows against their query.

    Per position: rows with the query's letter over rows with a letter, rows
    with a letter over all rows, and the product; 0 where no row has a letter.
    """
    letters = rows.select(*group, F.posexplode(F.arrays_zip(F.split(query, "").alias("q"), F.split(row, "").alias("r"))).alias("i", "z")).where("z.q <> ''")
    filled = ~F.coalesce(F.col("z.r"), F.lit("-")).isin("-", ".", "")
    counts = letters.groupBy(*group, "i").agg(F.count(F.lit(1)).alias("_n"), F.count_if(filled).alias("_f"), F.count_if(filled & (F.col("z.r") == F.col("z.q"))).alias("_m"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    out = counts.select(*group, (F.col("i") + 1).cast("long").alias("position"), share("_m", "_f").alias("conservation"), share("_f", "_n").alias("coverage"))
    return out.withColumn("profile", F.col("conservation") * F.col("coverage"))
