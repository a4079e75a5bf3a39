"""Composite scores: products, smoothing, patches and components, reranking."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions import residues
from ravelin.operators import aggregates, clusters, spatial, windows
from ravelin.plans.staging import running_before, stage


def outer_product(left: DataFrame, right: DataFrame, pair: Sequence[str], i: str, j: str, score: str) -> DataFrame:
    """(pair, i, j, priority): product of both sides' positive scores, kept sparse."""
    a = left.where(F.col(score) > 0).select(*pair, F.col(i).alias("i"), F.col(score).alias("_a"))
    b = right.where(F.col(score) > 0).select(*pair, F.col(j).alias("j"), F.col(score).alias("_b"))
    return a.join(b, list(pair)).select(*pair, "i", "j", (F.col("_a") * F.col("_b")).alias("priority"))


def gaussian(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised weights from -r to r, r = round(truncate * sigma)."""
    r = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1)]
    return [w / sum(raw) for w in raw]


def smooth(cells: DataFrame, group: Sequence[str], i: str, j: str, value: str, sigma: tuple[float, float], size: tuple[int, int], out: str) -> DataFrame:
    """Separable Gaussian smoothing of a sparse matrix with zero borders.

    Every cell is dealt to the cells that its kernel reaches, one axis after
    the other; indexes run from 0 to size - 1. Only cells in reach of a value
    come out.
    """
    def along(df: DataFrame, axis: str, other: str, s: float, n: int, column: str, to: str) -> DataFrame:
        weights = gaussian(s)
        r = len(weights) // 2
        kernel = F.array(*[F.struct(F.lit(d - r).alias("d"), F.lit(w).alias("w")) for d, w in enumerate(weights)])
        spread = df.select(*group, F.col(other), F.col(axis), F.col(column), F.explode(kernel).alias("_k"))
        moved = spread.withColumn(axis, F.col(axis) + F.col("_k.d")).where(F.col(axis).between(0, n - 1))
        return moved.groupBy(*group, axis, other).agg(F.sum(F.col(column) * F.col("_k.w")).alias(to))

    once = along(cells.where(F.col(value) != 0), i, j, sigma[0], size[0], value, "_once")
    return along(once, j, i, sigma[1], size[1], "_once", out)


def patch(conservation: Column, fragments: Column, reliability: Column) -> Column:
    """Conservation, fragments as far as they are trusted, and half of what both agree on."""
    trusted = reliability * fragments
    return conservation + trusted + F.lit(0.5) * F.least(conservation, trusted)


def guided(component: Column, patch_score: Column, floor: float = 0.25) -> Column:
    """A component weighed by the patch, never below `floor` of itself."""
    return component * (F.lit(floor) + F.lit(1.0 - floor) * patch_score)


def direct_support(base: Column, components: dict[str, float]) -> Column:
    """The base's positive part plus the weighted positive parts of `components`."""
    out = F.greatest(base, F.lit(0.0))
    for name, weight in components.items():
        out = out + F.lit(weight) * F.greatest(F.col(name), F.lit(0.0))
    return out


def weighted_mean(components: dict[str, float]) -> Column:
    """Mean over components of positive weight; 0 if there is none."""
    used = {c: w for c, w in components.items() if w > 0}
    if not used:
        return F.lit(0.0)
    return sum((F.col(c) * w for c, w in used.items()), F.lit(0.0)) / F.lit(sum(used.values()))


def support_score(df: DataFrame, flags: dict[str, float], counts: dict[str, tuple[float, int]], confidence: str, label: dict[str, str], out: str) -> DataFrame:
    """Weighted evidence of a pair: flags, capped counts, a confidence capped at 1000; and its sources' names."""
    total = F.least(F.coalesce(F.col(confidence), F.lit(0)), F.lit(1000)) / F.lit(1000.0)
    for name, weight in flags.items():
        total = total + F.when(F.col(name) > 0, F.lit(weight)).otherwise(F.lit(0.0))
    for name, (weight, cap) in counts.items():
        total = total + F.lit(weight) * F.least(F.coalesce(F.col(name), F.lit(0)), F.lit(cap))
    names = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(n)) for c, n in label.items()]))
    text = F.when(F.size(names) == 0, "unknown").when(F.size(names) == 1, F.concat(names[0], F.lit("_only"))).otherwise(F.array_join(names, "_plus_"))
    return df.withColumn(out, total).withColumn("source_label", text)


def residue_first(cells: DataFrame, pair: Sequence[str], side: str, position: str, value: str, k: int = 3, seeds: int = 3, gap: int = 3, radius: int = 4) -> DataFrame:
    """Matrix cells to ranked positions: percentiles, top-k marginals, percentiles again, spread seeds, guided scores.

    `cells` has a row per (pair, side, position, partner); the result has one
    per (pair, side, position) with `marginal`, `base`, `region`, `final` and
    `rank`. Pairs and sides may be of any size: percentiles and ranks go by range,
    seeds are chosen in rounds over all groups. Rows with a null pair, side or
    position are left out; an empty table gives no rows.
    """
    cells = cells.dropna(subset=[*pair, side, position])
    keys, sides = [*pair, side, position], [*pair, side]
    ranked = windows.positive_percentile_spread(cells.select(*keys, value), value, pair, "_pct")
    rows = stage(aggregates.weighted_top_k(ranked, keys, "_pct", k, "marginal", "specificity"), "marginals")
    rows = stage(windows.positive_percentile_spread(rows, "marginal", sides, "base"), "bases")
    order = [-F.col("base"), F.col(position)]
    chosen = clusters.rounds(rows.where("base > 0"), sides, order, [position], lambda s: F.abs(F.col(position) - s[position]) <= gap, seeds)
    rows = windows.seed_kernel(rows, sides, position, chosen, radius, "region")
    rows = stage(rows.withColumn("_raw", guided(F.col("base"), F.least(F.col("region"), F.lit(1.0)))), "guided")
    rows = windows.positive_percentile_spread(rows, "_raw", sides, "final").withColumn("_down", -F.col("final"))
    rows = running_before(rows, sides, ["_down", position], F.lit(1), "rank", "residue-ranks")
    return rows.withColumn("rank", (F.col("rank") + 1).cast("long")).drop("_raw", "_down")


def confidence(b_factors: DataFrame, group: Sequence[str], value: str, out: str, forced: bool = False) -> DataFrame:
    """Adds `out`: clip((value - 50) / 40) where a structure's temperature factors look like model confidences, else 1.

    They do if all lie from 0 to 100, the median is at least 70, the upper
    quartile 82.5 and the lower 55. A structure with a missing value has 1
    throughout; `forced` skips the test of quantiles.
    """
    whole = b_factors.groupBy(*group).agg(F.count_if(F.col(value).isNull() | F.isnan(value)).alias("_bad"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    seen = F.lit(True) if forced else (F.col("_lo") >= 0) & (F.col("_hi") <= 100) & (F.col("_q")[1] >= 70) & (F.col("_q")[2] >= 82.5) & (F.col("_q")[0] >= 55)
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - F.lit(50.0)) / F.lit(40.0)))
    used = whole.select(*group, ((F.col("_bad") == 0) & seen).alias("_used"))
    return b_factors.join(used, list(group)).withColumn(out, F.when(F.col("_used"), scaled).otherwise(F.lit(1.0))).drop("_used")


def structure_features(points: DataFrame, group: Sequence[str], key: str, axes: Sequence[str], base: Column, letter: Column, eligible: Column, radius: float = 10.0, hydrophobic_radius: float = 8.0, decimals: int = 9) -> DataFrame:
    """`points` with `mass`, `density` and `hydrophobic` of their neighbourhoods, each as a percentile of its positive values.

    Over eligible points of one group: the sum of positive base scores within
    `radius`, itself included; the number of others within it; and the mean
    positive hydropathy within `hydrophobic_radius`. Points that are not
    eligible have zeros. Sums are rounded before they are ranked, so that the
    order of addition does not break ties.
    """
    rows = points.withColumn("_base", F.greatest(F.coalesce(base, F.lit(0.0)), F.lit(0.0))).withColumn("_h", F.greatest(residues.hydropathy(letter), F.lit(0.0))).withColumn("_ok", F.coalesce(eligible, F.lit(False)))
    able = rows.where("_ok").select(*group, key, *axes, "_base", "_h")
    far = max(radius, hydrophobic_radius)
    pairs = spatial.radius_pairs(able, key, axes, far, group)
    both = pairs.select("a", "b", "d2").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "d2")).unionByName(able.select(F.col(key).alias("a"), F.col(key).alias("b"), F.lit(0.0).alias("d2")))
    near, wet = F.col("d2") <= radius * radius, F.col("d2") <= hydrophobic_radius * hydrophobic_radius
    sums = both.join(able.select(F.col(key).alias("b"), "_base", "_h"), "b").groupBy("a").agg(
        F.round(F.sum(F.when(near, F.col("_base")).otherwise(0.0)), decimals).alias("_m"), (F.count_if(near) - 1).cast("double").alias("_d"), F.round(F.avg(F.when(wet, F.col("_h"))), decimals).alias("_w")
    )
    out = rows.join(sums.withColumnRenamed("a", key), key, "left").fillna(0.0, ["_m", "_d", "_w"])
    for raw, name in (("_m", "mass"), ("_d", "density"), ("_w", "hydrophobic")):
        out = windows.positive_percentile(out, raw, list(group), name)
    return out.drop("_m", "_d", "_w", "_h", "_ok", "_base")


def homomer_cells(cells: DataFrame, pair: Sequence[str], i: str, j: str, value: str) -> DataFrame:
    """Cells of a matrix of two equal chains: the greater of each cell and its mirror image."""
    both = cells.unionByName(cells.select(*pair, F.col(j).alias(i), F.col(i).alias(j), value))
    return both.groupBy(*pair, i, j).agg(F.max(value).alias(value))


def rerank(df: DataFrame, base: Column, confidence: Column, mass: Column, density: Column, hydrophobic: Column, weight: float, surface: Column) -> DataFrame:
    """Adds `reranked`: the base trusted by confidence, plus neighbourhood mass, density and hydrophobicity, on the surface only."""
    score = base * (F.lit(0.6) + F.lit(0.4) * confidence) + F.lit(0.35) * mass + F.lit(0.15) * density + F.lit(weight) * hydrophobic
    return df.withColumn("reranked", F.when(surface, score).otherwise(F.lit(0.0)))


def symmetrise(df: DataFrame, pair: Sequence[str], side: str, position: str, value: str) -> DataFrame:
    """Both sides of a pair of equal chains get the mean of their values by position."""
    mean = df.groupBy(*pair, position).agg(F.avg(F.coalesce(F.col(value), F.lit(0.0))).alias("_mean"))
    return df.join(mean, [*pair, position]).withColumn(value, F.col("_mean")).drop("_mean")


def surface_masked(rows: DataFrame, areas: DataFrame, group: Sequence[str], position: str, relative: str, signals: Sequence[str], least: float) -> DataFrame:
    """`rows` with every signal zero at positions whose relative area is below `least`, and `exposed`.

    A position without an area counts as buried. A group without any area
    cannot be masked: its signals stay and `exposed` is null. Of areas that
    repeat a position the largest counts.
    """
    known = areas.where(F.col(relative).isNotNull()).groupBy(*group, position).agg(F.max(relative).alias("_area"))
    some = known.select(*group).distinct().withColumn("_known", F.lit(True))
    joined = rows.join(known, [*group, position], "left").join(some, list(group), "left")
    exposed = F.when(F.col("_known"), F.coalesce(F.col("_area") >= least, F.lit(False)))
    kept = [F.when(F.coalesce(F.col("exposed"), F.lit(True)), F.col(s)).otherwise(F.lit(0)).alias(s) if s in signals else F.col(s) for s in rows.columns]
    return joined.withColumn("exposed", exposed).select(*kept, "exposed")
