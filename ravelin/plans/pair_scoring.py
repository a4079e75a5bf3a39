"""The flagship plan: matrices of several branches to ranked positions of both sides of all pairs.

Input cells are sparse and long, (pair, branch, i, j, score), with branches
`fragments`, `conservation` and any number of anchors; `sizes` has (pair, l1,
l2). Everything is keyed by pair, so one job scores all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.operators import aggregates, scoring, selection, windows

SIDE = ["pair", "side"]


def sides(cells: DataFrame) -> DataFrame:
    """(pair, side, idx, branch, score): every cell once for its row and once for its column."""
    ends = F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("i").alias("idx")), F.struct(F.lit(2).alias("side"), F.col("j").alias("idx")))).alias("e")
    return cells.select("pair", "branch", "score", ends).select("pair", "e.side", "e.idx", "branch", "score")


def normalise(cells: DataFrame, anchors: list[str], top: int = 40) -> DataFrame:
    """Percentiles of the broad branches, and the anchors' best `top` cells over their maximum, per pair."""
    broad = windows.positive_percentile(cells.where(~F.col("branch").isin(*anchors)), "score", ["pair", "branch"], "_s")
    sharp = windows.top_gate(cells.where(F.col("branch").isin(*anchors)), "score", ["pair", "branch"], ["i", "j"], top, "_s")
    return broad.unionByName(sharp).select("pair", "branch", "i", "j", F.col("_s").alias("score")).where("score > 0")


def reliability(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """(pair, reliability) of the fragments: less for dense and broad matrices, 0 for none."""
    own = cells.where("branch = 'fragments' AND score > 0").groupBy("pair").agg(F.count_distinct("i", "j").alias("n"), F.count_distinct("i").alias("r"), F.count_distinct("j").alias("c"))
    density = F.col("n") / (F.col("l1") * F.col("l2"))
    breadth = (F.col("r") / F.col("l1") + F.col("c") / F.col("l2")) / 2
    spread = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - breadth) / 0.5))
    trust = F.greatest(F.lit(0.05), F.least(F.lit(1.0), F.lit(0.75) * (1 - density) + F.lit(0.25) * spread))
    return sizes.join(own, "pair", "left").select("pair", F.coalesce(trust, F.lit(0.0)).alias("reliability"))


def _percentile(df: DataFrame, value: Column, out: str) -> DataFrame:
    return windows.positive_percentile(df.withColumn("_v", value), "_v", SIDE, out).drop("_v")


def score_pairs(cells: DataFrame, sizes: DataFrame, anchors: dict[str, float], top_k: int = 3, seeds: int = 4, radius: int = 4, full: int = 40) -> DataFrame:
    """One row per position of both sides, with every component, `final` and `rank`.

    `cells` are normalised. `anchors` maps a branch to its largest weight, which
    it reaches with `full` cells. Positions without evidence have zeros; a pair
    without any has zeros throughout and ranks by position.
    """
    lengths = F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("l1").alias("l")), F.struct(F.lit(2).alias("side"), F.col("l2").alias("l")))).alias("e")
    every = sizes.where("l1 > 0 AND l2 > 0").select("pair", lengths).select("pair", "e.side", F.explode(F.sequence(F.lit(1).cast("long"), F.col("e.l").cast("long"))).alias("idx"))
    flat = sides(cells)
    rows = every
    for branch in ("fragments", *anchors):
        strength = aggregates.weighted_top_k(flat.where(F.col("branch") == branch), [*SIDE, "idx"], "score", top_k, f"{branch}_strength", "_s").drop("_s")
        rows = rows.join(strength, [*SIDE, "idx"], "left")
    best = flat.where("branch = 'conservation'").groupBy(*SIDE, "idx").agg(F.max("score").alias("conservation_strength"))
    rows = rows.join(best, [*SIDE, "idx"], "left").fillna(0.0, [f"{b}_strength" for b in ("fragments", "conservation", *anchors)])
    for branch in ("fragments", "conservation", *anchors):
        rows = _percentile(rows, F.col(f"{branch}_strength"), f"{branch}_component")
    for branch in ("fragments", "conservation"):
        component, region = f"{branch}_component", f"{branch}_region"
        chosen = selection.greedy_line(rows, SIDE, "idx", component, seeds, radius)
        rows = windows.seed_kernel(rows, SIDE, "idx", chosen, radius, region, component)
    rows = rows.join(reliability(cells, sizes), "pair", "left")
    rows = _percentile(rows, scoring.patch(F.col("conservation_region"), F.col("fragments_region"), F.col("reliability")), "patch")
    total = F.col("patch")
    kept = cells.where("score > 0").groupBy("pair").agg(*[F.count_if(F.col("branch") == a).alias(f"_n_{a}") for a in anchors]) if anchors else None
    if anchors:
        rows = rows.join(kept, "pair", "left")
    for anchor, most in anchors.items():
        rows = _percentile(rows, scoring.guided(F.col(f"{anchor}_component"), F.col("patch")), f"{anchor}_bonus")
        weight = F.lit(most) * F.least(F.lit(1.0), F.coalesce(F.col(f"_n_{anchor}"), F.lit(0)) / F.lit(float(full)))
        total = total + weight * F.col(f"{anchor}_bonus")
    rows = _percentile(rows, total, "final").drop(*[f"_n_{a}" for a in anchors])
    rank = F.row_number().over(Window.partitionBy(*SIDE).orderBy(F.col("final").desc(), "idx")).cast("long")
    return rows.withColumn("rank", rank)


def priorities(scored: DataFrame) -> DataFrame:
    """(pair, i, j, priority): outer product of both sides' final scores; a ranking, not a prediction of contacts."""
    return scoring.outer_product(scored.where("side = 1"), scored.where("side = 2"), ["pair"], "idx", "idx", "final")
