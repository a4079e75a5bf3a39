"""Top-k and greedy selections.

Top-k is a window. A greedy choice depends on every choice before it, so it
runs on one group at a time with `applyInPandas`; groups are a side of a pair,
a few thousand rows at most, and a job has very many of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first `n` rows of each group, with their `rank`."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def best_per_pair(df: DataFrame, a: str, b: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each unordered pair (a, b)."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    rank = F.row_number().over(Window.partitionBy(lo, hi).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def _greedy(order: np.ndarray, apart, n: int) -> list[int]:
    """Positions taken in `order`, each `apart` from all before it."""
    taken: list[int] = []
    for i in order.tolist():
        if len(taken) == n:
            break
        if all(apart(i, j) for j in taken):
            taken.append(i)
    return taken


def greedy_line(df: DataFrame, group: Sequence[str], position: str, score: str, n: int, gap: int, ties: Sequence[str] = ()) -> DataFrame:
    """Up to `n` positive scores per group, best first, more than `gap` positions apart.

    Ties go to the larger tie-break columns, then to the smaller position.
    """
    columns = [*group, position, score]

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf[score] > 0].reset_index(drop=True)
        keys = [pdf[position].to_numpy(), *[-pdf[t].to_numpy() for t in reversed(ties)], -pdf[score].to_numpy()]
        at = pdf[position].to_numpy()
        taken = _greedy(np.lexsort(keys), lambda i, j: abs(at[i] - at[j]) > gap, n)
        return pdf.iloc[taken][columns].assign(seed=np.arange(1, len(taken) + 1))

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", seed long"
    return df.select(*columns, *ties).groupBy(*group).applyInPandas(choose, schema)


def greedy_space(df: DataFrame, group: Sequence[str], key: str, axes: Sequence[str], score: str, n: int, distance: float) -> DataFrame:
    """As `greedy_line`, at least `distance` apart in space; ties go to the smaller key."""
    columns = [*group, key, score]

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf[score] > 0].reset_index(drop=True)
        xyz = pdf[list(axes)].to_numpy(float)
        taken = _greedy(np.lexsort([pdf[key].to_numpy(), -pdf[score].to_numpy()]), lambda i, j: np.linalg.norm(xyz[i] - xyz[j]) >= distance, n)
        return pdf.iloc[taken][columns].assign(seed=np.arange(1, len(taken) + 1))

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", seed long"
    return df.select(*columns, *axes).groupBy(*group).applyInPandas(choose, schema)


def adaptive(df: DataFrame, group: Sequence[str], key: str, score: str, active: float = 0.75, passive: float = 0.35, most_active: int = 10, most_passive: int = 10, least_peak: float = 0.0) -> DataFrame:
    """Active rows within `active` of the group's peak, passive ones within `passive`.

    Both are capped, not filled up: a group may select nothing, and does if its
    peak is below `least_peak`. A window form, since no choice depends on
    another.
    """
    w = Window.partitionBy(*group)
    peak = F.max(score).over(w)
    order = F.row_number().over(w.orderBy(F.col(score).desc_nulls_last(), key))
    marked = df.withColumn("_peak", peak).withColumn("_rank", order).where((F.col(score) > 0) & (F.col("_peak") >= least_peak))
    is_active = (F.col(score) >= F.col("_peak") * active) & (F.col("_rank") <= most_active)
    marked = marked.withColumn("_active", is_active)
    n_active = F.count_if("_active").over(w)
    is_passive = ~F.col("_active") & (F.col(score) >= F.col("_peak") * passive) & (F.col("_rank") - n_active <= most_passive)
    return marked.withColumn("role", F.when(F.col("_active"), "active").when(is_passive, "passive")).where(F.col("role").isNotNull()).drop("_peak", "_rank", "_active")


def support_cluster(df: DataFrame, group: Sequence[str], key: str, axes: Sequence[str], score: str, support: str, seeds: int, seed_distance: float, radius: float, k: int = 3) -> DataFrame:
    """The members of each group's best cluster around a greedy seed.

    A cluster's worth is its members' support plus 0.75 times its k best
    scores; the first of equal ones wins.
    """
    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        xyz, s = pdf[list(axes)].to_numpy(float), pdf[score].to_numpy(float)
        order = np.lexsort([pdf[key].to_numpy(), -s])
        order = order[s[order] > 0]
        best, members = -np.inf, np.empty(0, int)
        for i in _greedy(order, lambda a, b: np.linalg.norm(xyz[a] - xyz[b]) >= seed_distance, seeds):
            near = np.flatnonzero(np.linalg.norm(xyz - xyz[i], axis=1) <= radius)
            worth = pdf[support].to_numpy(float)[near].sum() + 0.75 * np.sort(s[near])[::-1][:k].sum()
            if worth > best:
                best, members = worth, near
        return pdf.iloc[members][[*group, key]].assign(worth=float(best))

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*group, key]) + ", worth double"
    return df.select(*group, key, *axes, score, support).groupBy(*group).applyInPandas(choose, schema)


def diverse(df: DataFrame, group: Sequence[str], key: str, size: str, novelty: Sequence[str], required: str, n: int, centre: float) -> DataFrame:
    """Greedy diverse sample: each pick takes the row of largest worth.

    A value of `required` that is new is worth 100, each novelty value that is
    new 10, each one that repeats costs 3 per repeat; ties go to the size
    nearest `centre`, then to the smaller key.
    """
    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        left, picked, seen = pdf.sort_values(key).to_dict("records"), [], {}
        while left and len(picked) < n:
            def worth(r: dict) -> tuple:
                gain = 0 if (required, r[required]) in seen else 100
                for c in novelty:
                    gain += -3 * seen[c, r[c]] if (c, r[c]) in seen else 10
                return gain, -abs(r[size] - centre)

            best = max(left, key=worth)
            left.remove(best)
            picked.append(best)
            for c in {*novelty, required}:
                seen[c, best[c]] = seen.get((c, best[c]), 0) + 1
        out = pd.DataFrame(picked, columns=list(pdf.columns))
        return out[[*group, key]].assign(pick=np.arange(1, len(out) + 1))

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*group, key]) + ", pick long"
    columns = list(dict.fromkeys([*group, key, size, *novelty, required]))
    return df.select(*columns).groupBy(*group).applyInPandas(choose, schema)
