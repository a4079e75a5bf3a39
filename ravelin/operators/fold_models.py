"""Out-of-fold logistic models of many feature sets: all folds and sets are fitted together.

A Newton step of every model needs one sum over the rows, its loss, gradient
and Hessian. All models' sums come from one scan of a staged table, so the
number of scans is that of steps, about ten, whatever the number of folds and
sets. Only these sums, whose size goes by features and models, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.operators import ml
from ravelin.plans.staging import attach, stage

#: Values of one category that may become columns.
MOST_NAMES = 1000
#: Partial sums are added in this many groups a model before they meet.
STRIPES = 16
_OWN = ("_oof_x", "_oof_y", "_oof_w", "_oof_train", "fold")


@dataclass(frozen=True)
class OutOfFold:
    """`predictions`: the rows with `fold`, and for each set `set` and `probability`; `coefficients`: (set, fold,
    feature, coefficient) of scaled features and the intercept; `folds`: what each fold was trained and tested on."""

    predictions: DataFrame
    coefficients: DataFrame
    folds: DataFrame


def out_of_fold_sets(
    df: DataFrame,
    group: str,
    label: str,
    sets: Mapping[str, Sequence[str]],
    k: int,
    primary: Column | None = None,
    weight: str | None = None,
    balance: str | None = None,
    categories: Sequence[str] = (),
    c: float = 1.0,
    fill: str = "median",
    penalised_intercept: bool = False,
    accuracy: int = 10_000,
    max_steps: int = 60,
) -> OutOfFold:
    """Predict every row, once per set of columns, by the model that did not see the row's group.

    Groups are dealt to folds by size; there are at most as many folds as groups
    with `primary` rows, and fewer than two are an error. Models are fitted on
    primary rows only, and predict all rows. A fold whose training rows have one
    class gives no model: its rows have null probabilities, and the summary says
    so. Rows whose label or group is null are in no fold and have nulls too.

    The objective is C times the weighted loss plus half the squared norm, with
    a free intercept unless `penalised_intercept`. Weights are those of the
    column `weight`, or 1 over the size of the row's `balance` group among the
    training rows, null being a group, scaled so that both classes weigh the same and the mean is 1.

    Nulls and NaN of numeric columns are filled by zero or by the training rows' median,
    which comes from a sketch of bounded size, exact up to about `accuracy` rows and
    within 1/`accuracy` of the rank beyond. Then columns are scaled to zero mean and unit
    variance. `categories` are columns of names, null as `missing`; each of
    their values, MOST_NAMES at most, is a column of its own, not scaled.
    A set of no columns has an intercept alone. Columns of `df` named like those
    that this adds are replaced.
    """
    if fill not in ("median", "zero"):
        raise ValueError(f"fill is median or zero, not {fill}")
    asked = list(dict.fromkeys(x for columns in sets.values() for x in columns))
    if absent := [x for x in asked if x not in df.columns]:
        raise ValueError(f"sets name columns that are not there: {', '.join(absent)}")
    if weight and balance:
        raise ValueError("weights are given or balanced, not both")
    numbers = [x for x in asked if x not in categories]
    # Read several times below: what makes it is done once.
    df = stage(df.drop(*[x for x in (*_OWN, "set", "probability") if x in df.columns]), "fold-input")
    valid = F.col(label).isNotNull() & F.col(group).isNotNull()
    train = F.coalesce(valid & (F.lit(True) if primary is None else primary), F.lit(False))

    k = min(k, df.where(train).agg(F.count_distinct(group)).first()[0])
    if k < 2:
        raise ValueError("fewer than two folds: too few groups with primary rows")
    names = _names(df.where(train), [x for x in asked if x in categories])
    number = lambda x: F.coalesce(F.col(x).cast("double"), F.lit(float("nan")))
    told = [(F.coalesce(F.col(x).cast("string"), F.lit("missing")) == v).cast("double") for x, values in names.items() for v in values]
    places = {x: [i] for i, x in enumerate(numbers)}
    features, at = list(numbers), len(numbers)
    for x, values in names.items():
        places[x] = list(range(at, at + len(values)))
        features += [f"{x}={v}" for v in values]
        at += len(values)
    columns = {s: [p for x in dict.fromkeys(xs) for p in places[x]] for s, xs in sets.items()}

    folds = stage(ml.group_folds(df.where(valid), group, k), "folds")
    rows = attach(df, folds, [group], "left").withColumns({"fold": F.when(valid, F.col("fold")), "_oof_train": train, "_oof_y": F.col(label).cast("double")})
    x = F.array(*[number(n) for n in numbers], *told) if features else F.array().cast("array<double>")
    rows = rows.withColumn("_oof_x", x)
    scales = None
    if balance:
        rows, scales = _balanced(rows, balance, k)
    else:
        rows = rows.withColumn("_oof_w", F.array(F.col(weight).cast("double") if weight else F.lit(1.0)))
    rows = stage(rows, "fold-rows")

    fitted = rows.where("_oof_train")
    summary = _summary(rows, group, k)
    whole = [f for f in range(k) if summary[f]["positive"] and summary[f]["negative"]]
    shape = _shape(fitted, len(numbers), len(features), k, fill, accuracy)
    models = {(f, s): np.zeros(len(columns[s]) + 1) for f in whole for s in columns}
    _newton(fitted, models, columns, shape, scales, c, penalised_intercept, max_steps)

    spark = df.sparkSession
    found = [(s, f, name, float(b)) for (f, s), beta in models.items() for name, b in zip([*(features[i] for i in columns[s]), "intercept"], beta, strict=True)]
    coefficients = spark.createDataFrame(found, "set string, fold long, feature string, coefficient double")
    told_folds = spark.createDataFrame([(f, *(summary[f][n] for n in ("train_rows", "train_groups", "test_rows", "test_groups", "positive", "negative")), f in whole) for f in range(k)], "fold long, train_rows long, train_groups long, test_rows long, test_groups long, positive long, negative long, fitted boolean")
    return OutOfFold(_predict(rows, df.columns, models, columns, shape), coefficients, told_folds)


def _names(df: DataFrame, categories: Sequence[str]) -> dict[str, list[str]]:
    out = {}
    for x in categories:
        found = df.select(F.coalesce(F.col(x).cast("string"), F.lit("missing")).alias("v")).distinct().limit(MOST_NAMES + 1).collect()
        if len(found) > MOST_NAMES:
            raise ValueError(f"{x} has more than {MOST_NAMES} values: not a category")
        out[x] = sorted(r["v"] for r in found)
    return out


def _balanced(rows: DataFrame, balance: str, k: int) -> tuple[DataFrame, np.ndarray]:
    """Rows with 1 / size of their group in each fold's training rows, and what each fold and class multiplies it by."""
    key = F.coalesce(F.col(balance).cast("string"), F.lit("missing"))
    counts = rows.where("_oof_train").groupBy(key.alias("_oof_key")).agg(*[F.count_if(F.col("fold") != f).alias(f"n{f}") for f in range(k)], *[F.count_if((F.col("fold") != f) & (F.col("_oof_y") == y)).alias(f"n{f}_{y}") for f in range(k) for y in (0, 1)])
    counts = stage(counts, "balance")
    share = lambda f, y: F.coalesce(F.sum(F.col(f"n{f}_{y}") / F.nullif(F.col(f"n{f}"), F.lit(0))), F.lit(0.0))
    sums = counts.agg(*[share(f, y).alias(f"s{f}_{y}") for f in range(k) for y in (0, 1)], *[F.sum(f"n{f}").alias(f"n{f}") for f in range(k)]).first()
    each = counts.select("_oof_key", F.array(*[F.coalesce(1 / F.nullif(F.col(f"n{f}"), F.lit(0)), F.lit(0.0)) for f in range(k)]).alias("_oof_w"))
    weighed = attach(rows.withColumn("_oof_key", key), each, ["_oof_key"], "left").drop("_oof_key")
    scales = [[(sums[f"n{f}"] or 0) / 2 / (sums[f"s{f}_{y}"] or 1.0) for y in (0, 1)] for f in range(k)]
    return weighed, np.array(scales)


def _summary(rows: DataFrame, group: str, k: int) -> list[dict[str, int]]:
    own = rows.where("fold IS NOT NULL").groupBy("fold").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(group).alias("groups"), F.count_if("_oof_train").alias("t"), F.count_distinct(F.when(F.col("_oof_train"), F.col(group))).alias("g"),
        F.count_if(F.col("_oof_train") & (F.col("_oof_y") == 1)).alias("p"),
    )
    by = {r["fold"]: r for r in own.collect()}
    rest = lambda f, n: sum(r[n] for g, r in by.items() if g != f)
    # A group is in one fold, so groups of folds add up.
    return [{"train_rows": rest(f, "t"), "train_groups": rest(f, "g"), "test_rows": by[f]["rows"], "test_groups": by[f]["groups"], "positive": rest(f, "p"), "negative": rest(f, "t") - rest(f, "p")} for f in range(k)]


def _shape(fitted: DataFrame, n: int, width: int, k: int, fill: str, accuracy: int) -> np.ndarray:
    """(fold, 3, feature): what fills gaps, mean and deviation among the training rows of each fold."""
    shape = np.zeros((k, 3, width))
    shape[:, 2] = 1.0
    if not n:
        return shape
    value = [F.when(~F.isnan(F.col("_oof_x")[i]), F.col("_oof_x")[i]) for i in range(n)]
    if fill == "median":
        # The mean of the lower and the upper median, each of a sketch.
        middle = lambda v: (F.percentile_approx(v, F.lit(0.5), F.lit(accuracy)) - F.percentile_approx(-v, F.lit(0.5), F.lit(accuracy))) / 2
        found = fitted.agg(*[middle(F.when(F.col("fold") != f, v)) for f in range(k) for v in value]).first()
        shape[:, 0, :n] = np.array([v or 0.0 for v in found]).reshape(k, n)
    parts = fitted.groupBy("fold").agg(F.count(F.lit(1)), *[e for v in value for e in (F.count(v), F.avg(v), F.var_pop(v))]).collect()
    own = {r[0]: (r[1], np.array([x or 0.0 for x in r[2:]]).reshape(n, 3)) for r in parts}
    for f in range(k):
        others = [own[g] for g in own if g != f]
        rows = sum(r for r, _ in others)
        known = np.array([p[:, 0] for _, p in others])
        gaps = rows - known.sum(axis=0)
        sizes = np.vstack([known, gaps])
        means = np.vstack([[p[:, 1] for _, p in others], shape[f, 0, :n]])
        mean = (sizes * means).sum(axis=0) / max(rows, 1)
        spread = sum(p[:, 0] * p[:, 2] for _, p in others) + (sizes * (means - mean) ** 2).sum(axis=0)
        deviation = np.sqrt(spread / max(rows, 1))
        # Rounding leaves a constant column a tiny deviation.
        steady = deviation <= 1e-12 * np.maximum(1.0, np.abs(mean))
        shape[f, 1, :n], shape[f, 2, :n] = mean, np.where(steady, 1.0, deviation)
    return shape


def _scaled(x: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Filled and scaled features of one fold, and a column of ones."""
    z = (np.where(np.isnan(x), shape[0], x) - shape[1]) / shape[2]
    return np.column_stack([z, np.ones(len(z))])


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


def _sums(fitted: DataFrame, trial: dict, columns: dict, shape: np.ndarray, scales: np.ndarray | None) -> dict:
    """Loss, gradient and upper Hessian of each model of `trial`, flat, summed over its training rows."""
    keys = list(trial)
    width = shape.shape[2]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x, w = _matrix(batch.column("_oof_x"), width), _matrix(batch.column("_oof_w"), 1 if scales is None else len(scales))
            fold, y = batch.column("fold").to_numpy(), batch.column("_oof_y").to_numpy()
            for f in dict.fromkeys(f for f, _ in keys):
                others = fold != f
                z, t = _scaled(x[others], shape[f]), y[others]
                v = w[others, 0 if scales is None else f]
                v = v if scales is None else v * scales[f][t.astype(int)]
                for m, (g, s) in enumerate(keys):
                    if g == f:
                        zs = z[:, [*columns[s], width]]
                        eta = zs @ trial[g, s]
                        p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                        hessian = (zs * (v * p * (1 - p))[:, None]).T @ zs
                        found = np.concatenate([[np.sum(v * (np.logaddexp(0, eta) - t * eta))], zs.T @ (v * (p - t)), hessian[np.triu_indices(len(hessian))]])
                        total[m] = total.get(m, 0.0) + found
        stripe = TaskContext.get().partitionId() % STRIPES
        yield pa.RecordBatch.from_pydict({"model": pa.array(list(total), pa.int64()), "stripe": pa.array([stripe] * len(total), pa.int64()), "sums": pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": [pdf["model"].iloc[0]], "stripe": [pdf["stripe"].iloc[0]], "sums": [np.sum(np.vstack(pdf["sums"].to_numpy()), axis=0)]})

    kind = "model long, stripe long, sums array<double>"
    parts = fitted.select("fold", "_oof_x", "_oof_y", "_oof_w").mapInArrow(partial, kind)
    parts = parts.groupBy("model", "stripe").applyInPandas(add, kind).groupBy("model").applyInPandas(add, kind)
    return {keys[r["model"]]: np.array(r["sums"]) for r in parts.collect()}


def _newton(fitted: DataFrame, models: dict, columns: dict, shape: np.ndarray, scales: np.ndarray | None, c: float, penalised: bool, max_steps: int) -> None:
    """Takes all models to their optimum, in place; a step that does not lower a model's objective is halved."""
    trial, best = {m: b.copy() for m, b in models.items()}, dict.fromkeys(models, np.inf)
    for _ in range(max_steps):
        if not trial:
            return
        for m, flat in _sums(fitted, trial, columns, shape, scales).items():
            beta, n = trial[m], len(trial[m])
            penalty = np.ones(n)
            penalty[-1] = float(penalised)
            value = 0.5 * np.sum(penalty * beta**2) + c * flat[0]
            if value > best[m] + 1e-12 * abs(best[m]):
                trial[m] = (beta + models[m]) / 2
                continue
            gradient = penalty * beta + c * flat[1 : n + 1]
            upper = np.zeros((n, n))
            upper[np.triu_indices(n)] = c * flat[n + 1 :]
            hessian = upper + np.triu(upper, 1).T + np.diag(penalty)
            step = np.linalg.solve(hessian, gradient)
            models[m], best[m] = beta, value
            if gradient @ step < 1e-14 * (1 + abs(value)):
                models[m] = beta - step
                del trial[m]
            else:
                trial[m] = beta - step
    raise RuntimeError(f"{len(trial)} models are not at their optimum after {max_steps} steps")


def _predict(rows: DataFrame, kept: Sequence[str], models: dict, columns: dict, shape: np.ndarray) -> DataFrame:
    """Each row once per set, by its own fold's model."""
    order = list(columns)

    @F.pandas_udf("array<double>")
    def tell(fold: pd.Series, x: pd.Series) -> pd.Series:
        out = np.full((len(fold), len(order)), np.nan)
        for f in {f for f, _ in models}:
            mine = (fold == f).to_numpy()
            if mine.any():
                z = _scaled(np.vstack(x[mine].to_numpy()), shape[f])
                for i, s in enumerate(order):
                    out[mine, i] = 1 / (1 + np.exp(-np.clip(z[:, [*columns[s], shape.shape[2]]] @ models[f, s], -700, 700)))
        return pd.Series(list(out))

    told = rows.select(*[F.col(f"`{n}`") for n in kept], "fold", F.posexplode(tell("fold", "_oof_x")).alias("_oof_set", "_oof_p"))
    name = F.element_at(F.array(*[F.lit(s) for s in order]), F.col("_oof_set") + 1)
    return told.withColumns({"set": name, "probability": F.when(~F.isnan("_oof_p"), F.col("_oof_p"))}).drop("_oof_set", "_oof_p")
