"""Variants of the out-of-fold model, held to their conditions of stationarity; named feature sets on hand-made names."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from ravelin.operators import feature_sets, ml


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    n = 240
    x, kind = rng.normal(2.0, 1.0, n), rng.choice(["p", "q", "r"], n)
    y = (x + (kind == "q") - 2.2 + rng.normal(size=n) > 0).astype(int)
    out = [[int(i % 24), float(a), str(k), int(b), float(1 + i % 3)] for i, (a, k, b) in enumerate(zip(x, kind, y, strict=True))]
    for i in (3, 50, 110):
        out[i][1] = None
    for i in (5, 61):
        out[i][2] = None
    out[24 * 4][2] = "unseen"  # in one group alone, so in one fold alone
    return [tuple(r) for r in out]


def design(rows, train, fill, intercept):
    """Columns as the model should see them, without those of names not seen in training."""
    known = [r[1] for r, t in zip(rows, train, strict=True) if t and r[1] is not None]
    x = np.array([(np.median(known) if fill == "median" else 0.0) if r[1] is None else r[1] for r in rows])
    x = (x - x[train].mean()) / x[train].std()
    names = [r[2] or "missing" for r in rows]
    seen = sorted({n for n, t in zip(names, train, strict=True) if t})
    hot = np.array([[float(n == s) for s in seen] for n in names])
    return np.column_stack([x, hot, *([np.ones(len(rows))] if intercept else [])])


@pytest.mark.parametrize("fill,penalised", [("zero", False), ("median", True)])
def test_variants_are_stationary(spark, rows, fill, penalised):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, g int, a double, kind string, y int, w double")
    folds = spark.createDataFrame([(g, g % 3) for g in range(24)], "g int, fold long")
    out = ml.out_of_fold(df, folds, "g", "y", "w", ["a"], 3, c=0.7, categories=["kind"], fill=fill, penalised_intercept=penalised).orderBy("k").toPandas()
    assert list(out.k) == list(range(len(rows))) and set(out.columns) == {"k", "g", "a", "kind", "y", "w", "fold", "probability"}
    y, w = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    for fold in range(3):
        test = np.array([r[0] % 3 == fold for r in rows])
        full = design(rows, ~test, fill, True)
        free = np.zeros(full.shape[1])
        free[-1] = 0.0 if not penalised else 1.0
        penalty = np.where(np.arange(full.shape[1]) == full.shape[1] - 1, free[-1], 1.0)
        beta = np.zeros(full.shape[1])
        for _ in range(60):  # Newton steps to the optimum of 0.5 |b|^2 + C sum of w loss
            p = 1 / (1 + np.exp(-(full[~test] @ beta)))
            grad = penalty * beta + 0.7 * full[~test].T @ (w[~test] * (p - y[~test]))
            hess = np.diag(penalty) + 0.7 * (full[~test] * (w[~test] * p * (1 - p))[:, None]).T @ full[~test]
            beta -= np.linalg.solve(hess, grad)
        want = 1 / (1 + np.exp(-(full[test] @ beta)))
        assert np.abs(out.probability.to_numpy()[test] - want).max() < 1e-4


def test_unknown_fill_is_refused(spark, rows):
    df = spark.createDataFrame(rows, "g int, a double, kind string, y int, w double").withColumn("fold", F.lit(0))
    with pytest.raises(ValueError, match="median or zero"):
        ml._scaled(df, ["a"], F.lit(True), "mean")


def test_feature_sets_follow_from_declared_blocks():
    blocks = feature_sets.starting(size="size_", rate=("rate_", "tax"), absent="absent_")
    columns = ["size_a", "rate_b", "tax", "size_a_x_rate_b", "size_a_x_size_c", "other"]
    sets = feature_sets.generate(columns, blocks, [("rate", "size"), ("absent",)], cross="_x_")
    assert sets == {
        "all": columns,
        "only size": ["size_a", "size_a_x_size_c"],
        "without size": ["rate_b", "tax", "other"],
        "only rate": ["rate_b", "tax"],
        "without rate": ["size_a", "size_a_x_size_c", "other"],
        "rate+size": columns[:-1],
    }
    assert feature_sets.blocks_of("size_a_x_rate_b", blocks) == {"size"} and feature_sets.blocks_of("size_a_x_rate_b", blocks, "_x_") == {"size", "rate"}
    assert feature_sets.generate([], blocks) == {} and feature_sets.generate(["z"], {}) == {"all": ["z"]}
    with pytest.raises(ValueError, match="nothing"):
        feature_sets.generate(columns, blocks, [("nothing",)])
