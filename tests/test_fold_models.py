"""All folds and sets at once, against Newton's method on dense matrices, fold by fold and set by set."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from ravelin.operators import fold_models

SETS = {"both": ["a", "b", "kind"], "one": ["a"], "names": ["kind"], "none": []}
SCHEMA = "k int, g int, a double, b double, kind string, y int, main boolean, place string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    out = []
    for i in range(300):
        a, b, kind = float(rng.normal(5, 2)), float(rng.normal()), str(rng.choice(["p", "q", "r"]))
        y = int(a - 5 + b + (kind == "q") + rng.normal() * 2 > 0)
        out.append([i, i % 20, a, b, kind, y, bool(i % 7), f"h{i % 9}"])
    for i in (4, 90, 201):
        out[i][2] = None
    out[8][3], out[9][4] = float("nan"), None
    out[15][4] = "rare"
    out[30][7] = None
    return [tuple(r) for r in out]


def brute(rows, fold_of, f, columns, balance, fill, penalised, c=0.8):
    """Probabilities of the rows of fold `f`, by the model of the others' primary rows."""
    train = np.array([fold_of[r[1]] != f and r[6] for r in rows])
    x = []
    for name, at in (("a", 2), ("b", 3)):
        if name in columns:
            v = np.array([np.nan if r[at] is None else r[at] for r in rows])
            v = np.where(np.isnan(v), np.nanmedian(v[train]) if fill == "median" else 0.0, v)
            x.append((v - v[train].mean()) / v[train].std())
    if "kind" in columns:
        names = [r[4] or "missing" for r in rows]
        x += [np.array([float(n == s) for n in names]) for s in sorted({n for n, t in zip(names, train, strict=True) if t})]
    x = np.column_stack([*x, np.ones(len(rows))])
    y = np.array([r[5] for r in rows])
    w = np.ones(len(rows))
    if balance:
        size = {}
        for r, t in zip(rows, train, strict=True):
            size[r[7]] = size.get(r[7], 0) + t
        w = np.array([1 / size[r[7]] if t else 0.0 for r, t in zip(rows, train, strict=True)])
        for label in (0, 1):
            w[y == label] /= w[train & (y == label)].sum()
        w *= train.sum() / 2
    penalty = np.ones(x.shape[1])
    penalty[-1] = float(penalised)
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x[train] @ beta))
        gradient = penalty * beta + c * x[train].T @ (w[train] * (p - y[train]))
        beta -= np.linalg.solve(np.diag(penalty) + c * (x[train] * (w[train] * p * (1 - p))[:, None]).T @ x[train], gradient)
    return 1 / (1 + np.exp(-x @ beta))


@pytest.mark.parametrize("balance,fill,penalised", [("place", "zero", False), (None, "median", True)])
def test_all_models_are_at_their_optimum(spark, rows, balance, fill, penalised):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = fold_models.out_of_fold_sets(df, "g", "y", SETS, 4, F.col("main"), balance=balance, categories=["kind"], c=0.8, fill=fill, penalised_intercept=penalised)
    out = found.predictions.toPandas()
    assert len(out) == len(rows) * len(SETS) and set(out.columns) == {*(c.split()[0] for c in SCHEMA.split(", ")), "fold", "set", "probability"}
    fold_of = dict(zip(out.g, out.fold, strict=True))
    assert sorted(set(fold_of.values())) == [0, 1, 2, 3] and (out.groupby("g").fold.nunique() == 1).all()
    for s, columns in SETS.items():
        mine = out[out["set"] == s].set_index("k")
        for f in range(4):
            want = brute(rows, fold_of, f, columns, balance, fill, penalised)
            ids = mine.index[mine.fold == f]
            assert np.abs(mine.probability[ids] - want[ids]).max() < 1e-6
    told = {r.fold: r for r in found.folds.collect()}
    for f in range(4):
        train = [r for r in rows if fold_of[r[1]] != f and r[6]]
        assert (told[f].train_rows, told[f].positive, told[f].fitted) == (len(train), sum(r[5] for r in train), True)
        assert told[f].test_rows == sum(fold_of[r[1]] == f for r in rows) and told[f].test_groups + told[f].train_groups == 20
    coefficients = found.coefficients.toPandas()
    assert {*coefficients[coefficients["set"] == "none"].feature} == {"intercept"} and {*coefficients[coefficients["set"] == "names"].feature} >= {"kind=p", "kind=missing", "intercept"}


def test_a_fold_of_one_class_gives_no_model(spark):
    # All ones are in group 0, so the model that must not see it has zeros alone.
    rows = [(i, i % 3, float(i), int(i % 3 == 0 and i > 6)) for i in range(30)] + [(30, None, 1.0, 1), (31, 1, 2.0, None)]
    df = spark.createDataFrame(rows, "k int, g int, a double, y int")
    found = fold_models.out_of_fold_sets(df, "g", "y", {"s": ["a"]}, 9)
    fitted = {r.fold: r.fitted for r in found.folds.collect()}
    assert len(fitted) == 3 and sorted(fitted.values()) == [False, True, True]  # three groups, so three folds
    out = {r.k: r for r in found.predictions.collect()}
    assert len(out) == 32
    assert all((out[i].probability is None) == (i % 3 == 0) for i in range(30))
    assert out[30].fold is None and out[30].probability is None and out[31].fold is None and out[31].probability is None


def test_what_cannot_be_fitted_is_refused(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 0), (2, 1, 0.7, 1)], "k int, g int, a double, y int")
    with pytest.raises(ValueError, match="two folds"):
        fold_models.out_of_fold_sets(df, "g", "y", {"s": ["a"]}, 5)
    with pytest.raises(ValueError, match="two folds"):
        fold_models.out_of_fold_sets(df.limit(0), "g", "y", {"s": ["a"]}, 5)
    with pytest.raises(ValueError, match="not there"):
        fold_models.out_of_fold_sets(df, "g", "y", {"s": ["b"]}, 5)
    with pytest.raises(ValueError, match="median or zero"):
        fold_models.out_of_fold_sets(df, "g", "y", {"s": ["a"]}, 5, fill="mean")
    many = spark.range(3000).selectExpr("id AS g", "id % 2 AS y", "cast(id AS string) AS a")
    with pytest.raises(ValueError, match="not a category"):
        fold_models.out_of_fold_sets(many, "g", "y", {"s": ["a"]}, 2, categories=["a"])
