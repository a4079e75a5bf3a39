"""Registered queries against their SQL twins, and those without one against plain Python."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from ravelin.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or (np.isscalar(v) and pd.isna(v)):
            return "null"
        return repr(round(float(v), 9)) if isinstance(v, (float, int, np.number, np.bool_)) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, sql, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), sql.execute(catalogue.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_greedy_seeds_by_plain_python(spark):
    events = pd.read_parquet(f"{SF}/events.parquet").sort_values(["ts", "event_id"])
    want = set()
    for user, g in events.groupby("user_id"):
        taken = []
        for pos, value in sorted(enumerate(g.value, 1), key=lambda x: (-x[1], x[0])):
            if value > 0 and len(taken) < 5 and all(abs(pos - p) > 3 for p, _ in taken):
                taken.append((pos, value))
        want |= {(user, p, v, i) for i, (p, v) in enumerate(taken, 1)}
    assert {tuple(r) for r in catalogue.QUERIES["greedy_seeds"](spark, SF).collect()} == want


def test_greedy_spatial_by_plain_python(spark):
    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    want = set()
    for label, g in e.groupby("label"):
        points = sorted(((-(float(v[0]) + 1.0), k, np.array(v[:3], float)) for k, v in zip(g.vec_id, g.embedding, strict=True)), key=lambda p: p[:2])
        taken = []
        for s, k, x in points:
            if -s > 0 and len(taken) < 10 and all(np.linalg.norm(x - y) >= 0.2 for _, _, y in taken):
                taken.append((s, k, x))
        want |= {(label, k, i) for i, (_, k, _) in enumerate(taken, 1)}
    assert {(r.label, r.vec_id, r.seed) for r in catalogue.QUERIES["greedy_spatial"](spark, SF).collect()} == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL) - {"logreg_oof"}))
def test_queries_without_sql_give_rows_and_rerun_alike(spark, name):
    first, again = (catalogue.QUERIES[name](spark, SF).toPandas() for _ in range(2))
    assert len(first) and canonical(first) == canonical(again)


def test_out_of_fold_models_are_stationary(spark):
    from pyspark.sql import functions as F
    from ravelin.operators import ml

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(int(i % 30), float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "g int, a double, b double, y int").withColumn("w", F.lit(1.0))
    folds = ml.group_folds(df, "g", 3)
    assert sorted(r.n for r in folds.groupBy("fold").agg(F.count("*").alias("n")).collect()) == [10, 10, 10]
    out = ml.out_of_fold(df, folds, "g", "y", "w", ["a", "b"], 3).toPandas()
    assert len(out) == 300 and ((out.probability > 0.5) == out.y).mean() > 0.75
    f = {r.g: r.fold for r in folds.collect()}
    train = df.toPandas()[lambda d: d.g.map(f) != 0]
    z = (train[["a", "b"]] - train[["a", "b"]].mean()) / train[["a", "b"]].std(ddof=0)
    told = out[out.fold == 0]
    logit = np.log(told.probability / (1 - told.probability)).to_numpy()
    design = np.column_stack([(told[["a", "b"]] - train[["a", "b"]].mean()) / train[["a", "b"]].std(ddof=0), np.ones(len(told))])
    beta = np.linalg.lstsq(design, logit, rcond=None)[0]
    p = 1 / (1 + np.exp(-(z.to_numpy() @ beta[:2] + beta[2])))
    slope = z.to_numpy().T @ (train.y.to_numpy() - p) - beta[:2]
    assert np.abs(slope).max() < 1e-2 and abs((train.y.to_numpy() - p).sum()) < 1e-2
