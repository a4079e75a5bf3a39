"""Clustering over bit planes against plain whole numbers, and its SQL twin."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from ravelin.llm import centroids
from ravelin.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 28), st.integers(0, 2**31))
def test_products_squares_and_sums_are_exact(planes, seed):
    rng = np.random.default_rng(seed)
    low = -(1 << (planes - 1))
    q = rng.integers(low, -low, (7, 64))
    q[0, :3] = low, -low - 1, 0
    x = centroids.planes_of(q, planes)
    big = q.astype(object)
    assert (centroids.products(x, x[:4]) == big @ big[:4].T).all()
    assert (centroids.squares(x) == (big * big).sum(1)).all()
    assert (centroids.totals(x) == big.sum(0)).all()


def brute(rows, clusters=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: "~" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest()
    centres = [q for _, q in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:clusters]]

    def assign():
        apart = lambda q: [sum((a - b) ** 2 for a, b in zip(q, c, strict=True)) for c in centres]
        return [min((d, c) for c, d in enumerate(apart(q))) for _, q in kept]

    for _ in range(rounds):
        homes = assign()
        for c in range(len(centres)):
            mine = [q for (_, q), (_, home) in zip(kept, homes, strict=True) if home == c]
            if mine:
                centres[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    homes, total = assign(), {}
    for d, c in homes:
        total[c] = total.get(c, 0) + d
    return sorted(((i, c, d, total[c], sum(total.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, homes, strict=True)), key=repr)


def result(df):
    return sorted(map(tuple, df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def table(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, cluster string, planes string")


@pytest.mark.parametrize("scale", [0.01, 1.0, 1000.0])
def test_clusters_by_plain_numbers(spark, scale):
    rng = np.random.default_rng(int(scale * 100))
    middles = rng.normal(size=(5, 64)) * scale
    rows = [(i, (middles[i % 5] + rng.normal(size=64) * 0.3 * scale).tolist()) for i in range(120)]
    assert result(centroids.cluster(table(spark, rows))) == brute(rows)


def test_awkward_rows(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(20, 64))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(3, v[3].tolist()), (3, v[4].tolist()), (None, v[5].tolist()), (None, v[5].tolist())]
    rows += [(50, None), (51, []), (52, [1.0] * 63), (53, [1.0] * 65), (54, [None] + [1.0] * 63), (55, [float("nan")] * 64), (56, [float("inf")] + [0.0] * 63), (57, [0.0] * 64), (58, [-0.0] * 64)]
    got = result(centroids.cluster(table(spark, rows)))
    assert got == brute(rows) and len(got) == 26
    few = [(i, v[i].tolist()) for i in range(3)]
    assert result(centroids.cluster(table(spark, few))) == brute(few)
    alike = [(i, [0.5] * 64) for i in range(12)]  # every centroid the same: ties go to the first
    got = result(centroids.cluster(table(spark, alike)))
    assert got == brute(alike) and {r[1] for r in got} == {0}
    assert centroids.cluster(table(spark, [])).count() == 0 == centroids.cluster(table(spark, [(1, None)])).count()
    with pytest.raises(ValueError, match="planes"):
        centroids.cluster(table(spark, [(1, [1e30] * 64)]))


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = QUERIES["op13_centroids"](spark, SF).toPandas()
    want = con.execute(ORACLE_SQL["op13_centroids"]).fetchdf()[list(got.columns)]
    assert got.sort_values("vec_id").to_numpy().tolist() == want.sort_values("vec_id").to_numpy().tolist()
    assert len(got) == 500
