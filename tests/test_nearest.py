"""Nearest neighbours by cells against all pairs."""

import numpy as np
import pytest
from ravelin.operators.nearest import nearest


def brute(rows):
    out = {}
    for k, v in rows:
        best = None
        for j, w in rows:
            if j != k:
                d = 0.0
                for p, q in zip(v, w, strict=True):
                    d += (p - q) ** 2
                best = min(best, (d, j)) if best else (d, j)
        if best and (k not in out or best < out[k]):
            out[k] = best
    return out


@pytest.mark.parametrize("block", [4096, 40, 7])
def test_cells_lose_no_neighbour(spark, block):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 5)) * 4
    rows = [(i, (centres[i % 6] + rng.normal(size=5) * (0.1 if i % 6 else 2)).tolist()) for i in range(240)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # a group of copies, and a lone far point
    rows += [(5000, [90.0] * 5), (5, [0.0] * 5)]
    df = spark.createDataFrame([(k, v, "x") for k, v in rows], "id long, v array<double>, key string").repartition(5)
    got = {r.id: (r.distance, r.neighbour) for r in nearest(df, "id", "v", block, 16).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    assert all(got[k][1] == j and got[k][0] == pytest.approx(d**0.5) for k, (d, j) in want.items())


def test_awkward_points(spark):
    rows = [(1, [0.0, 1.0]), (2, None), (3, [float("nan"), 0.0]), (None, [0.0, 1.0]), (4, [0.0, 1.0]), (4, [0.0, 1.0]), (5, [None, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert {(r.id, r.neighbour, r.distance) for r in nearest(df, "id", "v").collect()} == {(1, 4, 0.0), (4, 1, 0.0)}
    assert nearest(df.limit(0), "id", "v").count() == 0 and nearest(df.where("id = 1"), "id", "v").count() == 0


def test_a_vector_is_moved_once_for_the_cells_of_a_station(spark, monkeypatch):
    from ravelin.operators import nearest as module

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(4)
    staged, real = {}, module.stage
    monkeypatch.setattr(module, "stage", lambda t, name: staged.setdefault(name, real(t, name)))
    got = {r.id: r.neighbour for r in nearest(df, "id", "v", 100).collect()}
    v = np.array([r[1] for r in rows])
    d = ((v[:, None, :] - v[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert [got[i] for i in range(3000)] == d.argmin(1).tolist()
    cells = staged["cell-blocks"].count()
    # Without clusters nearly every cell is visited, but a vector goes to each station once at most.
    assert cells > 8 and staged["visits"].count() <= 3000 * -(-cells // 4)
    assert staged["visits"].groupBy("key", "station").count().where("count > 1").count() == 0
    assert dict(staged["visits"].dtypes)["v"] == "array<float>"


def test_cells_larger_than_a_station_are_parted(spark, monkeypatch):
    from ravelin.operators import nearest as module

    monkeypatch.setattr(module, "STATION", 2)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(200)]
    assert module._stations(np.array([1, 1, 1, 5, 1])).tolist() == [0, 0, 1, 2, 3]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r.id: (r.distance, r.neighbour) for r in nearest(df, "id", "v", 10, 30).collect()}
    want = brute(rows)
    assert {k: j for k, (_, j) in got.items()} == {k: j for k, (_, j) in want.items()}
