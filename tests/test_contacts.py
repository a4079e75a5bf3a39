"""Nearest partners and smallest distances against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from ravelin.operators import contacts

SCHEMA = "g string, label string, place int, x double, y double, z double, cell string, side string"


def brute(left, right):
    """Per (case, side, label): (distance, partner); per case the smallest distance."""
    best, least = {}, {}
    ends = {}
    for k, rows in enumerate((left, right)):
        for g, label, place, *p in rows:
            best.setdefault((g, k, label), (None, None))
            if g is not None and label is not None and all(c is not None and math.isfinite(c) for c in p):
                ends.setdefault((g, k), []).append((place, label, p))
    for g in {g for g, _ in ends}:
        for k in (0, 1):
            for _, label, p in ends.get((g, k), []):
                for place, other, q in ends.get((g, 1 - k), []):
                    a, b = (p, q) if k == 0 else (q, p)
                    d2 = (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2
                    now = best[g, k, label]
                    if now[0] is None or (d2, place) < now[:2]:
                        best[g, k, label] = (d2, place, other)
                    least[g] = min(least.get(g, math.inf), d2)
    return {k: (None, None) if v[0] is None else (round(math.sqrt(v[0]), 9), v[2]) for k, v in best.items()}, {g: round(math.sqrt(d), 9) for g, d in least.items()}


def clouds(seed, shapes):
    rng = np.random.default_rng(seed)
    out = ([], [])
    for g, (n, m, far, scale) in enumerate(shapes):
        for k, size in enumerate((n, m)):
            for i in range(size):
                label = i // 3
                p = rng.normal(size=3) * scale + (far if k else 0)
                p = np.round(p) if g % 2 else p  # ties and equal points
                out[k].append((f"g{g}", f"{'ab'[k]}{label}", label, *map(float, p)))
    return out


@pytest.mark.parametrize("shapes", [[(40, 30, 0, 1.0), (50, 50, 0, 3.0)], [(300, 300, 100.0, 1.0), (200, 5, 1000.0, 2.0)], [(400, 400, 0, 0.001), (1, 1, 5.0, 0.0)]])
def test_all_pairs_agree(spark, shapes):
    left, right = clouds(len(shapes[0]), shapes)
    more = [("only left", "a0", 0, 1.0, 2.0, 3.0), ("g0", "nowhere", 99, None, 0.0, 0.0), ("g0", "odd", 98, float("nan"), 0.0, 0.0), (None, "a1", 1, 0.0, 0.0, 0.0), ("g0", None, 97, 0.0, 0.0, 0.0)]
    left = left + more + left[:5]
    dfs = [spark.createDataFrame([(*r, "c", "s") for r in rows], SCHEMA) for rows in (left, right)]
    want, least = brute(left, right)
    got = contacts.nearest_partners(*dfs, "g", "label", "place", cutoff=2.0).collect()
    assert {(r.case, r.side, r.label): (None if r.distance is None else round(r.distance, 9), r.partner) for r in got} == want and len(got) == len(want)
    assert all(r.interface == (r.distance is not None and r.distance <= 2.0) for r in got)
    assert {r.case: round(r.distance, 9) for r in contacts.smallest_distance(*dfs, "g", "label", "place").collect()} == least


def test_dense_cells_grow_the_tree(spark, monkeypatch):
    monkeypatch.setattr(contacts, "CELL", 4)
    left, right = clouds(3, [(150, 150, 0.5, 1.0)])
    left += [("g0", "far", 500, 1e6, 1e6, 1e6)]  # everything else in one cell of the first levels
    dfs = [spark.createDataFrame([(*r, "c", "s") for r in rows], SCHEMA) for rows in (left, right)]
    want, _ = brute(left, right)
    assert {(r.case, r.side, r.label): (round(r.distance, 9), r.partner) for r in contacts.nearest_partners(*dfs, "g", "label", "place").collect()} == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert contacts.nearest_partners(none, none, "g", "label", "place").count() == 0
    assert contacts.smallest_distance(none, none, "g", "label", "place").count() == 0
    assert contacts.contact_stats(none, none, "g", "label", "place", [1.0]).count() == 0


def test_no_cross_join_in_the_plan(spark):
    left, right = clouds(1, [(30, 30, 0, 1.0)])
    dfs = [spark.createDataFrame([(*r, "c", "s") for r in rows], SCHEMA) for rows in (left, right)]
    plan = contacts.nearest_partners(*dfs, "g", "label", "place")._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_points_that_another_of_their_label_outdoes_meet_nothing(spark):
    """Points met grow with the labels, not with the points in reach of each point."""
    rng = np.random.default_rng(5)
    left = [("g", f"a{i % 20}", i % 20, *map(float, rng.uniform(0, (50, 10, 10))), "c", "s") for i in range(2000)]
    right = [("g", f"b{i % 20}", i % 20, *map(float, rng.uniform(0, 10, 3)), "c", "s") for i in range(2000)]
    points = contacts._points(*[spark.createDataFrame(r, SCHEMA) for r in (left, right)], "g", "label", "place", contacts.AXES)
    held, placed, cells = contacts._tree(points)
    assert contacts._met(held, placed, cells, ["case", "side", "label"]).count() < 4000


def moved(spark, run):
    """MB that `run` shuffles, and what it gives."""
    total = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite() / 1e6
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before, out = total(), run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return total() - before, out


def cube(spark, monkeypatch):
    """Two sides of 100 000 points each in one cube."""
    monkeypatch.setattr(contacts, "SAMPLE", 1000, raising=False)
    random = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) / 1e4
    return [spark.range(0, 100_000, 1, 4).select(F.lit("g").alias("g"), F.concat(F.lit(c), F.col("id") % 1000).alias("label"), (F.col("id") % 1000).alias("place"), *[random(seed + i).alias(x) for i, x in enumerate("xyz")]) for c, seed in (("a", 1), ("b", 4))]


def test_partners_move_a_point_to_few_tiles(spark, monkeypatch):
    """Rows moved grow with the points, not with the levels of the tree."""
    dfs = cube(spark, monkeypatch)
    mb, rows = moved(spark, lambda: contacts.nearest_partners(*dfs, "g", "label", "place").collect())
    assert len(rows) == 2000 and mb < 24


def test_parts_of_large_tiles(spark, monkeypatch):
    monkeypatch.setattr(contacts, "MOST", 40)
    left, right = clouds(7, [(120, 90, 0.0, 2.0), (150, 150, 1.0, 2.0), (30, 40, 200.0, 1.0)])
    left += [*left[:60], ("g2", "there", 98, 200.0, 200.0, 200.0)]
    dfs = [spark.createDataFrame([(*r, "c", "s") for r in rows], SCHEMA) for rows in (left, right)]
    want, _ = brute(left, right)
    partners = contacts.nearest_partners(*dfs, "g", "label", "place").collect()
    assert {(r.case, r.side, r.label): (round(r.distance, 9), r.partner) for r in partners} == want


def stats(left, right, cutoffs):
    """Per case: (distance, (contacts, labels of the left, labels of the right) within each cutoff), by all pairs."""
    out = {}
    for g in {r[0] for r in left + right}:
        a, b = [[r for r in rows if r[0] == g] for rows in (left, right)]
        d2 = np.array([[math.inf] * len(b)] * len(a)).reshape(len(a), len(b))
        if a and b:
            p, q = [np.array([r[3:6] for r in rows]) for rows in (a, b)]
            d2 = ((p[:, None] - q[None]) ** 2)[..., 0] + ((p[:, None] - q[None]) ** 2)[..., 1] + ((p[:, None] - q[None]) ** 2)[..., 2]
        names = [{rows[i][1] for i in np.flatnonzero((d2 <= c * c).any(axis=axis))} - {None} for c in cutoffs for axis, rows in ((1, a), (0, b))]
        out[g] = (round(math.sqrt(d2.min()), 9) if d2.size else None, *[n for i, c in enumerate(cutoffs) for n in (int((d2 <= c * c).sum()), len(names[2 * i]), len(names[2 * i + 1]))])
    return out


@pytest.mark.parametrize("most", [None, 40])
def test_contacts_by_all_pairs(spark, monkeypatch, most):
    if most:
        monkeypatch.setattr(contacts, "MOST", most)
    left, right = clouds(7, [(120, 90, 0.0, 2.0), (150, 150, 1.0, 2.0), (30, 40, 200.0, 1.0)])
    left += [*left[:60], ("only left", "a0", 0, 1.0, 2.0, 3.0), ("g0", None, 97, 0.0, 0.0, 0.0), ("g2", "there", 98, 200.0, 200.0, 200.0)]
    dfs = [spark.createDataFrame([(*r, "c", "s") for r in rows], SCHEMA) for rows in (left, right)]
    cutoffs = [2.0, 0.5, 1.0]
    got = {r.case: (None if r.distance is None else round(r.distance, 9), *r[2:11]) for r in contacts.contact_stats(*dfs, "g", "label", "place", cutoffs).collect()}
    assert got == stats(left, right, cutoffs)


def test_contacts_move_a_point_to_few_tiles(spark, monkeypatch):
    """Rows moved grow with the points, not with the cells around each of them."""
    dfs = cube(spark, monkeypatch)
    mb, rows = moved(spark, lambda: contacts.contact_stats(*dfs, "g", "label", "place", [1.0, 2.0]).collect())
    assert len(rows) == 1 and mb < 15
