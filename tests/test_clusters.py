"""Seeds, clusters, roles and diverse samples against plain Python that follows their rules row by row."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from ravelin.operators import clusters
from ravelin.plans import catalogue

SF = "/root/testdata/sf0.001"


def brute_seeds(rows, score, n, near, tie=None):
    """Positions of `rows` (dicts with `k`) taken in order; `near` tells two rows."""
    able = [r for r in rows if r[score] is not None and r[score] > 0]
    mass = {r["k"]: round(sum(o[score] for o in able if near(o, r)), 9) for r in able}
    second = lambda r: max(0.0, (r[tie] if tie else 0.0) or 0.0)
    taken = []
    for r in sorted(able, key=lambda r: (-r[score], -mass[r["k"]], -second(r), r["k"])):
        if len(taken) < n and not any(near(r, o) for o in taken):
            taken.append(r)
    return taken


def top(values):
    v = sorted(values, reverse=True)[:8]
    return v[0] + 0.5 * sum(v[1:])


def brute_cluster(rows, requested, near_seed, near_member, near_mass):
    able = [r for r in rows if r["score"] > 0 and r["support"] > 0]
    if not able:
        return [], able, 0.0
    for r in able:
        r["second"] = r["support"] + max(0.0, r.get("tie", 0.0) or 0.0)
        r["order"] = r["second"] + (0.25 * round(sum(o["support"] for o in able if near_mass(o, r)), 9) if near_mass else 0.0)
    best, members = -1.0, []
    for s in brute_seeds(able, "support", max(2, min(6, requested)), near_seed, "order"):
        near = [r for r in able if near_member(r, s)]
        worth = round(sum(r["support"] for r in near) + 0.75 * top([r["score"] for r in near]) + 0.25 * top([r["second"] for r in near]), 9)
        if worth > best:
            best, members = worth, near
    return members, able, best


def brute_roles(rows, requested, most_passive, near_seed, near_member, near_mass, near_shell):
    members, able, _ = brute_cluster(rows, requested, near_seed, near_member, near_mass)
    if not members:
        return set()
    peak = max(r["score"] for r in members)
    if sum(r["support"] for r in members) / sum(r["support"] for r in able) < 0.10 and peak < 0.75:
        return set()
    order = lambda r: (-r["score"], -r["support"], -r["second"], r["k"])
    active = sorted((r for r in members if r["score"] >= 0.75 * peak), key=order)[:requested]
    keys = {r["k"] for r in active}
    rest = sorted((r for r in able if r["k"] not in keys and any(near_shell(r, a) for a in active) and r["score"] >= 0.35 * peak), key=order)
    return {(r["k"], "active") for r in active} | {(r["k"], "passive") for r in rest[:most_passive]}


def space(d):
    return lambda a, b: math.sqrt(sum((p - q) ** 2 for p, q in zip(a["at"], b["at"], strict=True))) <= d


def line(g):
    return lambda a, b: abs(a["k"] - b["k"]) <= g


@pytest.fixture(scope="module")
def points():
    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    groups = {}
    for label, k, v in zip(e.label, e.vec_id, e.embedding, strict=True):
        x, y, z = (float(c) for c in v[:3])
        groups.setdefault(label, []).append({"k": k, "at": (x, y, z), "score": round(x + 0.3, 6), "support": round(abs(y), 6), "tie": round(z, 6)})
    return groups


def test_seeds_in_space(spark, points):
    want = {(g, r["k"], i) for g, rows in points.items() for i, r in enumerate(brute_seeds(rows, "score", 6, space(0.3), "tie"), 1)}
    assert {(r.label, r.vec_id, r.seed) for r in catalogue.QUERIES["spatial_seeds"](spark, SF).collect()} == want


def test_best_cluster(spark, points):
    want = set()
    for g, rows in points.items():
        members, _, worth = brute_cluster(rows, 4, space(0.3), space(0.35), space(0.35))
        want |= {(g, r["k"], round(worth, 6)) for r in members}
    assert {(r.label, r.vec_id, r.worth) for r in catalogue.QUERIES["supported_members"](spark, SF).collect()} == want


def test_roles_in_space(spark, points):
    # The query's clusters have the default distances, which hold every point of a label.
    want = {(g, *x) for g, rows in points.items() for x in brute_roles(rows, 4, 12, space(10), space(12), space(12), space(0.3))}
    assert {(r.label, r.vec_id, r.role) for r in catalogue.QUERIES["docking_roles"](spark, SF).collect()} == want


def test_roles_along_positions(spark):
    e = pd.read_parquet(f"{SF}/events.parquet").sort_values(["ts", "event_id"])
    want = set()
    for user, g in e.groupby("user_id"):
        rows = [{"k": i, "score": v, "support": round(math.fmod(v, 7), 6)} for i, v in enumerate(g.value.tolist(), 1)]
        want |= {(user, *x) for x in brute_roles(rows, 4, 6, line(3), line(4), None, line(3))}
    got = {(r.user_id, r.pos, r.role) for r in catalogue.QUERIES["docking_roles_line"](spark, SF).collect()}
    assert got == want and {r for *_, r in got} == {"active", "passive"}


def test_weak_scattered_support_is_rejected(spark):
    # Thirty far points share the support evenly, and no score reaches 0.75.
    weak = [(0, i, float(100 * i), 0.5, 1.0) for i in range(30)]
    strong = [(1, i, float(100 * i), 0.9 if i == 4 else 0.5, 1.0) for i in range(30)]
    df = spark.createDataFrame(weak + strong, "g int, k int, x double, score double, support double").withColumns({})
    from pyspark.sql import functions as F

    df = df.withColumn("y", F.lit(0.0)).withColumn("z", F.lit(0.0))
    got = clusters.roles(df, ["g"], "k", "xyz", "score", "support").collect()
    assert {r.g for r in got} <= {1}


@pytest.mark.parametrize("n", [8, 3])
def test_diverse_sample(spark, n):
    from pyspark.sql import functions as F

    p = pd.read_parquet(f"{SF}/part.parquet")
    want = set()
    for brand, g in p.groupby("p_brand"):
        left, seen, count, pick = g.to_dict("records"), {"p_name": set(), "p_size": set()}, Counter(), 0
        while left and pick < n:
            def worth(r):
                gain = (100 if count[r["p_type"]] == 0 else 0) - 3 * count[r["p_type"]] + sum(10 for c, s in seen.items() if r[c] not in s)  # noqa: B023
                return gain, -abs(r["p_size"] - 40), -(r["p_partkey"] % 3), r["p_partkey"]

            best, pick = max(left, key=worth), pick + 1
            left.remove(best)
            count[best["p_type"]] += 1
            for c, s in seen.items():
                s.add(best[c])
            want.add((brand, best["p_partkey"], pick))
    df = spark.read.parquet(f"{SF}/part.parquet").withColumn("hard", F.col("p_partkey") % 3)
    got = clusters.diverse_sample(df, ["p_brand"], "p_partkey", "p_size", "hard", ["p_name", "p_size"], "p_type", n).collect()
    assert {(r.p_brand, r.p_partkey, r.pick) for r in got} == want


def test_awkward_rows(spark):
    schema = "g int, k long, x double, y double, z double, score double, support double, _taken string"
    rows = [(1, None, 0.0, 0.0, 0.0, 1.0, 1.0, "a"), (1, 1, None, 0.0, 0.0, 1.0, 1.0, "a"), (1, 2, 0.0, 0.0, 0.0, None, 1.0, "a"), (1, 3, 0.0, 0.0, 0.0, 1.0, 1.0, "a"), (None, 4, 0.0, 0.0, 0.0, -1.0, 1.0, "a")]
    df = spark.createDataFrame(rows, schema)
    assert [(r.g, r.k) for r in clusters.seeds(df, ["g"], "k", "xyz", "score", 3, 1.0).collect()] == [(1, 3)]
    assert [(r.g, r.k) for r in clusters.best_cluster(df, ["g"], "k", "xyz", "score", "support").collect()] == [(1, 3)]
    none = df.limit(0)
    assert clusters.seeds(none, ["g"], "k", "xyz", "score", 3, 1.0).count() == 0
    assert clusters.roles(none, ["g"], "k", "xyz", "score", "support").count() == 0
    assert clusters.diverse_sample(none, ["g"], "k", "x", "y", ["z"], None, 3).count() == 0


def test_structure_rules(spark):
    from ravelin.operators import scoring

    high = [(0, float(v)) for v in np.linspace(60, 99, 20)]
    low = [(1, float(v)) for v in np.linspace(5, 40, 20)]
    got = scoring.confidence(spark.createDataFrame(high + low + [(2, None), (2, 90.0)], "g int, b double"), ["g"], "b", "c").collect()
    for r in got:
        assert r.c == (pytest.approx(min(1.0, max(0.0, (r.b - 50) / 40))) if r.g == 0 else 1.0)


def test_side_inputs(spark, tmp_path):
    from ravelin.sources import text

    (tmp_path / "row.tsv").write_text("1.5\t0\t2\n")
    cells = text.shaped_matrix(spark, str(tmp_path / "row.tsv"), 3, 1).collect()
    assert {(r.i, r.j, r.score) for r in cells} == {(1, 1, 1.5), (3, 1, 2.0)}
    with pytest.raises(Exception, match="shape"):
        text.shaped_matrix(spark, str(tmp_path / "row.tsv"), 2, 2).collect()
    (tmp_path / "p.tsv").write_text("index\tvalue\n1\t0.5\n2\tNA\n")
    assert {tuple(r) for r in text.profile(spark, str(tmp_path / "p.tsv"), "index", "value", 2).collect()} == {(1, 0.5), (2, 0.0)}
    with pytest.raises(Exception, match="position 3"):
        text.profile(spark, str(tmp_path / "p.tsv"), "index", "value", 3).collect()
    assert text.optional_json(spark, str(tmp_path / "none.json"), "a long").count() == 0
    (tmp_path / "some.json").write_text('{"a":\n 4}')
    assert text.optional_json(spark, str(tmp_path / "some.json"), "a long").first().a == 4
