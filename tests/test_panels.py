"""Panels over overlapping subsets against plain Python, long ties, missing scores, and empty tables."""

import math
import random

import pytest
from pyspark.sql import functions as F
from ravelin.operators import panels

SCHEMA = "g string, i int, s double, y int, a boolean, rank string, subset string"


def table(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.choice([None, float("nan"), 0.0, 1.2, -0.3, *[k / 7 for k in range(7)]]) if rng.random() < 0.9 else rng.random()
        rows.append((rng.choice(["p", "q", "r", None]), i, s, rng.choice([0, 0, 1, None, 2]), rng.choice([True, False, None]), "x", "y"))
    return rows


def plain_curves(rows, cut):
    known = [(s, y) for _, _, s, y, *_ in rows if y in (0, 1)]
    if not known:
        return None
    there = [(s, y) for s, y in known if s is not None and not math.isnan(s)]
    pos, neg = [s for s, y in there if y], [s for s, y in there if not y]
    roc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None
    line = sorted(there, key=lambda r: (-r[0], r[1]))
    hit, total = 0, 0.0
    for k, (_, y) in enumerate(line, 1):
        hit += y
        total += hit / k if y else 0
    block = sum(sum(b >= a for b in pos) / sum(b >= a for b, _ in there) for a in pos)
    best = max(((2 * sum(b >= t for b in pos) / (sum(b >= t for b, _ in there) + len(pos)), t) for t, _ in there), default=None) if pos else None
    clip = [(min(1.0, max(0.0, s)), y) for s, y in there]
    tp, fp = sum(s >= cut for s in pos), sum(s >= cut for s in neg)
    near = lambda v: None if v is None else round(v, 9)
    return (len(known), sum(y for _, y in known), len(there), near(roc), near(total / len(pos)) if pos else None, near(block / len(pos)) if pos else None, near(best and best[0]), best and best[1], near(sum((s - y) ** 2 for s, y in clip) / len(clip)) if clip else None, tp, fp, len(pos) - tp, len(neg) - fp)


SUBSETS = {"all": lambda r: True, "some": lambda r: bool(r[4]), "p": lambda r: r[0] == "p", "none": lambda r: False}


def rules():
    return {"all": F.lit(True), "some": F.col("a"), "p": F.col("g") == "p", "none": F.lit(False)}


@pytest.mark.parametrize("n", [3, 60, 400])
def test_curves(spark, n):
    rows = table(n, n)
    got = {r.subset: r for r in panels.curves(spark.createDataFrame(rows, SCHEMA), rules(), "s", "y", 0.4).collect()}
    near = lambda v: None if v is None else round(v, 9)
    for name, rule in SUBSETS.items():
        want = plain_curves([r for r in rows if rule(r)], 0.4)
        assert (name in got) == (want is not None)
        if want:
            r = got[name]
            assert (r.rows, r.positives, r.scored, near(r.roc_auc), near(r.ap_conservative), near(r.ap_block), near(r.best_f1), r.threshold, near(r.brier), r.tp, r.fp, r.fn, r.tn) == want


def test_a_tie_of_very_many_rows_needs_no_list(spark):
    """A million rows of one score: their share of the average precision has a closed form."""
    n, p = 1_000_000, 300_000
    df = spark.range(n).select(F.lit(0.5).alias("s"), (F.col("id") < p).cast("int").alias("y"))
    r = panels.curves(df, {"all": F.lit(True)}, "s", "y").first()
    want = sum(i / (n - p + i) for i in range(1, p + 1)) / p
    assert math.isclose(r.ap_conservative, want, rel_tol=1e-10) and r.ap_block == p / n and r.roc_auc == 0.5
    for k in (0, 1, 5, 31, 32, 33, 1000):
        assert math.isclose(spark.range(1).select(panels.harmonic(F.lit(k)).alias("h")).first().h, sum(1 / i for i in range(1, k + 1)), rel_tol=1e-12)


def test_top_k_and_budgets(spark):
    rows = [r for r in table(5, 300) if r[3] in (0, 1, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    sizes = {"two": F.lit(2), "fifth": F.col("n") / 5}
    got = {(r.subset, r["size"]): r for r in panels.top_k(df.where("s IS NOT NULL OR g = 'p'"), rules(), ["g"], "s", "y", ["i"], sizes).collect()}
    for name, rule in SUBSETS.items():
        groups = {}
        for r in rows:
            if rule(r) and (r[2] is not None or r[0] == "p"):
                groups.setdefault(r[0], []).append(r)
        if not groups:
            assert (name, "two") not in got
            continue
        bad = {g for g, rs in groups.items() if any(r[2] is None or math.isnan(r[2]) for r in rs)}
        good = {g: sorted(rs, key=lambda r: (-r[2], r[1])) for g, rs in groups.items() if g not in bad and any(r[3] == 1 for r in rs)}
        for size in sizes:
            r = got[name, size]
            assert (r.groups, r.evaluated, r.missing_score) == (len(groups), len(good), sum(any(x[3] == 1 for x in groups[g]) for g in bad))
            ks = {g: max(1, min(len(rs), 2 if size == "two" else math.ceil(len(rs) / 5))) for g, rs in good.items()}
            hits = {g: sum(x[3] == 1 for x in rs[: ks[g]]) for g, rs in good.items()}
            if good:
                assert math.isclose(r.precision, sum(hits[g] / ks[g] for g in good) / len(good), abs_tol=1e-9)
                assert math.isclose(r.recall, sum(hits[g] / sum(x[3] == 1 for x in rs) for g, rs in good.items()) / len(good), abs_tol=1e-9)
            else:
                assert r.precision is None
    out = {(r.subset, r.universe, r.budget): r for r in panels.budgets(df, rules(), {"whole": F.lit(True), "late": F.col("i") > 200}, ["g"], ["s"], "y", ["i"], {"three": F.lit(3), "true": F.col("positives")}).collect()}
    for name, rule in SUBSETS.items():
        groups = {}
        for r in rows:
            if rule(r):
                groups.setdefault(r[0], []).append(r)
        groups = {g: rs for g, rs in groups.items() if any(r[3] == 1 for r in rs)}
        for universe, inside in (("whole", lambda r: True), ("late", lambda r: r[1] > 200)):
            for budget in ("three", "true"):
                tp = selected = 0
                for rs in groups.values():
                    part = sorted((r for r in rs if inside(r)), key=lambda r: (r[2] is None or math.isnan(r[2]), -(r[2] if r[2] is not None and not math.isnan(r[2]) else 0), r[1]))
                    k = min(len(part), 3 if budget == "three" else sum(r[3] == 1 for r in rs))
                    tp, selected = tp + sum(r[3] == 1 for r in part[:k]), selected + k
                if groups:
                    r = out[name, universe, budget]
                    assert (r.groups, r.tp, r.selected, r.fp) == (len(groups), tp, selected, selected - tp)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert panels.curves(none, rules(), "s", "y").count() == 0
    assert panels.top_k(none, rules(), ["g"], "s", "y", ["i"], {"one": F.lit(1)}).count() == 0
    assert panels.budgets(none, rules(), {"whole": F.lit(True)}, ["g"], ["s"], "y", ["i"], {"one": F.lit(1)}).count() == 0
