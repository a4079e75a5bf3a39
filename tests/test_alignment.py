"""Wavefront kernels against loops over cells, and pruning in rounds against the greedy choice itself."""

import random
import time

import numpy as np
import pytest
from ravelin.operators import alignment


def plain_affine(a, b, match=1.0, mismatch=0.0, begin=-1.0, extend=-0.5):
    """(score, matches) cell by cell."""
    lost = (float("-inf"), 0)
    add = lambda s, score, hit=0: (s[0] + score, s[1] + hit)
    diagonal = [(0.0, 0)] + [lost] * len(b)
    right = [lost] + [(begin + extend * j, 0) for j in range(len(b))]
    down = [lost] * (len(b) + 1)
    for i, p in enumerate(a):
        d, r, v = [lost], [lost], [(begin + extend * i, 0)]
        for j, q in enumerate(b):
            d.append(add(max(diagonal[j], right[j], down[j]), match if p == q else mismatch, int(p == q)))
            v.append(max(add(max(diagonal[j + 1], right[j + 1]), begin), add(down[j + 1], extend)))
            r.append(max(add(max(d[j], v[j]), begin), add(r[j], extend)))
        diagonal, right, down = d, r, v
    return max(diagonal[-1], right[-1], down[-1])


def plain_linear(a, b, match=2, mismatch=-1, gap=-2):
    n, m = len(a), len(b)
    s = [[gap * (i + j) if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            s[i][j] = max(s[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), s[i - 1][j] + gap, s[i][j - 1] + gap)
    i, j, matches, aligned, places = n, m, 0, 0, [0] * n
    while i and j:
        same = a[i - 1] == b[j - 1]
        if s[i][j] == s[i - 1][j - 1] + (match if same else mismatch):
            i, j = i - 1, j - 1
            matches, aligned, places[i] = matches + same, aligned + 1, j + 1
        elif s[i][j] == s[i - 1][j] + gap:
            i -= 1
        else:
            j -= 1
    return s[n][m], matches, aligned, places


def pairs(seed, count, longest, letters="ACDE"):
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(longest)))
        b = "".join(c for c in a if rng.random() > 0.2) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.randrange(longest)))
        out.append((a, b))
    return [("", ""), ("A", ""), ("", "A"), ("A", "A"), ("A", "C"), ("é😀", "é😀x"), *out]


@pytest.mark.parametrize("seed", range(3))
def test_wavefronts_equal_loops_over_cells(seed):
    a, b = zip(*pairs(seed, 120, 40), strict=True)
    assert alignment.linear_alignments(a, b) == [plain_linear(p, q) for p, q in zip(a, b, strict=True)]
    want = [plain_affine(p, q)[1] for p, q in zip(a, b, strict=True)]
    assert alignment.affine_matches(a, b).tolist() == want
    other = {"match": 2.0, "mismatch": -1.5, "begin": -3.0, "extend": -0.5}
    assert alignment.affine_matches(a, b, **other).tolist() == [plain_affine(p, q, **other)[1] for p, q in zip(a, b, strict=True)]
    for threshold in (0.0, 40.0, 75.0, 99.9, 100.0):
        identity = [0.0 if not p or not q else 100.0 * w / max(len(p), len(q)) for p, q, w in zip(a, b, want, strict=True)]
        assert alignment.alike(a, b, threshold).tolist() == [i > threshold for i in identity]
        assert np.allclose(alignment.affine_identities(a, b), identity)


def test_pairs_are_given_up_only_when_they_cannot_reach(monkeypatch):
    monkeypatch.setattr(alignment, "_LOOK", 2)
    a, b = zip(*pairs(9, 150, 60), strict=True)
    want = np.array([plain_affine(p, q)[1] for p, q in zip(a, b, strict=True)])
    for share in (0.3, 0.6, 0.9):
        need = np.array([share * max(len(p), len(q)) for p, q in zip(a, b, strict=True)])
        assert (alignment.affine_matches(a, b, need) == np.where(want >= need, want, -1)).all()


def test_twenty_times_faster_on_long_pairs():
    rng = random.Random(1)
    make = lambda: "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(500))
    a, b = [make() for _ in range(64)], [make() for _ in range(64)]
    began = time.perf_counter()
    got = alignment.affine_matches(a, b)
    fast = (time.perf_counter() - began) / 64
    began = time.perf_counter()
    assert plain_affine(a[0], b[0])[1] == got[0]
    assert (time.perf_counter() - began) / fast >= 20


def greedy(rows, threshold):
    """Kept rows of (g, n, a, b, sa, sb), group by group in order."""
    kept = []
    same = lambda x, y: bool(x) and bool(y) and 100.0 * plain_affine(x, y)[1] / max(len(x), len(y)) > threshold
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2], r[3], r[4] or "", r[5] or "")):
        if not any(k[0] == r[0] and ((same(r[4], k[4]) and same(r[5], k[5])) or (same(r[4], k[5]) and same(r[5], k[4]))) for k in kept):
            kept.append(r)
    return sorted((r[:4] for r in kept), key=str)


@pytest.mark.parametrize(("threshold", "block"), [(70.0, 2048), (70.0, 3), (40.0, 5), (100.0, 2048), (90.0, 2)])
def test_pruning_is_the_greedy_choice(spark, monkeypatch, threshold, block):
    rng = random.Random(int(threshold) + block)
    base = ["".join(rng.choice("ACDE") for _ in range(rng.randrange(3, 25))) for _ in range(6)]

    def near(s):
        return "".join(c if rng.random() > 0.1 else rng.choice("ACDE") for c in s if rng.random() > 0.05)

    rows = [(rng.choice(["g", "h", None]), i // 2, f"a{i}", f"b{i}", near(rng.choice(base)), near(rng.choice(base))) for i in range(90)]
    rows += [("g", 200 + i, "x", "y", None if i % 2 else "", "ACD") for i in range(4)] + [("g", 300, "t", "t", *rows[0][4:])] * 2
    real = alignment.alike_pairs
    monkeypatch.setattr(alignment, "alike_pairs", lambda s, t: real(s, t, block))
    df = spark.createDataFrame(rows, "g string, n int, a string, b string, sa string, sb string")
    got = sorted((tuple(r) for r in alignment.prune_redundant(df, "g", "n", "a", "b", "sa", "sb", threshold).collect()), key=str)
    assert got == greedy(rows, threshold)
    assert alignment.prune_redundant(df.limit(0), "g", "n", "a", "b", "sa", "sb", threshold).count() == 0


def test_registered_queries_by_loops_over_cells(spark):
    import pandas as pd
    from ravelin.plans import catalogue

    folder = "/root/testdata/sf0.001"
    parts = pd.read_parquet(f"{folder}/part.parquet")
    rows = [(r.p_brand, r.p_partkey, r.p_name, r.p_type, r.p_name, r.p_type) for r in parts.itertuples()]
    got = sorted((tuple(r) for r in catalogue.QUERIES["redundancy_pruned"](spark, folder).collect()), key=str)
    assert got == greedy(rows, 90.0)
    found = {(r.a, r.b): (r.score, r.matches, r.aligned, r.identity) for r in catalogue.QUERIES["needleman"](spark, folder).collect()}
    want = {(a, b): (*plain_linear(a, b)[:3], round(100.0 * plain_affine(a, b)[1] / max(len(a), len(b)), 6)) for a, b in {(r[2], r[3]) for r in rows}}
    assert found == want


def test_chains_by_plain_python(spark):
    rows = {
        "bound": [("k", "A", 1, "ACDEFGHIKL"), ("k", "B", 2, "MNPQRSTVWY"), ("k", "C", 3, None), ("k", "D", 4, "ACDEF"), ("lone", "A", 1, "ACD"), ("one", "Z", 1, "ACDEFGHIKL")],
        "free": [("k", "B", 1, "ACDEFGHIKL"), ("k", "X", 2, "MNPQRSTVW"), ("k", "A", 3, "ACDEFGHIKL"), ("k", "Y", 4, ""), ("one", "Q", 7, "ACDEFGHIKV")],
    }
    dfs = [spark.createDataFrame(r, "g string, c string, n int, q string") for r in rows.values()]
    got = {(r.case, r.chain): (r.best, r.matched, r.reason, r.fallback) for r in alignment.match_chains(*dfs, "g", "c", "n", "q", lead=0.05).collect()}
    assert got == {
        ("k", "A"): ("B", None, "ambiguous", "A"),
        ("k", "B"): ("X", "X", "accepted", "B"),
        ("k", "C"): ("B", None, "missing_sequence,low_coverage_bound,low_coverage_free", "A"),
        ("k", "D"): ("B", None, "low_identity,low_coverage_free,ambiguous", "Y"),
        ("lone", "A"): (None, None, "no_candidates", None),
        ("one", "Z"): ("Q", "Q", "accepted", "Q"),
    }


def chains(bound, free):
    """(best, identity, both coverages, second) of each (case, chain) from all pairs."""
    first = lambda x: (x is not None, x or 0)
    out = {}
    for g, c in {r[:2] for r in bound}:
        found = []
        for s in (r[3] for r in bound if r[:2] == (g, c)):
            for _, other, place, t in (r for r in free if r[0] == g):
                m = plain_affine(s, t)[1] if s and t else None
                worth = (m / max(len(s), len(t)), m / len(s), m / len(t)) if m is not None else (-1, -1, -1)
                found.append(([-w for w in worth], first(place), first(other), other, worth))
        found.sort(key=lambda f: f[:3])
        told = lambda w: None if w < 0 else round(w, 9)
        out[g, c] = (found[0][3], *map(told, found[0][4]), told(found[1][4][0]) if len(found) > 1 else None) if found else (None,) * 5
    return out


@pytest.mark.parametrize(("seed", "blocks"), [(1, (2048, 8192, 512)), (2, (3, 4, 2)), (3, (5, 2, 5))])
def test_best_chains_are_those_of_all_pairs(spark, monkeypatch, seed, blocks):
    for name, size in zip(("BOUND", "FREE", "ROWS"), blocks, strict=True):
        monkeypatch.setattr(alignment, name, size)
    monkeypatch.setattr(alignment, "TRIES", (2, 3))
    rng = random.Random(seed)
    texts = ["", None, *("".join(rng.choice("ACD") for _ in range(rng.choice((1, 4, 6, 70)))) for _ in range(12)), "é😀A"]
    # Copies, equal places and names, several sequences of one name, and cases with sequences on one side only.
    row = lambda i: (rng.choice("gh"), rng.choice([f"c{i}", "same"]), rng.choice([None, i, i // 4]), rng.choice(texts))
    bound, free = [row(i) for i in range(40)], [row(i) for i in range(50)]
    bound += [("x", "a", 1, "ACD"), ("y", "a", 1, None), ("z", "a", 1, "ACD")]
    free += [("x", "p", 2, None), ("x", "q", 1, ""), ("y", "p", 2, "ACD"), ("y", "q", 1, "CD"), ("z", "p", 3, None), ("z", "q", 4, "AC")]
    dfs = [spark.createDataFrame(r, "g string, c string, n int, q string") for r in (bound, free)]
    told = lambda w: None if w is None else round(w, 9)
    got = {(r.case, r.chain): (r.best, told(r.identity), told(r.coverage_bound), told(r.coverage_free), told(r.second)) for r in alignment.match_chains(*dfs, "g", "c", "n", "q").collect()}
    assert got == chains(bound, free)


def test_few_of_the_pairs_of_chains_are_aligned(monkeypatch):
    rng = random.Random(4)
    a = ["".join(rng.choice("0123456789ABCDEF") for _ in range(32)) for _ in range(400)]
    aligned, real = [], alignment._matches
    monkeypatch.setattr(alignment, "_matches", lambda x, *more: aligned.append(x.shape[1]) or real(x, *more))
    b = [s[:12] + "XX" + s[14:] for s in a]
    best, m, _ = alignment.best_two(a, b, np.zeros(len(b), bool))
    assert best.tolist() == list(range(400)) and m.min() >= 30 and sum(aligned) < len(a) * len(b) / 2
    for p, q in ((a[0], b[1]), (a[2] * 3, b[3]), (a[4], b[5] * 4)):
        assert alignment.common_letters([p], [q])[0, 0] >= plain_affine(p, q)[1]


def test_chain_query_by_loops_over_cells(spark):
    from ravelin.plans import catalogue

    folder = "/root/testdata/sf0.001"
    for r in catalogue.QUERIES["chain_match"](spark, folder).collect():
        assert (r.matched is not None) == (r.reason == "accepted") == (r.status == "sure")
        assert r.identity is None or r.second is None or r.identity >= r.second
