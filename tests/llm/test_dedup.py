import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from ravelin.llm import embedding_dedup, exact_dedup, simhash

from .conftest import rows

SPACE = re.compile("[\x20\x09-\x0d]+")


def classes(keys, linked):
    """Smallest key reachable by links, by brute force."""
    root = {k: k for k in keys}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in keys:
        for b in keys:
            if a < b and linked(a, b):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {k: top(k) for k in keys}


@given(st.binary(max_size=40).map(lambda b: b.replace(b"\x00", b" ")) | st.text(" \t\nab\x0b", max_size=30).map(str.encode))
def test_white_space_is_normalised_as_the_pattern_says(raw):
    assert exact_dedup.normalise(raw) == re.sub(rb"[\x20\x09-\x0d]+", b" ", raw)


def test_chunks_cover_a_text_and_follow_its_content():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 300_000, dtype=np.uint8).tobytes()
    ends = exact_dedup.chunk_ends(data)
    assert ends[-1] == len(data) and ends == sorted(set(ends))
    sizes = np.diff([0, *ends])
    assert (sizes[:-1] >= exact_dedup.MIN_CHUNK).all() and sizes.max() <= exact_dedup.MAX_CHUNK
    parts = lambda d, e: {d[a:b] for a, b in zip([0, *e], e, strict=False)}
    shifted = b"something before " + data
    assert len(parts(data, ends) & parts(shifted, exact_dedup.chunk_ends(shifted))) > 0.8 * len(ends)
    assert exact_dedup.chunk_ends(b"") == [0]


def brute_copies(data):
    norm = {i: SPACE.sub(" ", r[1] or "") for i, r in enumerate(data)}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    out = []
    for i, r in enumerate(data):
        ids = [data[j][0] for j in groups[norm[i]]]
        known = [k for k in ids if k is not None]
        out.append((r[0], min(known) if known else None, len(ids), hashlib.sha256(norm[i].encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 3])
def test_copies_match_brute_force_also_when_hashes_clash(awkward, bits):
    got = exact_dedup.find_copies(awkward, hash_bits=bits).collect()
    data = [tuple(r) for r in awkward.collect()]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute_copies(data)
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}


def test_dedup_keeps_one_row_of_each_text(awkward, empty):
    out = exact_dedup.dedup(awkward)
    assert out.columns == awkward.columns
    got = [SPACE.sub(" ", r.text or "") for r in out.collect()]
    assert len(got) == len(set(got)) == len({SPACE.sub(" ", r.text or "") for r in awkward.collect()})
    assert exact_dedup.dedup(empty).count() == 0


def brute_print(text, words=3):
    w = [x for x in SPACE.split((text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text("aAbÉé \n\x1c", max_size=40) | st.none())
def test_fingerprint_is_the_majority_of_shingle_bits(text):
    assert simhash.fingerprint(text.encode() if text is not None else None) == brute_print(text)


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 5))
def test_tree_and_forest_lose_no_link(seed, radius):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 900, dtype=np.uint64)
    near = base[:300].copy()
    for _ in range(radius):
        near ^= np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
    points = np.unique(np.concatenate([base, near]))
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= radius)
    truth = simhash.roots(len(points), i, j)
    a, b = simhash.forest(points, radius)
    assert (simhash.roots(len(points), a, b) == truth).all()
    nodes = simhash.build_tree(points[:400], 20, radius)
    assert sum(not isinstance(n, list) for n in nodes) > 2
    shards = [(points[at], at) for _, at in simhash.route(nodes, points, radius)]
    found = [(at[x], at[y]) for p, at in shards for x, y in [simhash.forest(p, radius)]]
    assert (simhash.roots(len(points), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) == truth).all()


def test_near_copies_match_brute_force(docs, awkward):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(50)]
    data = []
    for i in range(40):
        base = list(rng.choice(words, 60))
        data.append(" ".join(base))
        if i % 2:
            base[-1] = "changed"
            data.append(" ".join(base))
    data += ["", None, "one", "ONE", "two words"]
    df = docs(rows(*data))
    prints = {i: brute_print(t) for i, t in enumerate(data)}
    want = classes(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    got = simhash.find_groups(df, shard=8).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fp & (2**64 - 1) for r in got} == prints
    assert sorted(r.doc_id for r in simhash.dedup(df).collect()) == sorted(set(want.values()))
    odd = simhash.find_groups(awkward).collect()
    assert len(odd) == 15 and {r.component_id for r in odd if r.doc_id in (0, 1, 2)} == {0}


VECTORS = "vec_id long, embedding array<float>, label int, v string, m string, uid string, sound string"


def test_vectors_match_brute_force_over_many_cells(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    data = []
    for i in range(260):
        x = centres[i % 12] + rng.normal(size=8) * 0.25
        data.append((i, x.astype(np.float32).tolist(), i % 2, "a", "b", "c", "d"))
    data += [(300 + i, *data[i][1:]) for i in range(0, 30, 3)]
    odd = [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [float("inf")] * 8, [None] + [1.0] * 7]
    data += [(400 + i, v, 0, "a", "b", "c", "d") for i, v in enumerate(odd)] + [(500, data[0][1], None, "a", "b", "c", "d"), (501, [1.0, 2.0], 0, "a", "b", "c", "d")]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.find_groups(spark.createDataFrame(data, VECTORS), cell=16, block=32).collect()}
    sound = {r[0]: (r[2], np.array(r[1], float)) for r in data if r[0] < 400}

    def linked(a, b):
        (la, x), (lb, y) = sound[a], sound[b]
        return la == lb and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93

    want = classes(sorted(sound), linked)
    links = {a: sum(linked(a, b) for b in sound if b != a) for a in sound}
    assert sum(links.values()) > 500
    assert {k: v for k, v in got.items() if k < 400} == {k: (links[k], want[k], want[k] == k) for k in sound}
    assert all(got[k] == (0, k, True) for k in (*range(400, 406), 500, 501))
    assert embedding_dedup.find_groups(spark.createDataFrame([], VECTORS)).count() == 0


def planted(n, dims, seed):
    """Unit vectors and a partner of each at a cosine from 0.93 to 1."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=(n, dims))
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.9301, 1.0, (n, 1))
    return x, cosine * x + np.sqrt(1 - cosine**2) * side


@pytest.mark.parametrize("n", [2048, 8192, 32768])
def test_copies_are_bounded_and_partners_met_whatever_the_number_of_cells(n):
    x, y = planted(n, 64, n)
    both = np.concatenate([x, y])
    cells = embedding_dedup.fit_cells(both[:: max(1, len(both) // 8192)], n // 64)
    homes, masks = zip(*(embedding_dedup.visited(v @ cells.T, cells, 0.93, embedding_dedup.PROBES) for v in (x, y)), strict=True)
    assert max(m.sum(1).max() for m in masks) <= embedding_dedup.PROBES  # so rows that move grow with n alone
    at = np.arange(n)
    met = masks[0][at, homes[1]] | masks[1][at, homes[0]]
    assert met.mean() >= 0.99


def test_links_over_many_cells_in_64_dimensions(spark):
    x, y = planted(700, 64, 9)
    both = np.concatenate([x, y]).astype(np.float32)
    data = [(i, v.tolist(), 1, "a", "b", "c", "d") for i, v in enumerate(both)]
    df = spark.createDataFrame(data, VECTORS)
    v = both.astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = (v @ v.T >= 0.93) & ~np.eye(len(v), dtype=bool)
    assert near.sum() >= 1400
    for block in (4096, 16):
        got = {r.vec_id: r.n_links for r in embedding_dedup.find_groups(df, cell=24, block=block).collect()}
        found = np.array([got[i] for i in range(len(v))])
        assert (found <= near.sum(1)).all() and found.sum() >= 0.99 * near.sum()
    exact = {r.vec_id: r.n_links for r in embedding_dedup.find_groups(df, cell=24, block=64, probes=None).collect()}
    assert exact == dict(enumerate(near.sum(1)))
    few = {r.vec_id: r.n_links for r in embedding_dedup.find_groups(df, cell=400, block=64).collect()}
    assert few == exact  # four cells, all of which every vector visits
