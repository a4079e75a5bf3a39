import hashlib
import zlib
from collections import Counter, defaultdict

import pandas as pd
import pytest
from ravelin.llm import mixing, sharding

from .conftest import rows

DATA = "/root/testdata/sf0.001"


def brute_shards(docs: pd.DataFrame, shards: int, seed: int) -> dict:
    crc = {r.doc_id: zlib.crc32((r.text or "").encode()) for r in docs.itertuples()}
    mix = {i: hashlib.md5(f"{seed}|{i}|{c}".encode()).hexdigest() for i, c in crc.items()}
    fractions = []
    for source, group in docs.groupby("source"):
        order = sorted(group.doc_id, key=lambda i: mix[i])
        fractions += [((r + 0.5) / len(order), f"s{source}", mix[i], i) for r, i in enumerate(order)]
    out, n = {}, len(docs)
    sizes = [n // shards + (k < n % shards) for k in range(shards)]
    starts = [sum(sizes[:k]) for k in range(shards + 1)]
    for at, (_, _, _, i) in enumerate(sorted(fractions)):
        shard = next(k for k in range(shards) if at < starts[k + 1])
        out[i] = (shard, at - starts[shard])
    return out


def test_shards_match_brute_force(spark):
    path = f"{DATA}/documents.parquet"
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(spark.read.parquet(path), 7).collect()}
    assert got == brute_shards(pd.read_parquet(path), 7, 7)


def test_shards_hold_the_mixture_and_gapless_slots(docs):
    data = [(i, "t" * (i % 7), "en", "hot" if i % 3 == 0 else f"s{i % 5}", 0, *"xyzkf") for i in range(400)]
    got = sharding.shard(docs(data), 8).collect()
    sizes, slots, mixture = Counter(), defaultdict(set), defaultdict(Counter)
    for r in got:
        sizes[r.shard] += 1
        slots[r.shard].add(r.slot)
        mixture[r.source][r.shard] += 1
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(s == set(range(sizes[k])) for k, s in slots.items())
    assert all(max(m.values()) - min(m[k] for k in range(8)) <= 2 for m in mixture.values())


def test_awkward_rows_are_all_placed(awkward, empty):
    got = sharding.shard(awkward, 40).collect()
    assert len(got) == 15 and sorted(r.shard for r in got) == list(range(15))
    assert {r.size for r in got if r.doc_id == 0} == {16} and {r.text_crc32 for r in got if r.doc_id == 0} == {0}
    assert sharding.shard(empty, 40).count() == 0


def fill(sizes: dict, share=1.5, most=2.0) -> dict:
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        per = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if per * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: per * weight[s] for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "c": 300, None: 50}, {"a": 1}, {"a": 5, "b": 5, "c": 5, "d": 1000}])
def test_targets_fill_like_water(docs, sizes):
    data = []
    for s, n in sizes.items():
        data += [(len(data), "w " * n, "en", s, 0, *"xyzkf")]
    got = {r.source: r.target for r in mixing.plan(docs(data)).collect()}
    assert got == pytest.approx(fill(sizes))


def test_copies_follow_the_offset_and_stay_near_the_target(docs):
    data = [(i, "w " * (i * i % 97), "en", "hot" if i % 3 == 0 else f"s{i % 4}", 0, *"xyzkf") for i in range(900)]
    plan = mixing.plan(docs(data)).collect()
    assert sorted(map(tuple, plan)) == sorted(map(tuple, mixing.plan(docs(data)).collect()))
    taken, longest, target = Counter(), Counter(), {}
    for r in plan:
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r["size"])
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in target)
    mixed = Counter(r.doc_id for r in mixing.mix(docs(data)).collect())
    assert mixed == Counter({r.doc_id: r.copies for r in plan if r.copies})


def test_mixing_awkward_rows(awkward, empty):
    plan = mixing.plan(awkward).collect()
    assert len(plan) == 15 and all(r["size"] == 0 for r in plan if r.doc_id in (0, 1, 2))
    assert mixing.mix(awkward).columns == awkward.columns
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert rows("a")[0][1] == "a"
