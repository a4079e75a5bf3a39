"""SimHash near-duplicates, searched exactly with a vantage-point tree.

Fingerprints are distinct 64-bit numbers under Hamming distance. A tree fitted
on a bounded sample names a vantage fingerprint and a radius per node. Points
inside the radius go left; points outside, and those inside by less than the
search radius, go right: by the triangle inequality every pair within the
search radius then shares a leaf. Leaves are the shards; leaves that came out
large are compared as pairs of blocks. A shard prunes further by the same rule
and returns a spanning forest of its links, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.base import attach, components, keep_rows, keyed, settled, stage

WORDS, SEED, RADIUS = 3, 42, 3
#: Fingerprints that a shard should hold: SHARD, or SHARD_ROOT times the root of
#: their number if that is more, as each level of the tree copies the points near
#: its border and a shard of millions still fits a task. BASE: compared at once.
SHARD, SHARD_ROOT, BASE = 16_384, 64, 512
#: The tree is fitted on so many fingerprints per leaf, and on so many in all.
SAMPLE_PER_LEAF, SAMPLE = 64, 1 << 17

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(raw: bytes | None, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned fingerprint of a UTF-8 text; texts without words, and nulls, give 0."""
    tokens = raw.lower().split() if raw else []
    if not tokens:
        return 0
    text = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(text, seed)], np.uint64)
    else:
        ends = list(accumulate((len(t) + 1 for t in tokens)))
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(text[a : b - 1], seed) for a, b in zip([0, *ends], ends[words - 1 :], strict=False)], np.uint64)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for at in range(0, len(rb), 512):
                marks = np.array([fingerprint(t, words, seed) for t in rb.column(1).slice(at, 512).to_pylist()], np.uint64)
                keys = [c.slice(at, 512) for i, c in enumerate(rb.columns) if i != 1]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(marks.view(np.int64))], names=["doc_id", *rb.schema.names[2:], "fp"])

    return run


def _split(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """(vantage, inner radius) that halves `points` best, None if none does.

    The larger of both sides counts, with what stands in both.
    """
    best = None
    for vantage in rng.choice(points, min(8, len(points)), replace=False):
        at_least = np.bincount(np.bitwise_count(points ^ vantage), minlength=66)[::-1].cumsum()[::-1]
        mu = np.arange(65)
        worse = np.maximum(len(points) - at_least[mu + 1], at_least[np.maximum(mu - radius + 1, 0)])
        cost = int(worse.min())
        if best is None or cost < best[0]:
            best = cost, vantage, int(worse.argmin())
    return None if best is None or best[0] > 0.9 * len(points) else best[1:]


def build_tree(points: np.ndarray, leaf: int, radius: int = RADIUS, seed: int = 5) -> list:
    """Nodes as [vantage, inner radius, left, right]; leaves as their number. Root first."""
    rng, nodes, leaves = np.random.default_rng(seed), [None], 0
    todo = [(0, points)]
    while todo:
        at, mine = todo.pop()
        cut = _split(mine, radius, rng) if len(mine) > max(leaf, 8) else None
        if cut is None:
            nodes[at] = leaves
            leaves += 1
            continue
        d = np.bitwise_count(mine ^ cut[0])
        nodes[at] = [cut[0], cut[1], len(nodes), len(nodes) + 1]
        nodes += [None, None]
        todo += [(nodes[at][2], mine[d <= cut[1]]), (nodes[at][3], mine[d > cut[1] - radius])]
    return nodes


def route(nodes: list, points: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, positions of the points that it gets)."""
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, mine = todo.pop()
        node = nodes[at]
        if not isinstance(node, list):
            yield node, mine
            continue
        d = np.bitwise_count(points[mine] ^ node[0]).astype(np.int64)
        todo += [(to, part) for to, part in ((node[2], mine[d <= node[1]]), (node[3], mine[d > node[1] - radius])) if len(part)]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position linked with each of n positions."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def forest(points: np.ndarray, radius: int = RADIUS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Links (position, position) that join what lies within `radius`."""
    rng = np.random.default_rng(seed)
    found_a, found_b, todo = [], [], [np.arange(len(points))]
    while todo:
        mine = todo.pop()
        cut = _split(points[mine], radius, rng) if len(mine) > BASE else None
        if cut is not None:
            d = np.bitwise_count(points[mine] ^ cut[0]).astype(np.int64)
            todo += [mine[d <= cut[1]], mine[d > cut[1] - radius]]
            continue
        for at in range(0, len(mine), BASE):
            rows = mine[at : at + BASE]
            for to in range(at, len(mine), BASE):
                cols = mine[to : to + BASE]
                i, j = np.nonzero(np.bitwise_count(points[rows][:, None] ^ points[cols][None, :]) <= radius)
                ends = np.unique(np.concatenate([rows[i], cols[j]]))
                top = roots(len(ends), np.searchsorted(ends, rows[i]), np.searchsorted(ends, cols[j]))
                keep = top != np.arange(len(ends))
                found_a.append(ends[keep])
                found_b.append(ends[top[keep]])
    if not found_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    top = roots(len(points), np.concatenate(found_a), np.concatenate(found_b))
    child = np.flatnonzero(top != np.arange(len(points)))
    return child, top[child]


def _router(nodes, radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            fps = rb.column(0).to_numpy()
            for leaf, at in route(nodes.value, fps.view(np.uint64), radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), leaf, np.int32)), pa.array(fps[at])], names=["leaf", "fp"])

    return run


def _shard(radius: int):
    def run(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy()
        a, b = forest(fps.view(np.uint64), radius)
        return pa.table({"a": fps[a], "b": fps[b]})

    return run


def links(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): links between distinct `fp` within `radius`, enough to join all that are joined."""
    spark = prints.sparkSession
    count = prints.count()
    shard = max(shard, SHARD_ROOT * isqrt(count))
    leaves = max(1, count // shard)
    size = min(SAMPLE, max(4096, SAMPLE_PER_LEAF * leaves))
    sample = [r["fp"] for r in prints.orderBy(F.xxhash64("fp", F.lit(1)), "fp").limit(size).select("fp").collect()]  # at most SAMPLE
    points = np.array(sample, np.int64).view(np.uint64)
    nodes = build_tree(points, max(8, len(points) * shard // max(count, 1)), radius)
    routed = stage(prints.select("fp").mapInArrow(_router(spark.sparkContext.broadcast(nodes), radius), "leaf int, fp long"), "routed")
    # A row per leaf, and the tree has at most SAMPLE leaves.
    sizes = F.broadcast(routed.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(4 * shard)).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("fp", F.lit(2)), F.col("blocks")).cast("int")
    dealt = routed.join(sizes, "leaf").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp")
    return dealt.groupBy("leaf", "i", "j").applyInArrow(_shard(radius), "a long, b long")


def find_groups(docs: DataFrame, words: int = WORDS, seed: int = SEED, radius: int = RADIUS, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, fp (signed 64-bit), component_id.

    Texts are linked when their fingerprints differ in at most `radius` bits;
    component_id is the smallest doc_id reachable by links. Texts without a
    word, and nulls, have fingerprint 0 and link like any other. Rows with a
    null id take part in links and never give a component its id unless all
    its ids are null. Repeated rows have equal results. An empty table gives
    no rows; other columns are not read. If `row_col` (a long that tells rows
    apart) is named, it comes too, and with it `kept`: true for one row of each
    component, that with the smallest id, null ids last, then the smallest key.
    """
    row = [row_col] if row_col else []
    kinds = ", ".join(["doc_id long", *[f"{c} long" for c in row], "fp long"])
    rows = stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary"), *row).mapInArrow(_fingerprints(words, seed), kinds), "fingerprints")
    best = [F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(c).alias("row"))).alias("_best") for c in row]
    prints = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), *best), "prints")
    joined = stage(components(links(prints, radius, shard), "a", "b"), "fp-components").withColumnRenamed("node", "fp")
    known = attach(prints, joined, ["fp"]).withColumn("component", F.coalesce("component", "fp"))
    smallest = stage(known.groupBy("component").agg(F.min("first").alias("component_id"), F.sum("n").alias("size"), *[F.min("_best")["row"].alias("_keep") for _ in row]).where("size > 1").drop("size"), "fp-smallest")
    named = stage(attach(known, smallest, ["component"], "inner").select("fp", "component_id", *["_keep" for _ in row]), "fp-named")
    alone = F.col("_found").isNull()
    kept = [(alone | (F.col(c) == F.col("_keep"))).alias("kept") for c in row]
    return attach(rows, named.withColumn("_found", F.lit(1)), ["fp"]).select("doc_id", "fp", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *row, *kept)


def dedup(docs: DataFrame, **options) -> DataFrame:
    """One row of each component: that with the smallest id; one with a null id only if no id of the component is known."""
    rows, key = keyed(docs, "near-rows")
    gone = settled(lambda: find_groups(rows, row_col=key, **options).where("NOT kept").select(F.col(key).alias("_id")), "near-gone")
    return keep_rows(rows, gone, "left_anti", key).drop(key)
