"""Centroid clustering over bit planes: exact integer k-means by AND and popcount.

A vector's 64 integer components in two's complement are kept as one uint64 per
bit: bit j of plane i is bit i of component j. A product of two vectors is then
the sum over pairs of planes of 2**(i+j) times the number of ones that the two
planes share, the top plane counting negative. Distances follow from products,
and a cluster's sums from the number of its vectors with each bit set, so the
planes are all that is stored and read in a round. A task returns one row per
cluster and component, and so many reach the driver in a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.base import stage

#: Components of a vector, which fill a word; clusters, rounds, and what a component is multiplied by.
WIDTH, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Most planes: with more, a distance may not fit in a long.
MOST_PLANES = 28
#: Vectors whose planes are compared at once.
TILE = 4096


def planes_of(q: np.ndarray, planes: int) -> np.ndarray:
    """(n, 64) integers as (n, planes) words of 64 bits."""
    bits = (q[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8")[:, :, 0]


def weights(planes: int) -> np.ndarray:
    """What a one in each plane counts; the top plane holds the sign."""
    w = np.int64(1) << np.arange(planes, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(n, k) exact products of the vectors of `x` and `y`, given as planes."""
    w = weights(x.shape[1])
    out = np.zeros((len(x), len(y)), np.int64)
    for i, wi in enumerate(w):
        for j, wj in enumerate(w):
            out += wi * wj * np.bitwise_count(x[:, i, None] & y[None, :, j]).astype(np.int64)
    return out


def squares(x: np.ndarray) -> np.ndarray:
    """Exact squared length of each vector of `x`, given as planes."""
    w = weights(x.shape[1])
    ones = np.bitwise_count(x[:, :, None] & x[:, None, :]).astype(np.int64)
    return (ones * (w[:, None] * w[None, :])).sum((1, 2))


def totals(x: np.ndarray) -> np.ndarray:
    """Componentwise sums of the vectors of `x`, given as planes."""
    bits = np.unpackbits(np.ascontiguousarray(x, "<u8").view(np.uint8), axis=1, bitorder="little")
    return weights(x.shape[1]) @ bits.sum(0, dtype=np.int64).reshape(x.shape[1], WIDTH)


def _numbers(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return np.asarray(column.flatten()).astype(kind, copy=False).reshape(len(column), width)


def _packer(planes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for at in range(0, len(rb), TILE):
                part = rb.slice(at, TILE)
                x = planes_of(_numbers(part.column("q"), WIDTH, np.int64), planes)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * planes), pa.array(x.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), rows, pa.array(squares(x))], names=["vec_id", "planes", "square"])

    return run


def _nearest(batches: Iterator[pa.RecordBatch], centres: np.ndarray, planes: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Tiles of rows with their planes, nearest centroid and squared distance to it."""
    c = planes_of(centres, planes)
    size = squares(c)
    for rb in batches:
        for at in range(0, len(rb), TILE):
            part = rb.slice(at, TILE)
            x = _numbers(part.column("planes"), planes, np.int64).view(np.uint64)
            apart = np.asarray(part.column("square"))[:, None] - 2 * products(x, c) + size[None, :]
            home = apart.argmin(1)  # the first of equals
            yield part, x, home, apart[np.arange(len(x)), home]


def _sums(centres: np.ndarray, planes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(len(centres), np.int64), np.zeros((len(centres), WIDTH), np.int64)
        for _, x, home, _ in _nearest(batches, centres, planes):
            for c in np.unique(home):
                mine = x[home == c]
                count[c] += len(mine)
                sums[c] += totals(mine)
        full = np.flatnonzero(count)
        number, place = np.repeat(full, WIDTH), np.tile(np.arange(WIDTH), len(full))
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(place, pa.int32()), pa.array(count[number]), pa.array(sums[full].reshape(-1))], names=["cluster", "component", "n", "total"])

    return run


def _homes(centres: np.ndarray, planes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, home, apart in _nearest(batches, centres, planes):
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(home, pa.int32()), pa.array(apart)], names=["vec_id", "cluster", "distance"])

    return run


def _moved(table: DataFrame, centres: np.ndarray, planes: int) -> np.ndarray:
    """Each centroid replaced by the floor of its vectors' mean; those without vectors stay."""
    parts = table.mapInArrow(_sums(centres, planes), "cluster int, component int, n long, total long")
    whole = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "total")]
    out = centres.copy()
    for row in parts.groupBy("cluster", "component").agg(*whole).collect():  # a row per cluster and component
        out[row["cluster"], row["component"]] = int(row["total"]) // int(row["n"])
    return out


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors of exactly 64 components, none null or non-finite, are kept, others
    give no row; a component x counts as floor(scale * x), in double precision.
    Centroids begin as the `clusters` vectors of smallest SHA-256 of
    `seed:vec_id`, so with fewer vectors there are fewer; of rows that share an
    id the smallest vector comes first, and rows with a null id come last. Ties
    between centroids go to the smaller number. Repeated rows are clustered
    each for itself. Rounds end early only when no centroid moves, as later
    ones would then change nothing. An empty table, or one that keeps no
    vector, gives no rows; other columns, whatever they are called, are not
    read. Integers of 2**27 or more, whose distances may not fit in a long,
    raise ValueError.
    """
    x = F.col(vector_col).cast("array<double>")
    sound = (F.size(x) == WIDTH) & F.forall(x, lambda v: F.coalesce((v - v) == 0, F.lit(False)))
    kept = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * F.lit(float(scale)))).alias("q"))
    reach = kept.agg(F.min(F.array_min("q")).alias("low"), F.max(F.array_max("q")).alias("high")).first()
    low, high = (0, 0) if reach["low"] is None else (reach["low"], reach["high"])
    planes = max(low if low >= 0 else ~low, high if high >= 0 else ~high).bit_length() + 1
    if planes > MOST_PLANES:
        raise ValueError(f"components from {low} to {high} need {planes} bit planes; distances are exact up to {MOST_PLANES}")
    mix = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = kept.orderBy(mix.asc_nulls_last(), "q").limit(clusters).select("q").collect()  # a row per cluster
    centres = np.array([r["q"] for r in first], np.int64).reshape(len(first), WIDTH)
    table = stage(kept.mapInArrow(_packer(planes), "vec_id long, planes array<long>, square long"), "planes")
    for _ in range(rounds if first else 0):
        before, centres = centres, _moved(table, centres, planes)
        if (before == centres).all():
            break
    homes = stage(table.mapInArrow(_homes(centres, planes), "vec_id long, cluster int, distance long"), "homes")
    inertia = {r["cluster"]: int(r["s"]) for r in homes.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    number = F.col("cluster") + 1
    own = F.array(*[F.lit(inertia.get(c, 0)).cast("long") for c in range(len(centres))]).cast("array<long>")
    name = F.array(*[F.lit(d) for d in digests]).cast("array<string>")
    return homes.select("vec_id", "cluster", "distance", F.element_at(own, number).alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), F.element_at(name, number).alias("centroid_sha256"))
