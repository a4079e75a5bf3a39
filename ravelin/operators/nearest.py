"""Nearest neighbours in any number of dimensions, exact, by cells and blocked products.

Every vector goes to the cell of its nearest pivot, pivots being a bounded
sample. Its nearest neighbour within its own block of the cell bounds the true
distance from above; by the triangle inequality only cells whose ball reaches
within that bound can hold a nearer one, and it visits those alone. Cells meet
their visitors at stations of several blocks, so that a vector is moved once for
all the cells of a station that it visits, in its own precision. Blocks bound
what a task holds, however many vectors share a cell, and queries of a station
that many visit are dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.plans.staging import attach, shuffle_width, stage

#: Vectors of a block, queries that meet it in one task, and most pivots.
BLOCK, QUERIES, PIVOTS = 2048, 8192, 4096
#: Blocks of a station.
STATION = 16
#: Products of this many rows are held at a time.
ROWS = 512


def _array(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Approximate squared distances of all rows of `a` and `b`."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def closest(keys: np.ndarray, a: np.ndarray, names: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in `keys`, squared distance, name) of the nearest row of `b` with another name, ties to the smaller name.

    Products choose candidates with a margin for their rounding; those are
    measured again by differences, added in the order of the components.
    """
    at, best, who = [], [], []
    slack = 1e-9 * (1 + max((a * a).sum(1).max(initial=0), (b * b).sum(1).max(initial=0)))
    for start in range(0, len(a), ROWS):
        d = _squares(a[start : start + ROWS], b)
        d[keys[start : start + ROWS][:, None] == names[None, :]] = np.inf
        low = d.min(1, initial=np.inf)
        i, j = np.nonzero((d <= low[:, None] + slack) & np.isfinite(low)[:, None])
        exact = np.zeros(len(i))
        for c in range(a.shape[1]):
            exact += (a[start + i, c] - b[j, c]) ** 2
        order = np.lexsort([names[j], exact, i])
        first = order[np.unique(i[order], return_index=True)[1]]
        at.append(start + i[first])
        best.append(exact[first])
        who.append(names[j[first]])
    if not at:
        return np.empty(0, int), np.empty(0), np.empty(0, names.dtype)
    return np.concatenate(at), np.concatenate(best), np.concatenate(who)


def _assign(pivots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        for rb in batches:
            for at in range(0, len(rb), ROWS):
                part = rb.slice(at, ROWS)
                d = np.sqrt(_squares(_array(part.column(1)), p))
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(cell)), cell])], names=["key", "v", "cell", "d"])

    return run


def _own(table: pa.Table) -> pa.Table:
    keys, v = table.column("key").to_numpy(), _array(table.column("v"))
    at, d2, who = closest(keys, v, keys, v)
    bound, name = np.full(len(keys), np.inf), np.full(len(keys), -1)
    bound[at], name[at] = d2, who
    return pa.table({"key": keys, "v": table.column("v"), "d2": bound, "b": name, "own": table.column("cell")})


def _stations(blocks: np.ndarray) -> np.ndarray:
    """The station of each cell: cells in order, as many as have STATION blocks together, or one that has more."""
    out, at, full = [], 0, 0
    for k in blocks:
        if full and full + k > STATION:
            at, full = at + 1, 0
        full += k
        out.append(at)
    return np.array(out, np.int32)


def _visits(pivots, reach):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, (cells, radii, blocks, stations) = pivots.value, reach.value
        starts = np.flatnonzero(np.diff(stations, prepend=-1))
        for rb in batches:
            for at in range(0, len(rb), ROWS):
                part = rb.slice(at, ROWS)
                d = np.sqrt(_squares(_array(part.column("v")), p[cells]))
                bound = np.sqrt(part.column("d2").to_numpy())
                # A margin for rounding; a cell of one block that is the row's own has been searched.
                near = d - radii[None, :] <= bound[:, None] * (1 + 1e-9) + 1e-6
                near &= ~((cells[None, :] == part.column("own").to_numpy()[:, None]) & (blocks == 1)[None, :])
                many = np.add.reduceat(near.astype(np.int32), starts, axis=1)
                row, to = np.nonzero(many)
                # Cells of a station are neighbours in order, so those of a row and station follow each other.
                asked = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many[row, to])]), pa.int32()), pa.array(cells[np.nonzero(near)[1]], pa.int32()))
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([taken.column("key"), taken.column("v"), pa.array(to, pa.int32()), asked], names=["key", "v", "station", "cells"])

    return run


def _meet(left: pa.Table, right: pa.Table) -> pa.Table:
    keys, names = left.column("key").to_numpy(), right.column("key").to_numpy()
    best, who = np.full(len(keys), np.inf), np.full(len(keys), -1)
    if len(keys) and len(names):
        a, b, cell = _array(left.column("v")), _array(right.column("v")), right.column("cell").to_numpy()
        asked = left.column("cells").combine_chunks()
        row, to = np.repeat(np.arange(len(keys)), asked.value_lengths().to_numpy()), asked.flatten().to_numpy()
        for c in np.unique(cell):
            some, held = row[to == c], np.flatnonzero(cell == c)
            for start in range(0, len(held), BLOCK):
                h = held[start : start + BLOCK]
                at, d2, other = closest(keys[some], a[some], names[h], b[h])
                at = some[at]
                nearer = (d2 < best[at]) | ((d2 == best[at]) & (other < who[at]))
                best[at[nearer]], who[at[nearer]] = d2[nearer], other[nearer]
    found = np.isfinite(best)
    return pa.table({"key": keys[found], "d2": best[found], "b": who[found]})


def nearest(points: DataFrame, key: str, vector: str, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """(key, neighbour, distance): the nearest point with another key, ties by smaller key.

    Keys are whole numbers. Vectors that are null or hold a null or non-finite
    component have no neighbour and are none; the others must have one length.
    Points that share a key are never each other's neighbours, and each key
    comes once. A table with fewer than two keys gives no rows.
    """
    spark = points.sparkSession
    v = F.col("v")
    sound = F.coalesce(F.forall(v, lambda x: F.coalesce((x - x) == 0, F.lit(False))) & (F.size(v) > 0), F.lit(False))
    # Single precision is kept where rows are moved; distances are computed in double.
    kind = "array<float>" if dict(points.dtypes)[vector] == "array<float>" else "array<double>"
    rows = stage(points.select(F.col(key).cast("long").alias("key"), F.col(vector).cast(kind).alias("v")).where(F.col("key").isNotNull() & sound), "points")
    n = rows.count()
    if n < 2:
        return rows.select(F.col("key").alias(key), F.col("key").alias("neighbour"), F.lit(0.0).alias("distance")).limit(0)
    many = max(1, min(PIVOTS, isqrt(n) // 4, n // block))
    sample = rows.orderBy(F.xxhash64("key", F.lit(5)), "key").limit(many).select("v").toArrow()  # at most PIVOTS rows
    pivots = spark.sparkContext.broadcast(_array(sample.column("v")))
    placed = stage(rows.mapInArrow(_assign(pivots), f"key long, v {kind}, cell int, d double"), "point-cells")
    found = placed.groupBy("cell").agg(F.max("d").alias("r"), F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks")).orderBy("cell").collect()  # a row per pivot
    cells, radii, blocks = np.array([r["cell"] for r in found]), np.array([r["r"] for r in found]), np.array([r["blocks"] for r in found])
    sizes = stage(spark.createDataFrame([(int(c), int(b)) for c, b in zip(cells, blocks, strict=True)], "cell int, blocks int"), "cell-blocks")
    data = attach(placed, sizes, ["cell"], "inner").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    own = stage(data.select("cell", "block", "key", "v").groupBy("cell", "block").applyInArrow(_own, f"key long, v {kind}, d2 double, b long, own int"), "own-cell")
    mine = own.where("d2 < double('infinity')").select("key", "d2", "b")
    if blocks.sum() == 1:
        return _told(mine, key)
    stations = _stations(blocks)
    visits = stage(own.mapInArrow(_visits(pivots, spark.sparkContext.broadcast((cells, radii, blocks, stations))), f"key long, v {kind}, station int, cells array<int>"), "visits")
    # A cell of more blocks than a station has is parted.
    parts = np.maximum(1, -(-np.bincount(stations, blocks).astype(int) // STATION))
    known = stage(spark.createDataFrame([(int(s), int(p)) for s, p in enumerate(parts)], "station int, parts int"), "stations")
    sites = stage(spark.createDataFrame([(int(c), int(s)) for c, s in zip(cells, stations, strict=True)], "cell int, station int"), "cell-stations")
    shares = stage(visits.groupBy("station").agg(F.ceil(F.count(F.lit(1)) / F.lit(queries)).cast("int").alias("shares")).join(F.broadcast(known), "station"), "visit-shares")
    tasks = max(shuffle_width(spark), shares.agg(F.coalesce(F.sum(F.col("shares") * F.col("parts")), F.lit(0))).first()[0])
    asked = attach(visits, shares, ["station"], "inner").withColumn("share", F.pmod(F.xxhash64("key", F.lit(1)), F.col("shares")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    held = attach(attach(placed, sites, ["cell"], "inner"), shares, ["station"], "inner").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    on = ["station", "part", "share"]
    # Meetings are few and dear, so they are dealt to a given number of tasks, not by their bytes.
    sides = [df.select(*on, "key", "v", c).repartition(tasks, *on).groupBy(*on) for df, c in ((asked, "cells"), (held, "cell"))]
    met = sides[0].cogroup(sides[1]).applyInArrow(_meet, "key long, d2 double, b long")
    return _told(mine.unionByName(met), key)


def _told(found: DataFrame, key: str) -> DataFrame:
    best = found.groupBy("key").agg(F.min(F.struct("d2", "b")).alias("m"))
    return best.select(F.col("key").alias(key), F.col("m.b").alias("neighbour"), F.sqrt("m.d2").alias("distance"))
