"""Nearest partners, smallest distances and contacts of two tables' points, case by case, exactly.

A case's points lie in an octree over its bounding cube; a leaf, or tile, is one
long whose parent is the number shifted by three bits. Tiles hold some hundred
places each, so they are few beside the points, and the boxes of their points
are broadcast. The two sides of a tile meet in one task, which keeps one partner
for each label; labels without a point in such a tile ask a near tile of the other
side. What a label has found so bounds what is sought: a point goes on to the
tiles of the other side whose box is within its label's bound, and most go to none.

Contacts are counted in tiles of a grid, one side going to the tiles within reach as well.
Neither moves a point for each cell around it, and no table of pairs is made.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.plans.staging import ROWS_A_TASK, attach, shuffle_width, stage

AXES = ("x", "y", "z")
#: Places of a tile and side, as a place meets them on average, up to which the tree grows deeper, and deepest level.
CELL, DEEPEST = 2048, 20
#: Octree levels gone down by one join, and boxes of a case and side that the first one meets at most.
STEP, WIDEST = 2, 64
#: Joins in one plan; what Catalyst infers of more of them grows exponentially.
STRIDE = 3
#: Rows of a side that meet in one task, and distances computed at once.
MOST, BLOCK = 500_000, 1 << 17
#: Places from which the size of tiles is chosen; all places are in the tiles.
SAMPLE = 200_000
#: Rows of a tile of the contact grid that are worth a group, and times the reach that a tile's side is at least, and at most, as powers of two.
GRID, SIDES = 4096, (3, 16)
#: Bounds and distances are rounded in different orders.
_SLACK = 1 + 1e-9


def _points(left: DataFrame, right: DataFrame, case: str, label: str, order: str, axes: Sequence[str]) -> DataFrame:
    """(case, side, label, place, x, y, z) of both tables."""
    one = lambda df, side: df.select(F.col(case).alias("case"), F.lit(side).alias("side"), F.col(label).alias("label"), F.col(order).alias("place"), *[(F.col(a).cast("double") + 0.0).alias(x) for a, x in zip(axes, AXES, strict=True)])
    return one(left, 0).unionByName(one(right, 1))


def _sound() -> Column:
    """Points with a case and finite coordinates."""
    return reduce(lambda a, b: a & b, [F.coalesce((F.col(x) - F.col(x)) == 0, F.lit(False)) for x in AXES]) & F.col("case").isNotNull()


def _spread(n: Column) -> Column:
    """The bits of a number below 2 ** 21, two empty ones after each."""
    for by, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        n = n.bitwiseOR(F.shiftleft(n, by)).bitwiseAND(F.lit(mask))
    return n


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _some(points: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """(keys, x, y, z, n) of one in so many distinct places, with their points, and that number: enough to choose a size of tiles."""
    k = max(1, points.count() // SAMPLE)
    return points.where(F.pmod(F.xxhash64(*AXES), F.lit(k)) == 0).groupBy(*keys, *AXES).agg(F.count(F.lit(1)).alias("n")), k


def _tree(points: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Points with their tile, twice (those that ask, those that answer), and the boxes of each second level's cells, coarse first, tiles last.

    Cases without points on both sides, points without coordinates and those
    without a case are left out.
    """
    points = points.where(_sound())
    span = F.greatest(*[F.max(x) - F.min(x) for x in AXES])
    frames = points.groupBy("case").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"), span.alias("span"), *[F.min(x).alias(f"{x}0") for x in AXES])
    frames = stage(frames.where("n0 > 0 AND n1 > 0"), "frames")
    side = lambda x: F.when(F.col("span") > 0, F.least(F.lit((1 << DEEPEST) - 1), F.floor((F.col(x) - F.col(f"{x}0")) / F.col("span") * (1 << DEEPEST)).cast("long"))).otherwise(F.lit(0)).cast("long")
    within = lambda df, level, *more: attach(df, frames, ["case"], "inner").select(*df.columns, F.shiftright(_spread(side("x")) * 4 + _spread(side("y")) * 2 + _spread(side("z")), 3 * (DEEPEST - level)).alias("cell"), *more)
    some, k = _some(points, ["case", "side"])
    # Each place is counted in the cells of all levels at once.
    level = F.explode(F.sequence(F.lit(1), F.lit(DEEPEST))).alias("level")
    counts = within(some, DEEPEST).select("case", "side", "cell", level).groupBy("level", "case", "side", F.expr(f"shiftright(cell, 3 * ({DEEPEST} - level))").alias("cell")).count()
    means = counts.groupBy("level", "side").agg((F.sum(F.col("count") * F.col("count")) / F.sum("count")).alias("n")).groupBy("level").agg(F.max("n").alias("n")).collect()  # a row per level
    depth = min([r["level"] for r in means if (r["n"] - 1) * k + 1 <= CELL], default=DEEPEST)
    # How far the nearest face of the tile's cube is: a ball that stays within meets no other tile. A margin for rounding.
    inner = [F.col("span") / (1 << depth) * F.least(p - F.floor(p), F.lit(1.0) - (p - F.floor(p))) for p in [(F.col(x) - F.col(f"{x}0")) / F.col("span") * (1 << depth) for x in AXES]]
    face = F.when(F.col("span") > 0, F.greatest(F.lit(0.0), F.least(*inner) - F.col("span") * 1e-12)).otherwise(F.lit(0.0))
    placed = within(points, depth, face.alias("face"))
    box = [f(f"{n}{x}").alias(f"{n}{x}") for x in AXES for f, n in ((F.min, "lo"), (F.max, "hi"))]
    tiles = stage(placed.groupBy("case", "side", "cell").agg(F.count(F.lit(1)).alias("n"), *[f(x).alias(f"{n}{x}") for x in AXES for f, n in ((F.min, "lo"), (F.max, "hi"))]), "tiles")
    wide = tiles.select("case", "side", "cell", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("up")).groupBy("up", "case", "side").agg(F.count_distinct(F.expr("shiftright(cell, 3 * up)")).alias("n"))
    narrow = [r["up"] for r in wide.groupBy("up").agg(F.max("n").alias("n")).where(F.col("n") <= WIDEST).collect()]  # a row per level
    cells = [tiles]
    for _ in range(0, min(narrow, default=depth - 1), STEP):
        cells.append(stage(cells[-1].groupBy("case", "side", F.shiftright("cell", 3 * STEP).alias("cell")).agg(F.sum("n").alias("n"), *box), "cells"))
    return placed, placed, cells[::-1]


def _xyz(t: pa.Table) -> np.ndarray:
    return np.column_stack([t[x].to_numpy() for x in AXES])


def _distinct(xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each distinct place, ascending, and each row's number among them."""
    order = np.lexsort(xyz.T[::-1])
    new = np.concatenate([[True], (xyz[order[1:]] != xyz[order[:-1]]).any(axis=1)])
    heads = order[new]
    by = np.argsort(heads)
    number, inverse = np.empty(len(heads), int), np.empty(len(xyz), int)
    number[by] = np.arange(len(heads))
    inverse[order] = number[np.cumsum(new) - 1]
    return heads[by], inverse


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed in the order of the axes, as SQL does."""
    with np.errstate(over="ignore"):
        d2 = np.square(a[:, 0, None] - b[None, :, 0])
        for i in (1, 2):
            d2 += np.square(a[:, i, None] - b[None, :, i])
    return d2


def _closest(a: np.ndarray, b: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """For each place of `a` the squared distance and number of the nearest of `b`, the first of equally near ones, and the other way round."""
    near, at = np.empty(len(a)), np.empty(len(a), int)
    back, by = np.full(len(b), np.inf), np.zeros(len(b), int)
    rows = max(1, BLOCK // len(b))
    for i in range(0, len(a), rows):
        d2 = _squares(a[i : i + rows], b)
        at[i : i + rows] = d2.argmin(axis=1)
        near[i : i + rows] = d2[np.arange(len(d2)), at[i : i + rows]]
        first = d2.argmin(axis=0)
        least = d2[first, np.arange(len(b))]
        nearer = least < back
        back[nearer], by[nearer] = least[nearer], i + first[nearer]
    return (near, at), (back, by)


def _first_of(codes: np.ndarray, *ranks: np.ndarray) -> np.ndarray:
    """The row of each code that is first by the ranks."""
    order = np.lexsort((*ranks[::-1], codes))
    return order[np.diff(codes[order], prepend=-1) != 0]


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()


def _partners(t: pa.Table) -> pa.Table:
    """(case, side, label, d2, place, met): of each label that asks the nearest place of the other side in this group, ties by place, then label."""
    # Rows in the order that decides between equally near ones: of equal places the first stands for all, and the first least distance counts.
    t = t.take(pc.sort_indices(t, sort_keys=[("place", "ascending"), ("label", "ascending")], null_placement="at_start"))
    side, asks, xyz, codes = t["side"].to_numpy(), t["asks"].to_numpy(), _xyz(t), _codes(t["label"])
    rows = [np.flatnonzero(side == k) for k in (0, 1)]
    own, other = [np.empty(0, int)], [np.empty(0, int)]
    d2s = [np.empty(0)]
    if all(map(len, rows)):
        places = [_distinct(xyz[r]) for r in rows]
        heads = [r[p[0]] for r, p in zip(rows, places, strict=True)]
        for k, (near, at) in enumerate(_closest(*[xyz[h] for h in heads])):
            asked = asks[rows[k]]
            q, r = places[k][1][asked], rows[k][asked]
            d2, to = near[q], heads[1 - k][at[q]]
            best = _first_of(codes[r], d2, to)
            own, other, d2s = [*own, r[best]], [*other, to[best]], [*d2s, d2[best]]
    told, met = t.take(pa.array(np.concatenate(own))), t.take(pa.array(np.concatenate(other)))
    return pa.table([told["case"], told["side"], told["label"], pa.array(np.concatenate(d2s)), met["place"], met["label"]], names=["case", "side", "label", "d2", "place", "met"])


def _grouped(rows: DataFrame, sizes: DataFrame, on: Sequence[str], run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """`run` over rows that are alike in `on`; sides of more than MOST rows come in parts, and each part meets each of the other side.

    `sizes` has the rows of either side, `n0` and `n1`; groups that lack a side are left out.
    """
    parts = [F.ceil(F.col(f"n{k}") / F.lit(MOST)).cast("int").alias(f"p{k}") for k in (0, 1)]
    both = stage(sizes.where("n0 > 0 AND n1 > 0").select(*on, "n0", "n1", *parts), "sizes")
    moved = both.agg(F.coalesce(F.sum(F.expr("n0 * p1 + n1 * p0")), F.lit(0))).first()[0]
    tasks = max(shuffle_width(rows.sparkSession), -(-int(moved) // ROWS_A_TASK))
    mine = lambda k: F.pmod(F.xxhash64("label", "place", *AXES), F.col(f"p{k}")).cast("int")
    dealt = attach(rows, both.drop("n0", "n1"), list(on), "inner")
    for k, c in ((0, "i"), (1, "j")):
        dealt = dealt.withColumn(c, F.explode(F.when(F.col("side") == k, F.array(mine(k))).otherwise(F.sequence(F.lit(0), F.col(f"p{k}") - 1))))
    return dealt.drop("p0", "p1").repartition(tasks, *on, "i", "j").groupBy(*on, "i", "j").applyInArrow(run, schema)


def _near_tiles(cells: list[DataFrame]) -> DataFrame:
    """(case, side, cell, to): a near tile of the other side for each tile, gone down to level by level."""
    sides = [f"{n}{x}" for x in AXES for n in ("lo", "hi")]
    chosen = None
    for level in cells:
        up = F.shiftright("cell", 3 * STEP)
        own = level.select("case", "side", "cell", up.alias("up"), *sides)
        other = level.select("case", (F.lit(1) - F.col("side")).alias("side"), F.col("cell").alias("to"), up.alias("up_to"), *[F.col(c).alias(f"_{c}") for c in sides])
        if chosen is None:
            both = own.join(other, ["case", "side"])
        else:
            both = own.join(chosen.select("case", "side", F.col("cell").alias("up"), F.col("to").alias("up_to")), ["case", "side", "up"]).join(other, ["case", "side", "up_to"])
        # By the gap first: a few points' small box at the edge is not far off, but nothing near is below it.
        gap = [F.greatest(F.lit(0.0), F.col(f"lo{x}") - F.col(f"_hi{x}"), F.col(f"_lo{x}") - F.col(f"hi{x}")) for x in AXES]
        far = [F.greatest(F.col(f"hi{x}") - F.col(f"_lo{x}"), F.col(f"_hi{x}") - F.col(f"lo{x}")) for x in AXES]
        rank = F.struct(_sum([g * g for g in gap]).alias("near"), _sum([f * f for f in far]).alias("far"), "to")
        chosen = stage(both.groupBy("case", "side", "cell").agg(F.min(rank).alias("n")).select("case", "side", "cell", "n.to"), "chosen-tiles")
    return chosen


def _found(placed: DataFrame) -> str:
    t = dict(placed.dtypes)
    return f"case {t['case']}, side int, label {t['label']}, d2 double, place {t['place']}, met {t['label']}"


def _ask(asked: DataFrame, placed: DataFrame, tiles: DataFrame) -> DataFrame:
    """Partners found by points (case, side, label, place, x, y, z, cell) in that tile of the other side."""
    asked = stage(asked, "asked")
    reached = stage(asked.groupBy("case", "side", "cell").agg(F.count(F.lit(1)).alias("asking")), "reached")
    to = (F.lit(1) - F.col("side")).alias("side")
    sizes = attach(tiles.select("case", to, "cell", "n"), reached, ["case", "side", "cell"], "inner").select("case", F.col("side").alias("of"), "cell", *[F.when(F.col("side") == k, F.col("asking")).otherwise(F.col("n")).alias(f"n{k}") for k in (0, 1)])
    columns = ["case", "cell", "side", "label", "place", *AXES]
    held = attach(placed.select(*columns, (F.lit(1) - F.col("side")).alias("of")), reached.select("case", F.col("side").alias("of"), "cell"), ["case", "of", "cell"], "inner")
    rows = asked.select(*columns, F.col("side").alias("of"), F.lit(True).alias("asks")).unionByName(held.withColumn("asks", F.lit(False)))
    return _grouped(rows, sizes, ["case", "of", "cell"], _partners, _found(placed))


def _met(held: DataFrame, placed: DataFrame, cells: list[DataFrame], key: Sequence[str]) -> DataFrame:
    """(key, d2, place and label met): the nearest that the key's points found, tile by tile."""
    tiles, columns = cells[-1], ["case", "side", "label", "place", *AXES, "cell"]
    count = lambda k: F.sum(F.when(F.col("side") == k, F.col("n")).otherwise(0)).alias(f"n{k}")
    shared = stage(tiles.groupBy("case", "cell").agg(count(0), count(1)).where("n0 > 0 AND n1 > 0"), "shared-tiles")
    best = lambda df: df.groupBy(*key).agg(F.min(F.struct("d2", "place", "met")).alias("m")).select(*key, "m.*")
    found = stage(best(_grouped(held.select(*columns).withColumn("asks", F.lit(True)), shared, ["case", "cell"], _partners, _found(placed))), "in-own-tile")
    marked = attach(held.select(*columns), shared.select("case", "cell", F.lit(True).alias("shared")), ["case", "cell"])
    lost = stage(marked.groupBy(*key).agg(F.max(F.coalesce("shared", F.lit(False))).alias("any")).where(~F.col("any")).select(*key), "lost-labels")
    if lost.count():
        alone = attach(attach(marked.where("shared IS NULL").drop("shared"), lost, list(key), "inner"), _near_tiles(cells), ["case", "side", "cell"], "inner")
        asked = alone.drop("cell").withColumnRenamed("to", "cell").select(*columns)
        found = stage(found.unionByName(best(_ask(asked, placed, tiles))), "in-near-tile")
    at = attach(held.select(*columns, "face"), found.select(*key, F.col("d2").alias("bound")), list(key), "inner").where(F.col("face") * F.col("face") <= F.col("bound") * _SLACK).withColumn("_to", F.lit(1) - F.col("side")).withColumn("_up", F.lit(0).cast("long"))
    for i, level in enumerate(cells):
        if i and i % STRIDE == 0:
            at = stage(at, "going-down")
        top = F.lit(0).cast("long") if i == 0 else F.shiftright("cell", 3 * STEP)
        boxes = level.select("case", F.col("side").alias("_to"), top.alias("_up"), F.col("cell").alias("_cell"), *[f"{n}{x}" for x in AXES for n in ("lo", "hi")])
        gaps = [F.greatest(F.lit(0.0), F.col(f"lo{x}") - F.col(x), F.col(x) - F.col(f"hi{x}")) for x in AXES]
        near = attach(at, boxes, ["case", "_to", "_up"], "inner").where(_sum([g * g for g in gaps]) <= F.col("bound") * _SLACK)
        at = near.select(*columns, "bound", "_to", F.col("_cell").alias("_up"))
    asked = at.where("_up <> cell").drop("cell").withColumnRenamed("_up", "cell").select(*columns)
    return found.unionByName(_ask(asked, placed, tiles).select(*found.columns))


def nearest_partners(left: DataFrame, right: DataFrame, case: str, label: str, order: str, axes: Sequence[str] = AXES, cutoff: float | None = None) -> DataFrame:
    """(case, side, label, distance, partner): each label's nearest label of the other table, within its case.

    A label may have many points; labels are as far apart as their nearest
    points, and of equally near partners the first by `order`, a label's place,
    counts. `side` is 0 for labels of `left` and 1 for those of `right`. Where
    a case has no point on the other side, or a label none with finite
    coordinates, distance and partner are null. Labels and cases that are null
    are kept and have no partner. With `cutoff` a column `interface` tells
    labels that near their partner.
    """
    points = stage(_points(left, right, case, label, order, axes), "points-of-both")
    named = points.where(F.col("label").isNotNull())
    held, placed, cells = _tree(named)
    key = ["case", "side", "label"]
    met = _met(held, placed, cells, key).groupBy(*key).agg(F.min(F.struct("d2", "place", "met")).alias("m"))
    best = stage(met.select(*key, F.sqrt("m.d2").alias("distance"), F.col("m.met").alias("partner")), "partners")
    out = points.select("case", "side", "label").distinct().join(best, ["case", "side", "label"], "left")
    return out if cutoff is None else out.withColumn("interface", F.coalesce(F.col("distance") <= cutoff, F.lit(False)))


def _shortest(points: DataFrame) -> DataFrame:
    """(case, distance) of staged points: all of a side are one label."""
    held, placed, cells = _tree(points.withColumn("label", F.lit("")).withColumn("place", F.lit(0)))
    met = _met(held, placed, cells, ["case", "side", "label"])
    return met.groupBy("case").agg(F.sqrt(F.min("d2")).alias("distance"))


def smallest_distance(left: DataFrame, right: DataFrame, case: str, label: str, order: str, axes: Sequence[str] = AXES) -> DataFrame:
    """(case, distance): the smallest distance of a point of `left` and one of `right`, however far apart.

    Cases without finite points on both sides have no row.
    """
    return _shortest(stage(_points(left, right, case, label, order, axes).drop("label", "place"), "points-of-both"))


def _counted(cutoffs: Sequence[float]) -> Callable[[pa.Table], pa.Table]:
    """Contacts of each label of a tile within each cutoff: (case, side, label, least, n_0, ...), `least` being the tile's smallest squared distance in reach."""
    squares = np.unique([c * c for c in cutoffs])
    level = np.searchsorted(squares, [c * c for c in cutoffs])
    many, reach = len(squares), max(cutoffs) * _SLACK

    def run(t: pa.Table) -> pa.Table:
        side, xyz = t["side"].to_numpy(), _xyz(t)
        rows = [np.flatnonzero(side == k) for k in (0, 1)]
        told, counts, least = [np.empty(0, int)], [np.empty((0, many))], np.inf
        if all(map(len, rows)):
            (p, inverse), (q, back) = [_distinct(xyz[r]) for r in rows]
            a, b, wa, wb = xyz[rows[0][p]], xyz[rows[1][q]], np.bincount(inverse), np.bincount(back)
            # Cells as wide as the reach, an empty one around them all; those along the last axis follow each other.
            low = np.minimum(a.min(axis=0), b.min(axis=0))
            ca, cb = [np.floor((c - low) / reach).astype(int) + 1 for c in (a, b)]
            wide = np.maximum(ca.max(axis=0), cb.max(axis=0)) + 2
            number = lambda c: (c[:, 0] * wide[1] + c[:, 1]) * wide[2] + c[:, 2]
            ia, ib = number(ca), number(cb)
            oa, ob = np.argsort(ia, kind="stable"), np.argsort(ib, kind="stable")
            a, wa, b, wb, ib = a[oa], wa[oa], b[ob], wb[ob], ib[ob]
            at, starts = np.unique(ia[oa], return_index=True)
            ends = np.append(starts[1:], len(a))
            rims = at[:, None] + np.array([(x * wide[1] + y) * wide[2] for x in (-1, 0, 1) for y in (-1, 0, 1)])
            lows, highs = np.searchsorted(ib, rims - 1), np.searchsorted(ib, rims + 2)
            na, nb = np.zeros((len(a), many)), np.zeros((len(b), many))
            for c in np.flatnonzero((highs > lows).any(axis=1)):
                near = np.concatenate([np.arange(x, y) for x, y in zip(lows[c], highs[c], strict=True) if y > x])
                other, step = b[near], max(1, BLOCK // len(near))
                for i in range(starts[c], ends[c], step):
                    d2 = _squares(a[i : min(i + step, ends[c])], other)
                    u, v = np.nonzero(d2 <= squares[-1])
                    if len(u):
                        d2 = d2[u, v]
                        least = min(least, d2.min())
                        at_level = np.searchsorted(squares, d2)
                        na[i : i + u[-1] + 1] += np.bincount(u * many + at_level, wb[near[v]], (u[-1] + 1) * many).reshape(-1, many)
                        nb[near] += np.bincount(v * many + at_level, wa[i + u], len(near) * many).reshape(-1, many)
            codes = _codes(t["label"])
            for r, inv, order, n in ((rows[0], inverse, oa, na), (rows[1], back, ob, nb)):
                each = np.empty_like(n)
                each[order] = n.cumsum(axis=1)
                each = each[inv]
                labels, first, to = np.unique(codes[r], return_index=True, return_inverse=True)
                sums = np.column_stack([np.bincount(to, each[:, i], len(labels)) for i in range(many)])
                some = sums[:, -1] > 0
                told.append(r[first[some]])
                counts.append(sums[some])
        out, n = t.take(pa.array(np.concatenate(told))), np.concatenate(counts).astype(np.int64)
        return pa.table([out["case"], out["side"], out["label"], pa.array(np.full(len(n), least)), *[pa.array(n[:, i]) for i in level]], names=["case", "side", "label", "least", *[f"n_{i}" for i in range(len(cutoffs))]])

    return run


def _grid(points: DataFrame, reach: float) -> float:
    """The side of tiles that hold some thousand points, as a point meets them, and are at least eight times as wide as the reach."""
    some, k = _some(points, ["case"])
    level = F.explode(F.sequence(*map(F.lit, SIDES))).alias("level")
    cell = [F.floor(F.col(x) / (F.lit(reach) * F.pow(F.lit(2.0), "level"))).alias(x) for x in AXES]
    counts = some.select("case", "n", level, *AXES).select("case", "n", "level", *cell).groupBy("level", "case", *AXES).agg(F.count(F.lit(1)).alias("places"), F.sum("n").alias("n"))
    n = (((F.sum(F.col("places") * F.col("places")) / F.sum("places") - 1) * k + 1) * F.sum("n") / F.sum("places")).alias("n")
    means = counts.groupBy("level").agg(n).collect()  # a row per level
    return reach * 2.0 ** min([r["level"] for r in means if r["n"] >= GRID], default=SIDES[1])


def contact_stats(left: DataFrame, right: DataFrame, case: str, label: str, order: str, cutoffs: Sequence[float], axes: Sequence[str] = AXES, least: int = 1) -> DataFrame:
    """Per case of either table: smallest distance, and within each cutoff point contacts and labels in contact on either side.

    A case without points on one side has no distance and no contacts.
    `contacting` tells cases with at least `least` point contacts within the
    first cutoff.
    """
    points = stage(_points(left, right, case, label, order, axes).where("case IS NOT NULL"), "points-of-both")
    sound = points.where(_sound())
    reach = max(cutoffs) * _SLACK
    tile, on = _grid(sound, reach), ["case", "tx", "ty", "tz"]
    at = lambda c: F.floor(c / F.lit(tile)).cast("long")
    ends = [sound.where("side = 0").select("*", *[at(F.col(x)).alias(f"t{x}") for x in AXES]), sound.where("side = 1")]
    for x in AXES:
        ends[1] = ends[1].withColumn(f"t{x}", F.explode(F.sequence(at(F.col(x) - F.lit(reach)), at(F.col(x) + F.lit(reach)))))
    sizes = [stage(df.groupBy(*on).agg(F.count(F.lit(1)).alias(f"n{k}")), "tile-sizes") for k, df in enumerate(ends)]
    names = {c: f"{c:g}".replace(".", "_") for c in cutoffs}
    t = dict(points.dtypes)
    schema = f"case {t['case']}, side int, label {t['label']}, least double, " + ", ".join(f"n_{i} long" for i in range(len(cutoffs)))
    near = _grouped(ends[0].unionByName(ends[1]), attach(sizes[0], sizes[1], on, "inner"), on, _counted(cutoffs), schema)
    labels = near.groupBy("case", "side", "label").agg(F.min("least").alias("least"), *[F.sum(f"n_{i}").alias(f"n_{n}") for i, n in enumerate(names.values())])
    outs = []
    for n in names.values():
        outs.append(F.sum(F.when(F.col("side") == 0, F.col(f"n_{n}"))).alias(f"contacts_{n}"))
        outs += [F.count_if((F.col("side") == k) & F.col("label").isNotNull() & (F.col(f"n_{n}") > 0)).alias(f"{c}_{n}") for k, c in enumerate(("left", "right"))]
    counts = stage(labels.groupBy("case").agg(F.sqrt(F.min("least")).alias("_near"), *outs), "contacts")
    # Where points are in contact, the nearest are among them.
    shortest = _shortest(attach(points.drop("label", "place"), counts.select("case"), ["case"], "left_anti"))
    out = points.select("case").distinct().join(shortest, "case", "left").join(counts, "case", "left")
    filled = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for n in names.values() for c in (f"contacts_{n}", f"left_{n}", f"right_{n}")]
    return out.select("case", F.coalesce("_near", "distance").alias("distance"), *filled).withColumn("contacting", F.col(f"contacts_{names[cutoffs[0]]}") >= least)
