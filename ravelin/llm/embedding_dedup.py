"""Near-duplicate vectors: spherical k-means cells, blocked cosines, one kept per group.

Equal vectors are collapsed first, under a hash that is proven to tell them
apart; from there on results move by hash, and vectors only to the cells that
they visit. Cells are fitted on a bounded sample. Every vector goes to the cell
of its nearest centroid, its home, and visits the next nearest ones, PROBES in
all whatever the number of cells, so that what is shuffled and compared grows
with the rows. Two vectors are compared where one is at home and the other at
home or visiting, and counted once: in the cell of smaller number if both
visit the other's. A link is lost only if neither end is among the PROBES
cells of the other; vectors too few for more than PROBES cells are one cell,
which loses none.

With `probes=None` a vector instead visits each cell of higher number whose
border is near enough for a partner: for unit vectors x in cell h and y in cell
c, x.(C_h - C_c) <= |x - y| |C_h - C_c|, hence a partner in c needs
x.(C_h - C_c) <= sqrt(2 - 2 threshold) |C_h - C_c|. No link is lost then, but
in many dimensions nearly every border is near, and copies grow with the cells.

A cell is one task, and one of more than BLOCK vectors is compared as pairs of
blocks; a task returns each vector's number of partners and a spanning forest,
never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.base import attach, components, stage

THRESHOLD = 0.93
#: Vectors of the largest label per cell, most cells, rows of a block, and rows of a product.
CELL, MOST_CELLS, BLOCK, TILE = 2048, 4096, 4096, 1024
#: Cells that a vector is dealt to, its own included.
PROBES = 8
#: Vectors per cell, and in all, that centroids are fitted on.
SAMPLE_PER_CELL, SAMPLE, ROUNDS = 32, 1 << 16, 10


def fit_cells(sample: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """Spherical k-means: k unit centroids of the rows of `sample`, which are unit vectors."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        home = np.concatenate([(part @ centres.T).argmax(1) for part in np.array_split(sample, max(1, len(sample) // 8192))])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def _units(column: pa.Array) -> np.ndarray:
    """Rows of a list column as unit vectors in double precision; all of one length."""
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no square under- or overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def visited(dots: np.ndarray, centres: np.ndarray, threshold: float, probes: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(home, mask of visited cells) of vectors from their products with the centroids."""
    home = dots.argmax(1)
    if probes is None:
        apart = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 0))
        reach = dots[np.arange(len(dots)), home][:, None] - dots <= np.sqrt(2 - 2 * threshold) * apart[home] + 1e-9
        return home, reach & (np.arange(len(centres))[None, :] >= home[:, None])
    mask = np.zeros(dots.shape, bool)
    near = np.arange(len(centres))[None, :] if probes >= len(centres) else np.argpartition(-dots, probes - 1, axis=1)[:, :probes]
    np.put_along_axis(mask, np.broadcast_to(near, (len(dots), near.shape[1])), True, 1)
    mask[np.arange(len(dots)), home] = True
    return home, mask


def _assign(centres, threshold: float, probes: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for at in range(0, len(rb), 1024):
                part = rb.slice(at, 1024)
                dims = np.asarray(pa.compute.list_value_length(part.column("v")))
                for dim in np.unique(dims):
                    rows = part.filter(pa.array(dims == dim))
                    c = centres.value.get(int(dim))
                    if c is None or len(c) < 2:
                        home, row, cell, lists = np.zeros(len(rows), int), np.arange(len(rows)), np.zeros(len(rows), int), [[]] * len(rows)
                    else:
                        home, mask = visited(_units(rows.column("v")) @ c.T, c, threshold, probes)
                        row, cell = np.nonzero(mask)
                        lists = [[]] * len(rows) if probes is None else [np.flatnonzero(m) for m in mask]
                    out = rows.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([out.column("uid"), out.column("label"), pa.array(np.full(len(row), dim), pa.int32()), pa.array(cell, pa.int32()), pa.array(home[row], pa.int32()), pa.array(lists, pa.list_(pa.int32())).take(pa.array(row)), out.column("m"), out.column("v")], names=["uid", "label", "dim", "cell", "home", "visits", "m", "v"])

    return run


def _compare(threshold: float):
    from ravelin.llm.simhash import roots

    def run(key: tuple, table: pa.Table) -> pa.Table:
        cell, i, j = key[1].as_py(), key[2].as_py(), key[3].as_py()
        table = table.combine_chunks()
        block, home = table.column("block").to_numpy(), table.column("home").to_numpy()
        uid, many = table.column("uid").to_numpy(), table.column("m").to_numpy()
        lists = table.column("visits").combine_chunks()
        sizes = np.asarray(pa.compute.list_value_length(lists))
        visits = np.full((len(uid), max(1, sizes.max(initial=0))), -1)
        visits[np.arange(visits.shape[1])[None, :] < sizes[:, None]] = np.asarray(lists.flatten())
        v = _units(table.column("v").combine_chunks())
        at_home = home == cell
        partners = np.zeros(len(uid), np.int64)
        ends_a, ends_b = [], []

        def meet(rows: np.ndarray, cols: np.ndarray, within: bool) -> None:
            """Counts near pairs of a row and a column, each pair once if both are the same set."""
            for at in range(0, len(rows), TILE):
                r = rows[at : at + TILE]
                for to in range(at if within else 0, len(cols), TILE):
                    c = cols[to : to + TILE]
                    near = v[r] @ v[c].T >= threshold
                    if within:
                        near &= r[:, None] < c[None, :]
                    a, b = np.nonzero(near)
                    a, b = r[a], c[b]
                    # Elsewhere too, if each visits the other's home: then the smaller home counts it.
                    guest, host = np.where(at_home[a], b, a), np.where(at_home[a], a, b)
                    twice = (home[guest] != cell) & (visits[host] == home[guest][:, None]).any(1)
                    once = ~twice | (home[guest] > cell)
                    a, b = a[once], b[once]
                    np.add.at(partners, a, many[b])
                    np.add.at(partners, b, many[a])
                    ends = np.unique(np.concatenate([a, b]))
                    top = roots(len(ends), np.searchsorted(ends, a), np.searchsorted(ends, b))
                    ends_a.append(ends)
                    ends_b.append(ends[top])

        hosts, guests = ([np.flatnonzero((block == k) & (at_home == own)) for k in (i, j)] for own in (True, False))
        meet(hosts[0], hosts[1], i == j)
        meet(hosts[0], guests[1], False)
        if i != j:
            meet(hosts[1], guests[0], False)
        top = roots(len(uid), np.concatenate(ends_a or [np.empty(0, int)]), np.concatenate(ends_b or [np.empty(0, int)]))
        hit = np.flatnonzero(partners > 0)
        return pa.table({"uid": uid[hit], "n": partners[hit], "root": uid[top[hit]]})

    return run


def _value_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "label", "v")


def _numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`rows` with `uid`, a hash of label and vector, and the staged distinct ones: uid, label, v, first id and number.

    If two values share a hash, which distinct ones show, another seed is taken.
    """
    seed = 0
    while True:
        told = rows.withColumn("uid", F.when(F.col("sound"), _value_hash(seed)))
        distinct = stage(told.where("sound").groupBy("uid", "label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("m")), "vectors")
        if distinct.groupBy("uid").count().where("count > 1").isEmpty():
            return told, distinct
        seed += 1


def find_groups(vectors: DataFrame, threshold: float = THRESHOLD, cell: int = CELL, block: int = BLOCK, probes: int | None = PROBES, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors of one label are linked when their cosine in double precision is at
    least `threshold` and they meet in a cell, as the module says of `probes`;
    nothing below the threshold is linked. Vectors of different lengths, without a label, null, all
    zero or with a null or non-finite component link with nothing and are kept.
    Repeated vectors link with each other, also where they repeat an id. A row
    with a null id takes part and has a null component only if its component
    knows no id. An empty table gives no rows; other columns, whatever they are
    called, are not read. Components keep the input's precision while they
    move; they are compared as doubles.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    sound = F.col("label").isNotNull() & F.forall(v, lambda x: F.coalesce((x - x) == 0, F.lit(False))) & F.exists(v, lambda x: x != 0)
    kind = "float" if dict(vectors.select(vector_col).dtypes)[vector_col] == "array<float>" else "double"
    plus = F.transform(F.col(vector_col).cast(f"array<{kind}>"), lambda x: x + F.lit(0.0).cast(kind))  # no negative zeros
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), plus.alias("v")).withColumn("sound", F.coalesce(sound, F.lit(False)))
    told, distinct = _numbered(rows)
    largest = distinct.groupBy("label", F.size("v").alias("dim")).count().groupBy("dim").agg(F.max("count").alias("n")).collect()  # a row per length of vector
    centres = {}
    for dim, n in ((r["dim"], r["n"]) for r in largest):
        k = min(MOST_CELLS, -(-n // cell))
        if k > (probes or 1):  # fewer cells would all be visited: one, in blocks, moves less
            size = min(SAMPLE, SAMPLE_PER_CELL * k * 8, max(k, (1 << 23) // dim))
            got = distinct.where(F.size("v") == dim).orderBy(F.xxhash64("uid"), "uid").limit(size).select("v").toArrow()
            centres[dim] = fit_cells(_units(got.column("v").combine_chunks()), k)
    placed = stage(distinct.select("uid", "label", "m", "v").mapInArrow(_assign(spark.sparkContext.broadcast(centres), threshold, probes), f"uid long, label string, dim int, cell int, home int, visits array<int>, m long, v array<{kind}>"), "cells")
    sizes = stage(placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks")), "cell-sizes")
    mine = F.pmod(F.xxhash64("uid", F.lit(3)), F.col("blocks")).cast("int")
    dealt = attach(placed, sizes, ["label", "dim", "cell"], "inner").withColumn("block", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.concat_ws("|", "dim", "label").alias("set"), "cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "home", "visits", "uid", "m", "v")
    found = stage(dealt.groupBy("set", "cell", "i", "j").applyInArrow(_compare(threshold), "uid long, n long, root long"), "cell-links")
    partners = stage(found.groupBy("uid").agg(F.sum("n").alias("n")), "partners")
    joined = stage(components(found, "uid", "root"), "vector-components").withColumnRenamed("node", "uid")
    known = attach(attach(distinct.select("uid", "first", "m"), partners, ["uid"]), joined, ["uid"]).where("n > 0 or m > 1").withColumn("component", F.coalesce("component", "uid"))
    known = stage(known, "linked")
    smallest = stage(known.groupBy("component").agg(F.min("first").alias("component_id")), "vector-smallest")
    named = stage(attach(known, smallest, ["component"], "inner").select("uid", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id"), "vector-named")
    linked = F.col("n_links").isNotNull()
    out = attach(told.select("vec_id", "uid"), named, ["uid"])
    component = F.when(linked, F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
