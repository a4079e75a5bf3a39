"""Exact deduplication over content-defined chunk recipes.

A text, its white space normalised, is cut where a rolling gear hash of the
last 32 bytes hits a mask, so that equal stretches give equal chunks wherever
they stand. Chunks are deduplicated to identifiers that are verified: contents
with one hash are compared, and if they differ, the identifier also names the
content's rank. A document is then its ordered list of identifiers, and lists
are grouped. Contents are shuffled once, as distinct chunks; from there on
only lists of numbers move.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.base import BROADCAST_ROWS, attach, drop_path, settled, stage, staged

MIN_CHUNK, MASK_BITS, MAX_CHUNK = 1024, 12, 16384
_GEAR = np.random.default_rng(20240501).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Bytes hashed at a time, whatever the length of the text.
_SPAN = 1 << 20
_TAIL = 31


def normalise(raw: bytes) -> bytes:
    """Each run of `[\\x20\\x09-\\x0D]` becomes one space."""
    words = b" ".join(raw.split())
    if not raw:
        return raw
    if not words:
        return b" "
    return b" " * raw[:1].isspace() + words + b" " * raw[-1:].isspace()


def _cut_points(data: bytes) -> np.ndarray:
    """Ends of candidate chunks: positions whose last 32 bytes hash to the mask."""
    found = []
    for at in range(0, len(data), _SPAN):
        low = max(0, at - _TAIL)
        h = _GEAR[np.frombuffer(data, np.uint8, min(len(data), at + _SPAN) - low, low)]
        for shift in (1, 2, 4, 8, 16):  # doubles the window: 2, 4, ... 32 bytes
            h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))
        hits = np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + low + 1
        found.append(hits[hits > at])
    return np.concatenate(found) if found else np.empty(0, np.int64)


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of `data`; the empty text is one empty chunk."""
    if len(data) <= MIN_CHUNK:
        return [len(data)]
    cuts, ends, start = _cut_points(data), [], 0
    while len(data) - start > MIN_CHUNK:
        i = int(np.searchsorted(cuts, start + MIN_CHUNK))
        end = min(int(cuts[i]) if i < len(cuts) else len(data), start + MAX_CHUNK, len(data))
        ends.append(end)
        start = end
    if start < len(data):
        ends.append(len(data))
    return ends


_SCHEMA = "doc_id long, text_sha256 string, hashes array<long>, chunks array<binary>"


def _chunker(hash_bits: int):
    shift = 64 - hash_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 512):
                sums, hashes, chunks = [], [], []
                for raw in texts.slice(at, 512).to_pylist():
                    data = normalise(raw or b"")
                    start, parts = 0, []
                    for end in chunk_ends(data):
                        parts.append(data[start:end])
                        start = end
                    sums.append(hashlib.sha256(data).hexdigest())
                    chunks.append(parts)
                    hashes.append([(xxhash.xxh64_intdigest(p) >> shift) - (1 << 63 if not shift else 0) for p in parts])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at : at + 512], pa.int64()), pa.array(sums, pa.string()), pa.array(hashes, pa.list_(pa.int64())), pa.array(chunks, pa.list_(pa.binary())), *[c.slice(at, 512) for c in batch.columns[2:]]],
                    names=["doc_id", "text_sha256", "hashes", "chunks", *batch.schema.names[2:]],
                )

    return run


def recipes(docs: DataFrame, hash_bits: int = 64, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(doc_id, text_sha256, recipe, `_row`, and `row_col`, a long, if it is named): each row's list of verified chunk identifiers.

    Staged; `_row` tells rows apart. `hash_bits` narrows the hash, so that tests can make it collide.
    """
    row = [row_col] if row_col else []
    cut, path = staged(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"), *row).mapInArrow(_chunker(hash_bits), ", ".join([_SCHEMA, *[f"{c} long" for c in row]])), "chunks")
    pieces = cut.select(F.explode(F.arrays_zip("hashes", "chunks")).alias("p")).select(F.col("p.hashes").alias("h"), F.col("p.chunks").alias("c"))
    clashing = stage(pieces.distinct().groupBy("h").count().where("count > 1").select("h"), "clashes")
    if clashing.isEmpty():
        out = stage(cut.select("doc_id", "text_sha256", F.transform("hashes", lambda h: F.struct(h.alias("h"), F.lit(0).alias("k"))).alias("recipe"), F.monotonically_increasing_id().alias("_row"), *row), "recipes")
    else:
        # Distinct contents under one hash are told apart by their rank.
        known = attach(pieces, clashing, ["h"], "inner").distinct()
        known = stage(known.withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy("c"))), "ranks")
        rows = stage(cut.withColumn("_row", F.monotonically_increasing_id()), "chunk-rows")
        flat = rows.select("_row", *row, "doc_id", "text_sha256", F.posexplode(F.arrays_zip("hashes", "chunks")).alias("pos", "p")).select("_row", *row, "doc_id", "text_sha256", "pos", F.col("p.hashes").alias("h"), F.col("p.chunks").alias("c"))
        flat = attach(flat, known, ["h", "c"], narrow=False).select("_row", *row, "doc_id", "text_sha256", F.struct("pos", "h", F.coalesce("k", F.lit(0)).alias("k")).alias("s"))
        lists = flat.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.first("text_sha256").alias("text_sha256"), F.array_sort(F.collect_list("s")).alias("l"), *[F.first(c).alias(c) for c in row])
        out = stage(lists.select("doc_id", "text_sha256", F.transform("l", lambda s: F.struct(s["h"].alias("h"), s["k"].alias("k"))).alias("recipe"), "_row", *row), "recipes")
    drop_path(docs.sparkSession, path)
    return out


def find_copies(docs: DataFrame, hash_bits: int = 64, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, and `row_col` (a long) if it is named.

    Of rows with equal normalised texts that with the smallest id is kept; a
    null text counts as empty. Of rows that repeat both id and text exactly one
    is kept. A null id comes after all others, so it is kept only if every id
    of its group is null; keep_id is null then. An empty table gives no rows;
    other columns are not read.
    """
    rows = recipes(docs, hash_bits, id_col, text_col, row_col)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    groups = stage(rows.groupBy("recipe").agg(F.min(order).alias("_keep"), F.count("*").alias("_size")).where("_size > 1"), "copies")
    joined = attach(rows, groups, ["recipe"], narrow=False)
    alone = F.col("_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("_keep.id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_row") == F.col("_keep.row"))).alias("kept"),
        "text_sha256",
        *([row_col] if row_col else []),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """The rows of `docs` that stay, one of each group of equal texts, whatever rows share its id.

    Rows are told by id and digest of the normalised text, so no copy of the
    table is kept; of rows that agree in both, any one stays. `docs` is read
    again for the result, so its rows must not change from reading to reading.
    Nulls, ties and empty tables are as in `find_copies`.
    """
    told = lambda: find_copies(docs, hash_bits, id_col, text_col).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    marks = settled(lambda: told().where("NOT kept OR n > 1"), "dedup-marks")
    digest = f"_digest_{uuid.uuid4().hex}"
    plain = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")
    rows = docs.withColumn(digest, F.sha2(plain.cast("binary"), 256))

    def joined(marked: DataFrame, how: str) -> DataFrame:
        small = F.broadcast(marked) if marked.count() <= BROADCAST_ROWS else marked
        return rows.join(small, rows[id_col].cast("long").eqNullSafe(small["doc_id"]) & (rows[digest] == small["text_sha256"]), how)

    out = joined(marks, "left_anti").drop(digest)
    repeated = marks.where("kept")
    if repeated.isEmpty():
        return out
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = joined(repeated, "left_semi").groupBy(F.col(id_col).cast("long"), F.col(digest)).agg(F.first(F.struct(*columns)).alias("_one"))
    return out.unionByName(one.select("_one.*"))
