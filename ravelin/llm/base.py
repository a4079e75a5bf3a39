"""What the corpus operators share besides staging: row keys, semi joins, components."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.plans.staging import BROADCAST_ROWS, attach, drop_path, file_store, new_path, running_before, settled, shared_dir, shuffle_width, stage, staged

__all__ = ["attach", "components", "drop_path", "file_store", "keep_rows", "keyed", "new_path", "running_before", "settled", "shared_dir", "shuffle_width", "stage", "staged"]


def keyed(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`docs` with a key of each row's own, a long, and the column that holds it.

    Ids may be null or repeated; what is decided for a row is joined by this
    key. Rows of Parquet files are told by their file's number among the files
    and their place in it, so they are read again and nothing is copied; other
    rows are staged. Columns that the operators use themselves may clash with
    none of these names.
    """
    key = f"_key_{uuid.uuid4().hex}"
    file, place = f"_file_{key}", f"_row_{key}"
    try:
        rows = docs.select(*[docs[f"`{c}`"] for c in docs.columns], F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))
    except AnalysisException:
        return stage(docs.withColumn(key, F.monotonically_increasing_id()), name), key
    # A row per file.
    files = stage(rows.select(file).distinct().withColumn(key, F.row_number().over(Window.orderBy(file)).cast("long")), f"{name}-files")
    told = attach(rows, files, [file], "inner").withColumn(key, F.shiftleft(key, 40) + F.col(place))
    return told.select(*[F.col(f"`{c}`") for c in docs.columns], key), key


def keep_rows(docs: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """Semi or anti join of `docs` by `key` with a staged table of ids `_id`, nulls equal."""
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[key].eqNullSafe(ids["_id"]), how)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): smallest node reachable, for the nodes of `edges`.

    Alternates large-star and small-star rounds; each round joins edges with a
    staged node table, so a node of many edges is split by adaptive execution.
    Self links and repeated links are harmless; an empty input gives no rows.
    """
    links = stage(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "links",
    )
    seen = None
    while True:
        mark = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == seen or mark["n"] == 0:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v")).distinct()
        seen = mark
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = stage(large, "large")
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        links = stage(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u != v").distinct(),
            "links",
        )
