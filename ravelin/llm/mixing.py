"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, target over
source size. Documents are put in order of size, their expected copies are
prefix-summed, one random offset per source is added, and a document is taken
once for every integer boundary that its stretch crosses. In order of size the
words taken differ from the target by less than the source's longest document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.base import attach, keyed, running_before, settled, stage

#: Weights of the sources in order of name, repeating.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` runs; null counts none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(stratum, source, source_size) to the same with `target`.

    Sources share `share` times all sizes by weight. No target exceeds `most`
    times its source's size; what is over is shared again by weight. The level
    at which this ends is the first in order of most*size/weight at which the
    rest, shared by weight, leaves the next source below its bound. One row
    per source takes part, so the two windows see sources, not documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("_level", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    held = (
        sizes.withColumn("_w", weight)
        .withColumn("_cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("_level", F.col("_cap") / F.col("_w"))
        .withColumn("_caps_before", F.coalesce(F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_w_from", F.sum("_w").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_lambda", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.col("_caps_before")) / F.col("_w_from"))
        .withColumn("_water", F.min(F.when(F.col("_level") >= F.col("_lambda"), F.struct("_level", "_lambda"))).over(everything)["_lambda"])
    )
    free = F.col("_water") * F.col("_w")
    return held.withColumn("target", F.when(F.col("_water").isNull() | (F.col("_cap") <= free), F.col("_cap")).otherwise(free)).select("_stratum", "source", "source_size", "target")


def plan(docs: DataFrame, seed: int = 11, share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies, taken, and `row_col` if it is named.

    `copies` is how often the mix emits the row, `taken` its words times that.
    Null texts have size 0, a null source is a source of its own and last in
    order. Repeated rows and rows with a null id are sampled separately. A
    source without any word has target 0 and gives no copies. Same input and
    seed, same result. `row_col` tells rows apart that tie in size and id.
    """
    row = [row_col] if row_col else []
    rows = stage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source_col))).alias("_stratum"),
            word_count(F.col(text_col)).alias("size"),
            F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary")).alias("_mix"),
            *row,
        ),
        "mix-rows",
    )
    goal = stage(targets(rows.groupBy("_stratum", "source").agg(F.sum("size").alias("source_size")), share, most), "mix-targets").drop("source")
    ranked = attach(running_before(rows, ["_stratum"], ["size", "_mix", "doc_id", *row], F.lit(1), "_rank", "mix-rank"), goal, ["_stratum"], "inner")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_stratum")).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    return (
        ranked.withColumn("_rate", rate)
        .withColumn("_offset", offset)
        .withColumn("copies", F.floor((F.col("_rank") + 1) * F.col("_rate") + F.col("_offset")) - F.floor(F.col("_rank") * F.col("_rate") + F.col("_offset")))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("_rate", "_offset", "_rank", "_mix", "_stratum")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, each repeated as often as `plan` takes it.

    Each row gets its own copies, also where rows share an id or have none.
    """
    rows, key = keyed(docs, "mix-docs")
    copies = settled(lambda: plan(rows, row_col=key, **options).where("copies > 0").select(F.col(key).alias("_id"), F.col("copies").alias("_copies")), "mix-copies")
    # Columns are taken from their own tables, whatever else `docs` is called by.
    joined = rows.join(copies, rows[key] == copies["_id"], "inner")
    repeat = F.explode(F.sequence(F.lit(1), copies["_copies"].cast("int")))
    return joined.withColumn(f"_copy_{key}", repeat).select(*[rows[f"`{c}`"] for c in docs.columns])
