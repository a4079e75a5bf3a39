"""Sharding by proportional stratified interleaving.

Rows of a source are shuffled by a seeded digest and ranked; the row of rank r
among n takes the fraction (r + 0.5) / n. Sorted by fraction, every stretch of
rows has the mixture of the whole, and the sorted rows are cut into shards
whose row counts differ by at most one.

Only identifiers, sizes and digests move; the texts are read once at the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.base import attach, running_before, stage


def shard(docs: DataFrame, shards: int = 40, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per input row: id, source, size, text_crc32, shard, slot.

    `size` is the text's UTF-8 bytes plus 16; a null text counts as empty. A
    null source is a source of its own; a null id is shuffled like any other
    id. Rows alike in id and text stay separate rows, and may fall into
    different shards. An empty table gives no rows; columns beyond the three
    named ones are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    rows = stage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source_col))).alias("_stratum"),
            (F.octet_length(text).cast("long") + 16).alias("size"),
            crc.alias("text_crc32"),
            F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"), crc.cast("string")).cast("binary")).alias("_mix"),
        ),
        "shard-rows",
    )
    counts = stage(rows.groupBy("_stratum").agg(F.count("*").alias("_n")), "shard-counts")
    ranked = attach(running_before(rows, ["_stratum"], ["_mix", "doc_id"], F.lit(1), "_rank", "shard-rank"), counts, ["_stratum"], "inner")
    total = rows.count()
    placed = running_before(ranked.withColumn("_fraction", (F.col("_rank") + F.lit(0.5)) / F.col("_n")).drop("_n", "_rank"), [], ["_fraction", "_stratum", "_mix", "doc_id"], F.lit(1), "_at", "shard-place")
    per, more = divmod(total, shards)
    # The first `more` shards take one row more than the others.
    wide = more * (per + 1)
    at = F.col("_at")
    number = F.when(at < wide, F.floor(at / (per + 1))).otherwise(F.lit(more) + F.floor((at - wide) / F.lit(max(per, 1)))).cast("int")
    placed = placed.withColumn("shard", number)
    start = F.col("shard") * per + F.least(F.col("shard"), F.lit(more))
    return placed.withColumn("slot", (at - start).cast("long")).drop("_at", "_mix", "_stratum", "_fraction")
