"""The corpus pipeline: five stages over `documents`, each on what its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the
rows are written as Parquet and read again. All but the last return the columns
of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ravelin.llm import exact_dedup, mixing, packing, simhash, toxicity
from ravelin.llm.base import drop_path, new_path
from ravelin.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on `labels`, rejects go."""
    return toxicity.filter_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest doc_id stays.

    The rule is that of `op7_simhash`, three-word shingles and at most three
    differing bits. It is narrower than a similarity of five-word shingles of
    0.8 or more: of such pairs it links few, as the README's figures say.
    """
    return simhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out as their source's target asks."""
    return mixing.mix(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of tokens; a repeated document is packed as often as it occurs."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: No SQL gives the scores, fingerprints and tokens; the tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents` of `sf_dir`.

    Rows are decided one by one, also where ids are null or repeat. Null and
    empty texts pass as empty ones, equal to each other; very long texts are
    read whole; of ties in a group of copies one row stays; columns beyond
    those of `documents` pass through; an empty table gives no rows.
    """
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            last, path = path, new_path(spark, name.replace(" ", "-"))
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if last:
                drop_path(spark, last)
    return docs
