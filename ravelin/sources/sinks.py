"""Sinks: typed tables, matrices, FASTA, ranked tables, restraints, rewritten structures, run logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.plans.staging import running_before


def joined_set(values: Column) -> Column:
    """Sorted distinct values joined by `;`, or `-` if there are none."""
    kept = F.array_sort(F.array_distinct(F.array_compact(values)))
    return F.when(F.size(kept) > 0, F.array_join(kept, ";")).otherwise("-")


def write_tsv(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str], missing: str = "-") -> None:
    """Fixed columns in a fixed order, rows sorted over all files."""
    df.select(*columns).orderBy(*order).write.mode("overwrite").option("header", True).option("sep", "\t").option("nullValue", missing).option("emptyValue", missing).csv(path)


def matrix_lines(cells: DataFrame, group: Sequence[str], rows: int, columns: int, pattern: str = "%.6f") -> DataFrame:
    """(group, i, line): dense tab-separated rows of sparse (i, j, score) cells, from 1."""
    lists = cells.groupBy(*group, "i").agg(F.map_from_entries(F.collect_list(F.struct("j", "score"))).alias("_cells"))
    every = cells.select(*group).distinct().withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(rows)))).withColumn("i", F.col("i").cast("long"))
    value = lambda j: F.format_string(pattern, F.coalesce(F.try_element_at("_cells", j.cast("long")), F.lit(0.0)))
    return every.join(lists, [*group, "i"], "left").withColumn("line", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(columns)), value), "\t")).drop("_cells")


def fasta_lines(df: DataFrame, id_col: str, sequence: str, width: int = 80) -> Column:
    """A record as text, its sequence wrapped."""
    return F.concat(F.lit(">"), F.col(id_col), F.lit("\n"), F.regexp_replace(F.regexp_replace(F.col(sequence), f"(.{{{width}}})", "$1\n"), "\n$", ""))


def paired_row(left: Column, right: Column, l1: int, l2: int) -> Column:
    """Two aligned rows side by side, padded and cut to both lengths."""
    return F.concat(F.rpad(F.coalesce(left, F.lit("")), l1, "-"), F.rpad(F.coalesce(right, F.lit("")), l2, "-"))


def ranked(df: DataFrame, group: Sequence[str], score: str, position: str) -> DataFrame:
    """Rows ranked by falling score, ties by position."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.col(score).desc_nulls_last(), position)).cast("long"))


def top_cells(cells: DataFrame, group: Sequence[str], limit: int | None = None) -> DataFrame:
    """Non-zero cells ranked by falling score, then i, then j."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("score").desc(), "i", "j")).cast("long")
    out = cells.where(F.col("score") != 0).withColumn("rank", rank)
    return out if limit is None else out.where(F.col("rank") <= limit)


def restraint_lines(df: DataFrame, code: str, label: str, role: str) -> DataFrame:
    """(line, n): distinct labels, actives before passives, ` P` behind passives; numbered by ranges, not in one task."""
    passive = F.col(role) == "passive"
    one = df.groupBy(code, label).agg(F.min(passive.cast("int")).alias("_p"))
    line = F.concat_ws(" ", code, label, F.when(F.col("_p") == 1, F.lit("P")))
    placed = running_before(one.withColumn("_all", F.lit(0)), ["_all"], ["_p", code, label], F.lit(1), "n", "restraints")
    return placed.select(line.alias("line"), (F.col("n") + 1).cast("long").alias("n"))


def with_scores(lines: DataFrame, scores: DataFrame, on: Sequence[str], text: str, score: str, group: Sequence[str] = ()) -> DataFrame:
    """Fixed-width atom lines with 100 * score / max in the temperature column.

    The maximum is taken over each `group`, a structure; without one the table
    holds one structure.
    """
    top = scores.groupBy(*group).agg(F.max(score).alias("_top"))
    scaled = (scores.join(top, list(group)) if group else scores.crossJoin(F.broadcast(top))).withColumn("_v", F.when(F.col("_top") > 0, F.lit(100.0) * F.col(score) / F.col("_top")).otherwise(F.lit(0.0)))
    value = F.format_string("%6.2f", F.coalesce("_v", F.lit(0.0)).cast("double"))
    return lines.join(scaled.select(*on, "_v"), list(on), "left").withColumn(text, F.overlay(F.col(text), value, F.lit(61), F.lit(6))).drop("_v")


def only_chain(lines: DataFrame, text: str, chain: Column | str) -> DataFrame:
    """Of fixed-width structure lines the atoms of one chain, whatever stands between them."""
    wanted = F.lit(chain) if isinstance(chain, str) else chain
    return lines.where(F.trim(F.substring(text, 1, 6)).isin("ATOM", "HETATM") & (F.substring(text, 22, 1) == wanted))


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def unfinished(spark: SparkSession, jobs: DataFrame, path: str, key: Sequence[str], again: bool = False) -> DataFrame:
    """Jobs whose key is not in the log; all of them if there is no log, or `again`."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path)
    return jobs if again or not there else jobs.join(spark.read.parquet(path).select(*key).distinct(), list(key), "left_anti")


def cache_key(*parts: Column) -> Column:
    """SHA-1 over all parameters of a search, thresholds included."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def store(df: DataFrame, path: str, key: str) -> None:
    """Append results to a store that is partitioned by the first digit of their key."""
    df.withColumn("shelf", F.left(key, F.lit(1))).repartition("shelf").write.mode("append").partitionBy("shelf").parquet(path)


def look_up(spark: SparkSession, jobs: DataFrame, path: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(results that the store has, jobs that it lacks); a store that does not exist has none.

    Shelves prune the scan, and the key names every parameter, so that changed
    thresholds never meet old results. Results stored twice come once.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return jobs.limit(0), jobs
    asked = jobs.withColumn("shelf", F.left(key, F.lit(1)))
    kept = spark.read.parquet(path).withColumn("shelf", F.col("shelf").cast("string"))
    found = kept.join(asked.select("shelf", key).distinct(), ["shelf", key], "left_semi").dropDuplicates([key]).drop("shelf")
    return found, asked.join(kept.select("shelf", key).distinct(), ["shelf", key], "left_anti").drop("shelf")


def summary_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text in `value`, for `write.text`."""
    return df.select(F.to_json(F.struct("*")).alias("value"))
