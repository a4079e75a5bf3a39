"""Evidence from several sources: universe, metadata, expansion, transfer, evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.plans.staging import attach, stage


def universe(evidence: DataFrame, a: str, b: str, taxid_a: str, taxid_b: str, source: str) -> DataFrame:
    """(protein, sources, taxids): sorted sets over both ends of every evidence row."""
    ends = F.explode(F.array(F.struct(F.col(a).alias("protein"), F.col(taxid_a).cast("string").alias("taxid")), F.struct(F.col(b).alias("protein"), F.col(taxid_b).cast("string").alias("taxid"))))
    rows = evidence.select(F.col(source).alias("source"), ends.alias("e")).select("source", "e.*")
    return rows.groupBy("protein").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("taxid")).alias("taxids"))


def add_metadata(df: DataFrame, metadata: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Left join with the first metadata row of each key; columns that `df` has are kept as they are."""
    new = [c for c in metadata.columns if c not in df.columns and c not in order]
    first = metadata.groupBy(key).agg(F.min_by(F.struct(*new), F.struct(*order)).alias("_m"))
    return df.join(first.select(key, *[F.col(f"_m.{c}").alias(c) for c in new]), key, "left")


def enrich(df: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Fills `value` of rows that lack it from `table`, whose first known value of a key, the smallest, counts."""
    known = table.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias("_known"))
    return df.join(known, key, "left").withColumn(value, F.coalesce(value, "_known")).drop("_known")


def merge_scores(base: DataFrame, other: DataFrame, key: Sequence[str], source: str) -> DataFrame:
    """One-to-one left join; a key that is twice in `other` stops the job, columns of one name get `__from_<source>`."""
    names = {c: f"{c}__from_{source}" if c in base.columns else c for c in other.columns if c not in key}
    told = F.concat_ws(",", *[F.col(c).cast("string") for c in key])
    rows = F.count(F.lit(1)).over(Window.partitionBy(*key))
    checked = F.when(rows > 1, F.raise_error(F.concat(F.lit("duplicate key "), told)).cast("boolean")).otherwise(F.lit(True))
    renamed = other.withColumn("_one", checked).where("_one").select(*key, *[F.col(c).alias(n) for c, n in names.items()])
    return base.join(renamed, list(key), "left")


def expand_chains(entities: DataFrame, key: str, receptors: str, ligands: str) -> DataFrame:
    """(key, pair_number, receptor, ligand): every receptor chain with every ligand chain, numbered in order."""
    rows = entities.select(key, F.posexplode(receptors).alias("_i", "receptor"), ligands).select(key, "_i", "receptor", F.posexplode(ligands).alias("_j", "ligand"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("_i", "_j")).cast("long")
    return rows.select(key, number.alias("pair_number"), "receptor", "ligand")


def by_priority(sources: Sequence[DataFrame], key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First source that has a wanted key decides, its first row in order of all columns; and the keys that none has."""
    ranked = None
    for n, df in enumerate(sources):
        part = df.withColumn("priority", F.lit(n))
        ranked = part if ranked is None else ranked.unionByName(part)
    asked = wanted.select(key).distinct()
    rest = [c for c in ranked.columns if c not in (key, "priority")]
    found = ranked.join(asked, key, "left_semi").groupBy(key).agg(F.min(F.struct("priority", *rest)).alias("_f")).select(key, "_f.*")
    return found, asked.join(found, key, "left_anti")


def annotate(df: DataFrame, group: Sequence[str], label: str, score: str, quantile: float = 0.75) -> DataFrame:
    """Adds positives and peak of each group, the quantile of non-zero peaks over all groups, and `is_primary`: positives and a peak at or above it."""
    groups = df.groupBy(*group).agg(F.sum(F.col(label).cast("long")).alias("positives"), F.max(score).alias("peak"))
    cut = groups.agg(F.percentile(F.when(F.col("peak") > 0, F.col("peak")), F.lit(quantile)).alias("peak_quantile"))
    marked = groups.crossJoin(F.broadcast(cut)).withColumn("is_primary", (F.col("positives") > 0) & (F.col("peak") >= F.col("peak_quantile")))
    return df.join(marked, list(group), "left")


def transfer_contacts(contacts: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(entry, i, j): contacts of a template between chains, carried to both queries in both directions.

    `contacts` has entry, chain_a, pos_a, chain_b, pos_b; the maps have entry,
    chain, pos and query position `at`, with `evalue` and `bits` of their hit.
    Of an entry's chain pairs the one with the best left hit, then right hit,
    counts. It is found from the best hit of each template position, and only
    its contacts are carried, one side after the other and each place once, so
    that hits on one position do not multiply each other.
    """
    hit = F.struct("evalue", (-F.col("bits")).alias("bits"))
    ends = lambda c, p: (F.col("chain").alias(c), F.col("pos").alias(p))
    one = lambda a, b: contacts.select("entry", F.col(f"chain_{a}").alias("cl"), F.col(f"pos_{a}").alias("pl"), F.col(f"chain_{b}").alias("cr"), F.col(f"pos_{b}").alias("pr"))
    both = stage(one("a", "b").unionByName(one("b", "a")).distinct(), "contacts")
    places = [stage(m.groupBy("entry", "chain", "pos", "at").agg(F.min(hit).alias("hit")), "places") for m in (left, right)]
    l, r = (m.groupBy("entry", *ends(c, p)).agg(F.min("hit").alias(h)) for m, c, p, h in ((places[0], "cl", "pl", "hl"), (places[1], "cr", "pr", "hr")))
    met = both.join(l, ["entry", "cl", "pl"]).join(r, ["entry", "cr", "pr"])
    best = met.groupBy("entry").agg(F.min(F.struct("hl", "hr", "cl", "cr")).alias("b")).select("entry", "b.cl", "b.cr")
    kept = attach(both, stage(best, "best-chains"), ["entry", "cl", "cr"], "inner")
    i, j = (m.select("entry", *ends(c, p), F.col("at").alias(n)) for m, c, p, n in ((places[0], "cl", "pl", "i"), (places[1], "cr", "pr", "j")))
    half = kept.join(i, ["entry", "cl", "pl"]).select("entry", "i", "cr", "pr").distinct()
    return half.join(j, ["entry", "cr", "pr"]).select("entry", "i", "j").distinct()


def paired_rows(pairs: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str, key: str, row: str) -> DataFrame:
    """Pairs whose both ends have an aligned row, with both rows joined to one text."""
    l, r = left.select(F.col(key).alias(a), F.col(row).alias("_l")), right.select(F.col(key).alias(b), F.col(row).alias("_r"))
    return pairs.join(l, a).join(r, b).withColumn("paired", F.concat("_l", "_r")).drop("_l", "_r")


def evaluate_roles(predictions: DataFrame, mapping: DataFrame, interface: DataFrame, query: str, position: str, role: str) -> DataFrame:
    """Per query and role: rows, rows that map to the bound structure, interface rows, and precision over mapped rows."""
    mapped = predictions.join(mapping.select(query, position, F.col("bound").alias("_bound")), [query, position], "left")
    hit = interface.select(query, F.col("bound").alias("_bound")).distinct().withColumn("_hit", F.lit(1))
    rows = mapped.join(hit, [query, "_bound"], "left")
    sums = rows.groupBy(query, role).agg(F.count(F.lit(1)).alias("n"), F.count("_bound").alias("mapped"), F.count("_hit").alias("hits"))
    return sums.withColumn("precision", F.try_divide(F.col("hits").cast("double"), F.col("mapped")))


def map_reason(tests: Sequence[tuple[str, Column]]) -> Column:
    """All failed tests by name, or `ok`."""
    failed = F.concat_ws(",", *[F.when(~F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests])
    return F.when(failed == "", "ok").otherwise(failed)


def rectangle_votes(rectangles: DataFrame, sizes: DataFrame, weight: str | None = None) -> DataFrame:
    """(pair, i, j, votes): how many rectangles (pair, i0, i1, j0, j1), ends included, cover a cell, where any does.

    With `weight`, a whole number, a rectangle counts as so many.

    A rectangle is four corners, which are summed per cell before they are
    shuffled; running sums along both axes of a pair's `l1` x `l2` cells give
    the votes. So the work goes by rectangles plus cells, not by their product,
    and a window holds one row or column of a matrix.
    """
    corner = lambda i, j, d: F.struct(F.expr(i).cast("long").alias("i"), F.expr(j).cast("long").alias("j"), F.lit(d).alias("d"))
    four = F.array(corner("i0", "j0", 1), corner("i1 + 1", "j0", -1), corner("i0", "j1 + 1", -1), corner("i1 + 1", "j1 + 1", 1))
    weighed = rectangles.withColumn("_w", F.lit(1) if weight is None else F.col(weight))
    corners = weighed.select("pair", "_w", F.explode(four).alias("c")).groupBy("pair", "c.i", "c.j").agg(F.sum(F.col("c.d") * F.col("_w")).alias("d"))
    line = lambda l: F.explode(F.sequence(F.lit(1).cast("long"), F.col(l).cast("long")))
    grid = sizes.where("l1 > 0 AND l2 > 0").select("pair", "l2", line("l1").alias("i")).select("pair", "i", line("l2").alias("j"))
    filled = grid.join(corners, ["pair", "i", "j"], "left").withColumn("d", F.coalesce("d", F.lit(0)))
    along = lambda axis, other: F.sum("d").over(Window.partitionBy("pair", other).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0))
    return filled.withColumn("d", along("j", "i")).withColumn("d", along("i", "j")).where("d > 0").select("pair", "i", "j", F.col("d").alias("votes"))
