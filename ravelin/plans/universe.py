"""The interaction universe: evidence of three kinds of sources, pairs with provenance, proteins, accounting.

Every source gives rows (source, n, reason, p1, p2, taxid_1, taxid_2, method,
method_id); rows with reason `kept` are evidence. Sources are scanned apart and
united; an evidence tuple's taxids are those of the row that brought it first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions import identifiers
from ravelin.operators import aggregates, joins

# Interaction types that are not physical, and alias sources by priority.
NON_PHYSICAL = ("mi:0208", "genetic interaction", "synthetic lethality", "synthetic rescue", "synthetic growth defect", "synthetic haploinsufficiency", "dosage growth defect", "dosage lethality", "dosage rescue", "epistasis", "suppression", "phenotypic enhancement", "phenotypic suppression")
ALIAS_PRIORITY = {"UniProt_AC": 0, "Ensembl_UniProt": 1, "BLAST_UniProt_AC": 2}

KEY = ["p1", "p2", "method", "method_id", "source"]


def _finish(df: DataFrame, source: str, reason: Column, a: Column, b: Column, tax_a: Column, tax_b: Column, terms: Column) -> DataFrame:
    p1, p2, t1, t2 = identifiers.ordered_pair(a, b, (tax_a, tax_b))
    # A row's place is that of `text.line_order`; a plain number is a place in one nameless file.
    numbered = df.schema["n"].dataType.typeName() != "struct"
    n = F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("at")) if numbered else F.col("n")
    row = F.struct(F.lit(source).alias("source"), n.alias("n"), reason.alias("reason"), p1.alias("p1"), p2.alias("p2"), t1.alias("taxid_1"), t2.alias("taxid_2"), terms.alias("terms"))
    # A filter by reason stays behind a generator; pushed down, it would parse each row again.
    rows = df.select(F.inline(F.array(row))).select("*", F.explode("terms").alias("t"))
    return rows.select("source", "n", "reason", "p1", "p2", "taxid_1", "taxid_2", F.col("t.label").alias("method"), F.col("t.id").alias("method_id"))


def _with_ends(rows: DataFrame, fields: dict[str, list[Column]]) -> DataFrame:
    """Adds (value, status) of each end under its name; fields are parsed once, in columns of their own."""
    lists = {f"{end}{i}": identifiers.candidates(c, identifiers.accession_strict) for end, columns in fields.items() for i, c in enumerate(columns)}
    chosen = {end: identifiers.first_candidates([F.col(f"{end}{i}") for i in range(len(columns))]) for end, columns in fields.items()}
    return rows.withColumns(lists).withColumns(chosen).drop(*lists).withColumns({end: identifiers.told(F.col(end)) for end in fields})


def _mapped(side: str, status: Column) -> tuple[str, Column]:
    return f"map_{side}", status != "ok"


def molecular(rows: DataFrame, drop_expanded: bool = False) -> DataFrame:
    """Tab-separated molecular interactions: `columns` of at least 36 fields and row order `n`."""
    c = lambda i: F.col("columns")[i]
    kind = F.lower(c(11))
    protein = lambda f: f.rlike(r"(?i)\(protein\)|protein\s*(?:\||$)")
    found = _with_ends(rows, {"_a": [c(0), c(2)], "_b": [c(1), c(3)]})
    expanded = F.lit(drop_expanded) & ~c(15).isin("", "-")
    reason = joins.first_reason([("negative", F.lower(F.trim(c(35))) == "true"), ("nonphysical", F.greatest(*[F.contains(kind, F.lit(t)) for t in NON_PHYSICAL])), ("expanded", expanded), ("nonprotein", ~(protein(c(20)) & protein(c(21)))), _mapped("a", F.col("_a.status")), _mapped("b", F.col("_b.status"))])
    return _finish(found, "IntAct", reason, F.col("_a.value"), F.col("_b.value"), identifiers.taxid(c(9)), identifiers.taxid(c(10)), identifiers.terms(c(6)))


def experimental(rows: DataFrame) -> DataFrame:
    """Tab-separated curated interactions: `columns` of at least 29 fields and row order `n`; reviewed accessions come first."""
    c = lambda i: F.col("columns")[i]
    found = _with_ends(rows, {"_a": [c(23), c(24)], "_b": [c(26), c(27)]})
    reason = joins.first_reason([("nonphysical", c(12) != "physical"), _mapped("a", F.col("_a.status")), _mapped("b", F.col("_b.status"))])
    method = F.when(c(11) == "", "-").otherwise(c(11))
    return _finish(found, "BioGRID", reason, F.col("_a.value"), F.col("_b.value"), identifiers.taxid(c(15)), identifiers.taxid(c(16)), F.array(F.struct(method.alias("label"), identifiers.slug(c(11), "biogrid").alias("id"))))


def resolve_aliases(aliases: DataFrame) -> DataFrame:
    """(string_id, accession) of (string_id, alias, source): the best source decides; two accessions at it give none."""
    priority = F.create_map(*[F.lit(x) for pair in ALIAS_PRIORITY.items() for x in pair])[F.col("source")]
    known = aliases.withColumn("priority", priority).withColumn("accession", identifiers.accession_strict(F.col("alias"))).where("priority IS NOT NULL AND accession IS NOT NULL")
    return aggregates.best_unambiguous(known, ["string_id"], "priority", "accession", "accession").where("accession IS NOT NULL")


def scored_links(links: DataFrame, accessions: DataFrame, least: int = 400) -> DataFrame:
    """Links with `n`, both ends mapped; every positive channel beside the combined score is evidence, or one generic row.

    Ends read `taxid.name`. `accessions` comes from `resolve_aliases`.
    """
    one = accessions.select(F.col("string_id").alias("protein1"), F.col("accession").alias("_a"))
    two = accessions.select(F.col("string_id").alias("protein2"), F.col("accession").alias("_b"))
    both = links.join(one, "protein1", "left").join(two, "protein2", "left")
    channels = [c for c in links.columns if c not in ("n", "protein1", "protein2", "combined_score")]
    some = F.filter(F.array(*[F.struct(F.lit(f"STRING {c.replace('_', ' ')} channel").alias("label"), F.lit(f"string:{c}").alias("id"), F.col(c).alias("v")) for c in channels]), lambda t: t["v"] > 0) if channels else F.array()
    named = F.transform(some, lambda t: F.struct(t["label"].alias("label"), t["id"].alias("id"))) if channels else F.array().cast("array<struct<label:string,id:string>>")
    terms = F.when(F.size(named) > 0, named).otherwise(F.array(F.struct(F.lit("STRING physical link").alias("label"), F.lit("string:physical_link").alias("id"))))
    reason = joins.first_reason([("low_score", F.coalesce(F.col("combined_score") < least, F.lit(True))), ("map_a", F.col("_a").isNull()), ("map_b", F.col("_b").isNull())])
    tax = lambda c: identifiers.taxid(F.split(c, r"\.")[0])
    return _finish(both, "STRING", reason, F.col("_a"), F.col("_b"), tax("protein1"), tax("protein2"), terms)


def evidence(rows: DataFrame) -> DataFrame:
    """Distinct evidence tuples with the taxids of their first rows."""
    kept = rows.where("reason = 'kept'")
    return aggregates.first_writer(kept, KEY, ["n", "taxid_1", "taxid_2"], ["taxid_1", "taxid_2"])


def pairs(unique: DataFrame) -> DataFrame:
    """One row per pair: sorted sets of sources, methods, ids and taxids, support, and species flags."""
    sets = lambda c: F.array_sort(F.collect_set(c))
    same = F.coalesce(F.col("taxid_1") == F.col("taxid_2"), F.lit(False))
    cross = F.coalesce(F.col("taxid_1") != F.col("taxid_2"), F.lit(False))
    return unique.groupBy("p1", "p2").agg(sets("source").alias("sources"), sets("method").alias("methods"), sets("method_id").alias("method_ids"), F.count(F.lit(1)).alias("support"), sets("taxid_1").alias("taxids_1"), sets("taxid_2").alias("taxids_2"), F.bool_or(same).alias("same_species"), F.bool_or(cross).alias("cross_species"), F.bool_or(F.col("p1") == F.col("p2")).alias("self_interaction"))


def accounting(rows: DataFrame, unique: DataFrame) -> DataFrame:
    """(source, outcome, n): source rows by reason, kept ones parted into new and duplicate evidence."""
    terms = rows.where("reason = 'kept'").groupBy("source").agg(F.count(F.lit(1)).alias("all")).join(unique.groupBy("source").agg(F.count(F.lit(1)).alias("new")), "source")
    parted = terms.select("source", F.explode(F.array(F.struct(F.lit("evidence").alias("outcome"), F.col("new").alias("n")), F.struct(F.lit("duplicate").alias("outcome"), (F.col("all") - F.col("new")).alias("n")))).alias("x")).select("source", "x.*")
    dropped = rows.where("reason <> 'kept'").groupBy("source", F.col("reason").alias("outcome")).agg(F.count_distinct("n").alias("n"))
    return parted.unionByName(dropped)
