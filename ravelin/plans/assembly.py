"""From source files to ranked positions and restraints of all pairs: one plan, bad pairs set aside, runs resumed.

Sources are scanned once for all pairs. A pair whose inputs do not fit each
other becomes a row of the status table with its reason, and costs nothing
further; the others are scored together. A run writes its tables below its own
name and enters its pairs in the log last, and readers follow the log, so a run
that dies leaves nothing that is read, and the next one takes up what is missing.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.functions import residues
from ravelin.operators import evidence
from ravelin.plans import pair_scoring
from ravelin.plans.staging import BROADCAST_ROWS, attach, stage
from ravelin.sources import sinks, text

#: Why a pair is set aside; of several reasons the first counts.
REASONS = ("no sequence", "repeated sequence", "sequence with gaps", "hit outside the sequence", "profile does not cover the sequence", "structure differs from the sequence", "coupling outside the matrix")


@dataclass(frozen=True)
class Sources:
    """Paths. Tables have headers: `conservation` protein, position, value; `coupling` accA, accB, i, j, score.

    `structures` holds a chain a file; `structure_id` finds the protein in the file's path.
    """

    pairs: str
    sequences: str
    hits: str
    interactions: str
    conservation: str
    coupling: str
    structures: str
    structure_id: str = r"([^/]+?)(?:\.[^./]*)?$"


@dataclass(frozen=True)
class Scans:
    """pairs (pair, a, b); sequences (protein, copies, sequence); hits; interactions (a, b); conservation (protein,
    position, value); coupling (pair, i, j, score); structures (protein, idx, letter, label)."""

    pairs: DataFrame
    sequences: DataFrame
    hits: DataFrame
    interactions: DataFrame
    conservation: DataFrame
    coupling: DataFrame
    structures: DataFrame


@dataclass(frozen=True)
class Assembly:
    ranked: DataFrame
    restraints: DataFrame
    status: DataFrame


def _pair() -> Column:
    return F.concat(F.coalesce("a", F.lit("")), F.lit("|"), F.coalesce("b", F.lit("")))


def scan(spark: SparkSession, sources: Sources) -> Scans:
    """The sources as tables. A number that cannot be read is null, which sets its pairs aside; hits are checked by their scan."""
    number = lambda c, kind: F.col(c).try_cast(kind).alias(c)
    records = text.fasta(spark, sources.sequences).groupBy(F.col("id").alias("protein")).agg(F.count(F.lit(1)).alias("copies"), F.min("sequence").alias("sequence"))
    coupling = text.pair_table(spark, sources.coupling).select(_pair().alias("pair"), number("i", "long"), number("j", "long"), number("score", "double"))
    label = F.concat(F.col("chain"), F.lit("."), F.col("name"), F.lit("."), F.col("number"), F.trim("insertion"))
    chain = text.residues(text.atoms(spark, sources.structures)).withColumn("protein", F.regexp_extract("path", sources.structure_id, 1))
    place = F.row_number().over(Window.partitionBy("protein").orderBy("chain", "idx")).cast("long")
    return Scans(
        pairs=text.pair_table(spark, sources.pairs).select(_pair().alias("pair"), "a", "b").distinct(),
        sequences=records,
        hits=text.hits(spark, sources.hits),
        interactions=text.pair_table(spark, sources.interactions).select("a", "b").distinct(),
        conservation=text.tsv(spark, sources.conservation, ["protein", "position", "value"]).select("protein", number("position", "long"), number("value", "double")),
        coupling=coupling,
        structures=chain.select("protein", place.alias("idx"), residues.one_letter(F.col("name")).alias("letter"), label.alias("label")),
    )


def _span() -> list[Column]:
    return [F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or("turned").alias("turned")]


def _spans(hits: DataFrame) -> DataFrame:
    return hits.withColumns({"low": F.col("qstart"), "high": F.col("qend"), "turned": F.col("qstart") > F.col("qend")})


def best_hits(hits: DataFrame) -> DataFrame:
    """(query, subject, qstart, qend, low, high, turned): the best hit of each subject, and what all its hits span.

    Both come from one scan, and combine before the shuffle.
    """
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate((-F.col("bitscore"), F.col("qstart"), F.col("qend"), F.col("sstart"), F.col("send")))])
    return _spans(hits).groupBy("query", "subject").agg(F.min_by(F.struct("qstart", "qend"), order).alias("_best"), *_span()).select("query", "subject", "_best.*", "low", "high", "turned")


def _defects(scans: Scans, spans: DataFrame) -> DataFrame:
    """(protein, reason): the first thing wrong with each protein that has anything wrong, as a place in REASONS."""
    known = scans.sequences.withColumn("l", F.length("sequence"))
    code = lambda name, test: F.when(F.coalesce(test, F.lit(True)), F.lit(REASONS.index(name))).alias("reason")
    own = known.select("protein", F.coalesce(F.when(F.col("copies") > 1, F.lit(1)), F.when(~F.col("sequence").rlike("^[A-Z]+$"), F.lit(2))).alias("reason"))
    # Each source is brought down to a row per protein before it meets the sequences.
    reach = spans.groupBy(F.col("query").alias("protein")).agg(*_span())
    hits = reach.join(known, "protein").select("protein", code("hit outside the sequence", (F.col("low") < 1) | (F.col("high") > F.col("l")) | F.col("turned")))
    cover = scans.conservation.groupBy("protein").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("position").alias("places"), F.min("position").alias("low"), F.max("position").alias("high"), F.count("value").alias("values"))
    whole = (F.col("n") == F.col("l")) & (F.col("places") == F.col("l")) & (F.col("low") == 1) & (F.col("high") == F.col("l")) & (F.col("values") == F.col("l"))
    profiles = cover.join(known, "protein").select("protein", code("profile does not cover the sequence", ~whole))
    letters = scans.structures.groupBy("protein").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "letter"))), lambda x: x["letter"]), "").alias("read"))
    structures = letters.join(known, "protein").select("protein", code("structure differs from the sequence", F.col("read") != F.col("sequence")))
    found = own.unionByName(hits).unionByName(profiles).unionByName(structures)
    return found.where("reason IS NOT NULL").groupBy("protein").agg(F.min("reason").alias("reason"))


def check(scans: Scans, best: DataFrame | None = None) -> DataFrame:
    """(pair, a, b, l1, l2, reason) of all pairs; `reason` is null where nothing is wrong.

    A protein without hits, profile or structure is no fault: that evidence is
    absent. `best` are the `best_hits`, where they are known already; without
    them the hits are scanned.
    """
    spans = _spans(scans.hits) if best is None else best
    proteins = stage(scans.sequences.withColumn("l", F.length("sequence").cast("long")).select("protein", "l").join(_defects(scans, spans), "protein", "left"), "proteins")
    rows = scans.pairs
    for side, length in (("a", "l1"), ("b", "l2")):
        one = proteins.select(F.col("protein").alias(side), F.col("l").alias(length), F.coalesce("reason", F.lit(len(REASONS))).alias(f"_{side}"))
        rows = attach(rows, one, [side], "left")
    matrix = scans.coupling.groupBy("pair").agg(*[f(c).alias(f"_{f.__name__}_{c}") for f in (F.min, F.max) for c in "ij"], F.bool_or(F.col("i").isNull() | F.col("j").isNull() | F.col("score").isNull()).alias("_unread"))
    rows = rows.join(matrix, "pair", "left")
    outside = F.col("_unread") | (F.col("_min_i") < 1) | (F.col("_min_j") < 1) | (F.col("_max_i") > F.col("l1")) | (F.col("_max_j") > F.col("l2"))
    first = F.least(F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0)), F.when(outside, F.lit(REASONS.index("coupling outside the matrix"))))
    reason = F.get(F.array(*[F.lit(r) for r in REASONS]), first)
    return rows.select("pair", "a", "b", "l1", "l2", reason.alias("reason"))


def _fragments(good: DataFrame, best: DataFrame, interactions: DataFrame) -> DataFrame:
    """(pair, i, j, score): for each cell the interacting subjects whose best hits on both sides cover it.

    Interactions come down to those between subjects of hits before they meet
    them, and hits to those of good pairs. Hits of a subject on one stretch of
    proteins are few stretches, so equal rectangles are summed before they are
    shuffled.
    """
    queries = good.select(F.explode(F.array("a", "b")).alias("query")).distinct()
    own = stage(best.join(F.broadcast(queries) if queries.count() <= BROADCAST_ROWS else queries, "query", "left_semi").select("query", "subject", "qstart", "qend"), "best-hits")
    subjects = stage(own.select("subject").distinct(), "hit-subjects")
    for end in ("a", "b"):
        interactions = attach(interactions.select("a", "b"), subjects.select(F.col("subject").alias(end)), [end], "left_semi")
    both = stage(interactions.unionByName(interactions.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "hit-interactions")
    one = own.select(F.col("query").alias("a"), F.col("subject").alias("s"), F.col("qstart").alias("i0"), F.col("qend").alias("i1"))
    two = own.select(F.col("query").alias("b"), F.col("subject").alias("t"), F.col("qstart").alias("j0"), F.col("qend").alias("j1"))
    pairs = stage(good.select("pair", "a", "b"), "good-pairs")
    left = attach(one, pairs, ["a"], "inner").select("pair", "b", "s", "i0", "i1")
    met = left.join(both.select(F.col("a").alias("s"), F.col("b").alias("t")), "s").join(two, ["b", "t"])
    alike = met.groupBy("pair", "i0", "i1", "j0", "j1").agg(F.count(F.lit(1)).alias("weight"))
    return evidence.rectangle_votes(alike, good.select("pair", "l1", "l2"), "weight").select("pair", "i", "j", F.col("votes").cast("double").alias("score"))


def cells(good: DataFrame, scans: Scans, best: DataFrame) -> DataFrame:
    """(pair, branch, i, j, score) of the good pairs, from all sources and the `best_hits`."""
    profile = scans.conservation.where("value > 0")
    left = good.select("pair", "b", F.col("a").alias("protein")).join(profile.select("protein", F.col("position").alias("i"), F.col("value").alias("_a")), "protein")
    right = profile.select(F.col("protein").alias("b"), F.col("position").alias("j"), F.col("value").alias("_b"))
    conserved = left.join(right, "b").select("pair", "i", "j", (F.col("_a") * F.col("_b")).alias("score"))
    coupled = scans.coupling.join(good.select("pair"), "pair", "left_semi").groupBy("pair", "i", "j").agg(F.max("score").alias("score")).where("score > 0")
    parts = {"fragments": _fragments(good, best, scans.interactions), "conservation": conserved, "coupling": coupled}
    out = None
    for branch, part in parts.items():
        named = part.select("pair", F.lit(branch).alias("branch"), "i", "j", "score")
        out = named if out is None else out.unionByName(named)
    return out


def _restraints(ranked: DataFrame, active: int, passive: int) -> DataFrame:
    """(pair, n, line): the best positions with a place in the structure, actives of both sides before passives."""
    role = F.when(F.col("rank") <= active, 0).when(F.col("rank") <= active + passive, 1)
    chosen = ranked.where("final > 0 AND label IS NOT NULL").withColumn("role", role).where("role IS NOT NULL")
    one = chosen.groupBy("pair", "side", "label").agg(F.min("role").alias("role"), F.min("rank").alias("rank"))
    n = F.row_number().over(Window.partitionBy("pair").orderBy("role", "side", "rank")).cast("long")
    code = F.when(F.col("side") == 1, "R").otherwise("L")
    return one.select("pair", n.alias("n"), F.concat_ws(" ", code, "label", F.when(F.col("role") == 1, F.lit("P"))).alias("line"))


def assemble(scans: Scans, anchors: Mapping[str, float] | None = None, top_k: int = 3, seeds: int = 4, radius: int = 4, active: int = 10, passive: int = 10) -> Assembly:
    """`ranked`: a row per position of both sides of every good pair, with letter, label and components;
    `restraints` for docking; `status`: a row per pair, `scored` or `quarantined` with its reason."""
    anchors = {"coupling": 0.35} if anchors is None else dict(anchors)
    best = stage(best_hits(scans.hits), "subject-hits")
    checked = stage(check(scans, best), "checked")
    good = checked.where("reason IS NULL")
    found = stage(pair_scoring.normalise(cells(good, scans, best), ["coupling"]), "cells")
    scored = pair_scoring.score_pairs(found, good.select("pair", "l1", "l2"), anchors, top_k, seeds, radius)
    ends = good.select("pair", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("a").alias("protein")), F.struct(F.lit(2).alias("side"), F.col("b").alias("protein")))).alias("e")).select("pair", "e.*")
    letters = ends.join(scans.sequences.select("protein", "sequence"), "protein")
    named = scored.join(letters, ["pair", "side"]).withColumn("letter", F.substr("sequence", F.col("idx").cast("int"), F.lit(1))).drop("sequence")
    ranked = stage(named.join(scans.structures.select("protein", "idx", "label"), ["protein", "idx"], "left"), "ranked")
    return Assembly(ranked, _restraints(ranked, active, passive), verdicts(checked))


def verdicts(checked: DataFrame) -> DataFrame:
    """(pair, status, reason) of checked pairs, which need not be scored for it."""
    state = F.when(F.col("reason").isNull(), "scored").otherwise("quarantined")
    return checked.select("pair", state.alias("status"), "reason")


def run(spark: SparkSession, sources: Sources, out: str, again: bool = False, **options) -> str:
    """Score the pairs that the log of `out` does not have, or all with `again`; the name of the run.

    `ranked` and `restraints` of the run are written before its pairs enter the
    log. Set-aside pairs enter it too; `again` retries them once their files are mended.
    """
    name = f"r{uuid.uuid4().hex}"
    scans = scan(spark, sources)
    todo = stage(sinks.unfinished(spark, scans.pairs, f"{out}/log", ["pair"], again), "todo")
    done = assemble(Scans(**{**scans.__dict__, "pairs": todo}), **options)
    for table in ("ranked", "restraints"):
        getattr(done, table).write.parquet(f"{out}/{table}/run={name}")
    sinks.append_log(done.status.withColumns({"run": F.lit(name), "at": F.current_timestamp()}), f"{out}/log")
    return name


def status(spark: SparkSession, out: str) -> DataFrame:
    """(pair, status, reason, run): each pair as its last run left it."""
    last = F.max_by(F.struct("status", "reason", "run"), F.struct("at", "run")).alias("l")
    return spark.read.parquet(f"{out}/log").groupBy("pair").agg(last).select("pair", "l.*")


def results(spark: SparkSession, out: str, table: str) -> DataFrame:
    """`ranked` or `restraints` of all pairs, each from the run that the log names last."""
    return spark.read.parquet(f"{out}/{table}").join(status(spark, out).select("pair", "run"), ["pair", "run"], "left_semi").drop("run")
