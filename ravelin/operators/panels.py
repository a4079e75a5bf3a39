"""Evaluation over overlapping subsets at once: curves, top-k and budgets.

A subset is a name and a condition; a row belongs to as many as hold. Rows are
first counted by the set of their subsets and their score, and only then dealt
to subsets, so a subset costs a row per distinct score. Running counts and
ranks of all subsets come from one sort by range (`running_before`), so no
subset and no group, however large, is a window or a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.plans.staging import attach, running_before, stage

Subsets = Mapping[str, Column]
#: Two counts in one number, so that one running sum serves both.
_PLACE = 10**18
#: Harmonic numbers below this are listed, from it on computed.
_LISTED = 32


def _both(high: Column, low: Column) -> Column:
    return (high.cast("decimal(19,0)") * F.lit(_PLACE).cast("decimal(19,0)") + low).cast("decimal(38,0)")


def _parted(name: str) -> tuple[Column, Column]:
    return F.expr(f"{name} div {_PLACE}").cast("long"), F.expr(f"{name} % {_PLACE}").cast("long")


def _members(subsets: Subsets) -> Column:
    """Names of the subsets that a row belongs to."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in subsets.items()]))


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n, 0 for 0; exact to twelve digits."""
    table = [0.0]
    for i in range(1, _LISTED):
        table.append(table[-1] + 1.0 / i)
    x = n.cast("double")
    far = F.log(x) + F.lit(0.5772156649015329) + 0.5 / x - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    return F.when(n < _LISTED, F.element_at(F.array(*map(F.lit, table)), F.least(n, F.lit(_LISTED - 1)).cast("int") + 1)).otherwise(far)


def curves(df: DataFrame, subsets: Subsets, score: str, label: str, cut: float = 0.5) -> DataFrame:
    """A row per subset: rows, positives, negatives, scored, roc_auc, both average precisions, best F1 and its threshold, Brier score, confusion at `cut` and mcc.

    Labels are 0 or 1; rows without one are not counted, those without a score
    count as rows but stand in no curve. Ties of scores are one threshold; the
    conservative average precision puts the negatives of a tie first. Values
    that need both classes, or a positive, are null without. A subset without
    a labelled row has no row; so has an empty table.
    """
    known = df.where(F.col(label).isin(0, 1)).select(_members(subsets).alias("_in"), F.col(score).cast("double").alias("score"), F.col(label).cast("long").alias("y"))
    known = known.withColumn("score", F.when(~F.isnan("score"), F.col("score")))
    cube = known.groupBy("_in", "score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    cells = stage(cube.withColumn("subset", F.explode("_in")).groupBy("subset", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "curve-cells")
    there = F.col("score").isNotNull()
    sums = cells.groupBy("subset").agg(F.sum(F.col("pos") + F.col("neg")).alias("rows"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum(F.when(there, F.col("pos"))).alias("_p"), F.sum(F.when(there, F.col("neg"))).alias("_n"))
    sums = stage(sums, "curve-totals")
    ran = running_before(cells.where(there).withColumn("_down", -F.col("score")), ["subset"], ["_down"], _both(F.col("pos"), F.col("neg")), "_seen", "curves")
    c, s = _parted("_seen")
    at = attach(ran.withColumn("_c", c).withColumn("_s", s).drop("_seen"), sums, ["subset"], "inner")
    pos, neg = F.col("pos"), F.col("neg")
    won = pos * (F.col("_n") - F.col("_s") - neg + neg / 2.0)
    # Of a tie the i-th positive adds (c + i) / (r + i), where r rows come before all of its positives.
    r = F.col("_c") + F.col("_s") + neg
    steps = pos - (r - F.col("_c")) * (harmonic(r + pos) - harmonic(r))
    block = pos * (F.col("_c") + pos) / (r + pos).cast("double")
    f1 = 2.0 * (F.col("_c") + pos) / (r + pos + F.col("_p"))
    kept = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    yes = F.col("score") >= cut
    out = at.groupBy("subset").agg(
        F.sum(won).alias("_won"), F.sum(F.when(pos > 0, steps)).alias("_steps"), F.sum(F.when(pos > 0, block)).alias("_block"), F.max(F.when(F.col("_p") > 0, F.struct(f1.alias("f"), F.col("score").alias("t")))).alias("_f"),
        F.sum(pos * (kept - 1) * (kept - 1) + neg * kept * kept).alias("_b"), *[F.coalesce(F.sum(F.when(test, c)), F.lit(0)).alias(n) for n, test, c in (("tp", yes, pos), ("fp", yes, neg), ("fn", ~yes, pos), ("tn", ~yes, neg))],
    )
    p, n = (F.col(c).cast("double") for c in ("_p", "_n"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    norm = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    whole = sums.join(out, "subset", "left")
    return whole.select(
        "subset", "rows", "positives", "negatives", F.coalesce(F.col("_p") + F.col("_n"), F.lit(0)).alias("scored"), F.try_divide(F.col("_won"), p * n).alias("roc_auc"), F.try_divide(F.col("_steps"), p).alias("ap_conservative"), F.try_divide(F.col("_block"), p).alias("ap_block"),
        F.col("_f.f").alias("best_f1"), F.col("_f.t").alias("threshold"), F.try_divide(F.col("_b"), p + n).alias("brier"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "tn")], F.when(norm > 0, (tp * tn - fp * fn) / norm).otherwise(F.lit(0.0)).alias("mcc"),
    )


def _ranked(long: DataFrame, keys: list[str], score: str, ties: Sequence[str], name: str) -> DataFrame:
    """`long` with `rank` from 1 by falling score, rows without one last, then by `ties`."""
    ordered = long.withColumn("_none", F.col(score).isNull()).withColumn("_down", -F.col(score))
    return running_before(ordered, keys, ["_none", "_down", *ties], F.lit(1), "_before", name).withColumn("rank", F.col("_before") + 1).drop("_none", "_down", "_before")


def _key(group: Sequence[str]) -> Column:
    return F.to_json(F.struct(*group))


def top_k(df: DataFrame, subsets: Subsets, group: Sequence[str], score: str, label: str, ties: Sequence[str], sizes: Mapping[str, Column]) -> DataFrame:
    """A row per subset and size: groups by kind, and means of precision, recall and enrichment over the evaluated ones.

    A size is an expression over `n`, the group's rows: a number or a share,
    taken as at least one row and at most all. Groups without a positive are
    not evaluated, nor those with a row without a score, which are counted as
    missing; groups of one score are counted as constant. `ties` with `score`
    order a group's rows. Means are null where nothing is evaluated.
    """
    scored = F.col(score).cast("double")
    rows = df.select(F.explode(_members(subsets)).alias("subset"), _key(group).alias("group"), F.when(~F.isnan(scored), scored).alias("score"), F.coalesce(F.col(label) == 1, F.lit(False)).cast("long").alias("y"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(ties)])
    rows = stage(rows, "top-rows")
    groups = rows.groupBy("subset", "group").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"), F.count("score").alias("scored"), (F.min("score") == F.max("score")).alias("constant"))
    groups = stage(groups, "top-groups")
    good = groups.where("positives > 0 AND scored = n")
    each = F.array(*[F.struct(F.lit(s).alias("size"), F.greatest(F.lit(1), F.least(F.ceil(k), F.col("n"))).cast("long").alias("k")) for s, k in sizes.items()])
    ranked = _ranked(rows.where("y = 1 OR score IS NOT NULL"), ["subset", "group"], "score", [f"_t{i}" for i in range(len(ties))], "top-ranks")
    hits = attach(ranked.where("y = 1"), stage(good, "top-good"), ["subset", "group"], "inner").select("subset", "group", "n", "positives", "rank", F.inline(each))
    # Every evaluated group has a positive, and so rows here for each size.
    cells = hits.groupBy("subset", "group", "size", "k", "n", "positives").agg(F.count_if(F.col("rank") <= F.col("k")).alias("tp"))
    precision = F.col("tp") / F.col("k").cast("double")
    means = cells.groupBy("subset", "size").agg(F.avg(precision).alias("precision"), F.avg(F.col("tp") / F.col("positives").cast("double")).alias("recall"), F.avg(precision * F.col("n") / F.col("positives")).alias("enrichment"))
    kinds = groups.groupBy("subset").agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("positives") == 0).alias("without_positive"), F.count_if((F.col("positives") > 0) & (F.col("scored") < F.col("n"))).alias("missing_score"), F.count_if((F.col("positives") > 0) & (F.col("scored") == F.col("n"))).alias("evaluated"), F.count_if((F.col("positives") > 0) & (F.col("scored") == F.col("n")) & F.col("constant")).alias("constant_score"))
    return kinds.select("*", F.explode(F.array(*map(F.lit, sizes))).alias("size")).join(means, ["subset", "size"], "left")


def budgets(df: DataFrame, subsets: Subsets, universes: Subsets, group: Sequence[str], methods: Sequence[str], label: str, ties: Sequence[str], sizes: Mapping[str, Column]) -> DataFrame:
    """A row per subset, universe, method and budget: what is recovered if each group may choose so many rows.

    A universe is the part of a group that may be chosen from, such as its
    surface. Groups with a positive anywhere in the subset are evaluated, also
    where none of their rows is in the universe. A budget is an expression over
    `n`, rows of the group in the universe, `inside`, positives among them, and
    `positives`, those of the whole group; it is rounded up, and no more than
    `n`. Rows without a score rank last. False negatives and recall are given
    against the universe and against the whole group.
    """
    rows = df.select(F.explode(_members(subsets)).alias("subset"), _key(group).alias("group"), F.coalesce(F.col(label) > 0, F.lit(False)).cast("long").alias("y"), _members(universes).alias("_where"), F.array(*[F.struct(F.lit(m).alias("method"), F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double")).alias("score")) for m in methods]).alias("_m"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(ties)])
    rows = stage(rows, "budget-rows")
    whole = rows.groupBy("subset", "group").agg(F.sum("y").alias("positives")).where("positives > 0")
    inside = rows.select("subset", "group", "y", F.explode("_where").alias("universe")).groupBy("subset", "group", "universe").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("inside"))
    every = whole.select("*", F.explode(F.array(*map(F.lit, universes))).alias("universe")).join(inside, ["subset", "group", "universe"], "left").fillna(0, ["n", "inside"])
    each = F.array(*[F.struct(F.lit(b).alias("budget"), F.greatest(F.lit(0), F.least(F.ceil(k), F.col("n"))).cast("long").alias("k")) for b, k in sizes.items()])
    every = stage(every.select("*", F.inline(each)), "budget-groups")
    tie = [f"_t{i}" for i in range(len(ties))]
    long = rows.select("subset", "group", "y", *tie, F.explode("_where").alias("universe"), "_m").select("subset", "group", "y", *tie, "universe", F.inline("_m"))
    ranked = _ranked(long, ["subset", "group", "universe", "method"], "score", tie, "budget-ranks").where("y = 1").select("subset", "group", "universe", "method", "rank")
    # Only positives meet their groups' budgets; what else is chosen follows from the budget.
    found = ranked.join(every.select("subset", "group", "universe", "budget", "k"), ["subset", "group", "universe"]).groupBy("subset", "group", "universe", "method", "budget").agg(F.count_if(F.col("rank") <= F.col("k")).alias("tp"))
    cells = every.select("*", F.explode(F.array(*map(F.lit, methods))).alias("method")).join(found, ["subset", "group", "universe", "method", "budget"], "left").fillna(0, ["tp"])
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    sums = cells.groupBy("subset", "universe", "method", "budget").agg(
        F.count(F.lit(1)).alias("groups"), F.count_if(F.col("k") > 0).alias("choosing"), *[F.sum(c).alias(o) for c, o in (("n", "candidates"), ("k", "selected"), ("positives", "positives"), ("inside", "inside"), ("tp", "tp"))],
        F.avg(share("tp", "k")).alias("mean_precision"), F.avg(share("tp", "inside")).alias("mean_recall"),
    )
    out = sums.withColumn("fp", F.col("selected") - F.col("tp")).withColumn("fn_inside", F.col("inside") - F.col("tp")).withColumn("fn", F.col("positives") - F.col("tp"))
    out = out.withColumn("precision", share("tp", "selected")).withColumn("recall_inside", share("tp", "inside")).withColumn("recall", share("tp", "positives"))
    f1 = lambda r: F.try_divide(2 * F.col("precision") * F.col(r), F.col("precision") + F.col(r))
    return out.withColumn("f1_inside", f1("recall_inside")).withColumn("f1", f1("recall"))
