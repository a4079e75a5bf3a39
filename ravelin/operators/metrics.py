"""Evaluation of scores against 0/1 labels, per group.

Curves are built from one row per (group, score), so that ties are settled
before any window and the windows see distinct scores only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL = Window.unboundedPreceding


def by_score(df: DataFrame, group: Sequence[str], score: str, label: str) -> DataFrame:
    """(group, score, pos, neg) for every distinct score; null scores and labels are left out."""
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(*group, score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))


def roc_auc(df: DataFrame, group: Sequence[str], score: str, label: str) -> DataFrame:
    """Chance that a positive outranks a negative, ties half; null unless a group has both."""
    counts = by_score(df, group, score, label)
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*group).orderBy(score).rowsBetween(ALL, -1)), F.lit(0))
    won = counts.withColumn("_won", F.col("pos") * (below + F.col("neg") / F.lit(2.0)))
    sums = won.groupBy(*group).agg(F.sum("_won").alias("_w"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return sums.select(*group, "n_pos", "n_neg", F.try_divide(F.col("_w"), F.col("n_pos").cast("double") * F.col("n_neg")).alias("roc_auc"))


def average_precision(df: DataFrame, group: Sequence[str], score: str, label: str) -> DataFrame:
    """Average precision under both tie rules.

    `ap_conservative` puts the negatives of a tie first: a tie of p positives
    after s seen rows, c of them positive, and n negatives adds the sum over
    i = 1..p of (c + i) / (s + n + i). `ap_block` takes a tie as one threshold.
    """
    counts = by_score(df, group, score, label)
    before = Window.partitionBy(*group).orderBy(F.col(score).desc()).rowsBetween(ALL, -1)
    seen = counts.withColumn("_c", F.coalesce(F.sum("pos").over(before), F.lit(0))).withColumn("_s", F.coalesce(F.sum(F.col("pos") + F.col("neg")).over(before), F.lit(0)))
    seen = seen.where("pos > 0")
    steps = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("pos")), F.lit(0.0), lambda a, i: a + (F.col("_c") + i) / (F.col("_s") + F.col("neg") + i).cast("double"))
    block = F.col("pos") * (F.col("_c") + F.col("pos")) / (F.col("_s") + F.col("pos") + F.col("neg")).cast("double")
    return seen.groupBy(*group).agg((F.sum(steps) / F.sum("pos")).alias("ap_conservative"), (F.sum(block) / F.sum("pos")).alias("ap_block"))


def brier(score: str, label: str) -> Column:
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score)))
    return F.avg((clipped - F.col(label)) * (clipped - F.col(label)))


def threshold_panel(df: DataFrame, group: Sequence[str], score: str, label: str, cut: float = 0.5) -> DataFrame:
    """Brier score, confusion counts and Matthews correlation at `cut`."""
    yes, pos = F.col(score) >= cut, F.col(label) == 1
    counts = df.groupBy(*group).agg(brier(score, label).alias("brier"), F.count_if(yes & pos).alias("tp"), F.count_if(yes & ~pos).alias("fp"), F.count_if(~yes & pos).alias("fn"), F.count_if(~yes & ~pos).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    norm = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.withColumn("mcc", F.when(norm > 0, (tp * tn - fp * fn) / norm).otherwise(F.lit(0.0)))


def best_f1(df: DataFrame, group: Sequence[str], score: str, label: str) -> DataFrame:
    """Largest F1 over all thresholds at a score, and the threshold, the largest of equal ones."""
    counts = by_score(df, group, score, label)
    upto = Window.partitionBy(*group).orderBy(F.col(score).desc()).rowsBetween(ALL, 0)
    total = F.sum("pos").over(Window.partitionBy(*group))
    f1 = F.lit(2.0) * F.sum("pos").over(upto) / (F.sum(F.col("pos") + F.col("neg")).over(upto) + total)
    curve = counts.withColumn("f1", f1)
    return curve.groupBy(*group).agg(F.max("f1").alias("best_f1"), F.max_by(score, F.struct("f1", score)).alias("threshold"))


def top_k(df: DataFrame, group: Sequence[str], score: str, label: str, ties: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """Per group and k: selected, recovered, and the group's rows and positives; nulls rank last."""
    w = Window.partitionBy(*group)
    order = w.orderBy(F.col(score).desc_nulls_last(), *ties)
    ranked = df.withColumn("_rank", F.row_number().over(order))
    outs = [F.struct(F.lit(k).cast("long").alias("k"), F.count_if(F.col("_rank") <= k).alias("selected"), F.count_if((F.col("_rank") <= k) & (F.col(label) == 1)).alias("recovered")) for k in ks]
    sums = ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("positives"), F.array(*outs).alias("_k"))
    return sums.select(*group, "n", "positives", F.explode("_k").alias("_k")).select(*group, "n", "positives", "_k.*")


def top_k_macro(cells: DataFrame) -> DataFrame:
    """Means over groups with positives of precision, recall and enrichment."""
    some = cells.where("positives > 0")
    precision = F.col("recovered") / F.col("selected").cast("double")
    return some.groupBy("k").agg(F.count(F.lit(1)).alias("groups"), F.avg(precision).alias("precision"), F.avg(F.col("recovered") / F.col("positives").cast("double")).alias("recall"), F.avg(precision * F.col("n") / F.col("positives")).alias("enrichment"))


def top_k_micro(cells: DataFrame) -> DataFrame:
    """Pooled counts; the base rate of the enrichment takes all groups."""
    sums = cells.groupBy("k").agg(F.sum("recovered").alias("recovered"), F.sum("selected").alias("selected"), F.sum("positives").alias("positives"), F.sum("n").alias("n"))
    precision = F.col("recovered") / F.col("selected").cast("double")
    return sums.select("k", "recovered", "selected", precision.alias("precision"), (F.col("recovered") / F.col("positives").cast("double")).alias("recall"), (precision / (F.col("positives") / F.col("n").cast("double"))).alias("enrichment"))


def fixed_budget(df: DataFrame, group: Sequence[str], methods: Sequence[str], label: str, ties: Sequence[str], budgets: dict[str, Column]) -> DataFrame:
    """Recovery per method and budget, pooled over groups.

    A budget is an expression over a group's `n` and `positives`, such as a
    number, a share rounded up or the true number of positives; it is capped by
    the group's rows. Rows without a score rank last.
    """
    long = df.select(*group, label, *ties, F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).cast("double").alias("score")) for m in methods])).alias("_m")).select(*group, label, *ties, "_m.*")
    w = Window.partitionBy(*group, "method")
    ranked = long.withColumn("_rank", F.row_number().over(w.orderBy(F.col("score").desc_nulls_last(), *ties))).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("positives", F.count_if(F.col(label) == 1).over(w))
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("budget"), c.cast("long").alias("k")) for b, c in budgets.items()]))
    dealt = ranked.withColumn("_b", each).select(*group, "method", label, "_rank", "n", "positives", "_b.*")
    chain = dealt.groupBy(*group, "method", "budget").agg(F.count_if(F.col("_rank") <= F.col("k")).alias("selected"), F.count_if((F.col("_rank") <= F.col("k")) & (F.col(label) == 1)).alias("tp"), F.max("positives").alias("positives"))
    sums = chain.groupBy("method", "budget").agg(F.count(F.lit(1)).alias("groups"), F.sum("selected").alias("selected"), F.sum("tp").alias("tp"), F.sum("positives").alias("positives"), F.percentile(F.try_divide(F.col("tp").cast("double"), F.col("positives")), F.lit(0.5)).alias("median_recall"))
    precision, recall = F.try_divide(F.col("tp").cast("double"), F.col("selected")), F.try_divide(F.col("tp").cast("double"), F.col("positives"))
    return sums.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", F.try_divide(2 * precision * recall, precision + recall))


def add_baseline_delta(df: DataFrame, group: Sequence[str], name: str, metric: str, baseline: str, out: str) -> DataFrame:
    """Metric minus the baseline's metric in the same group; null where there is no baseline."""
    base = F.max(F.when(F.col(name) == baseline, F.col(metric))).over(Window.partitionBy(*group))
    return df.withColumn(out, F.col(metric) - base)
