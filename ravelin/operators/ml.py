"""Group-balanced weights, grouped folds, out-of-fold logistic models, column roles."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.plans.staging import attach, stage

#: Prefixes of columns that hold or derive from a target, a split or an identifier.
LEAKING = ("label", "target", "native", "fold", "split")


def feature_manifest(columns: Iterable[str], keys: Iterable[str], leaking: Sequence[str] = LEAKING) -> list[tuple[str, str, str]]:
    """(column, role, status): keys are identifiers, leaking prefixes are guarded, the rest are safe features."""
    known = set(keys)
    out = []
    for c in columns:
        if c in known:
            out.append((c, "identifier", "not_a_feature"))
        elif c.startswith(tuple(leaking)):
            out.append((c, "target", "leakage_guard"))
        else:
            out.append((c, "score" if c.startswith("score__") else "feature", "feature_safe"))
    return out


@dataclass(frozen=True)
class Rule:
    """Columns whose names begin with a prefix have this role, come from this source, and may (`feature_safe`) or may not be features."""

    prefix: str
    role: str
    source: str
    status: str = "feature_safe"


#: Where a column's entry of the manifest stands in its metadata.
MANIFEST = "manifest"


def annotate(df: DataFrame, rules: Sequence[Rule], source: str = "input", leaking: Sequence[str] = LEAKING) -> DataFrame:
    """`df` whose columns carry role, source and status as metadata, which Parquet keeps.

    A column that has an entry keeps it, so a later builder describes only what
    it adds. Of several rules the longest prefix counts; a column that no rule
    names is `derived`, from `source`, and to be reviewed before use. A leaking
    prefix guards a column whatever the rules say.
    """
    entries = {}
    for field in df.schema.fields:
        if MANIFEST in field.metadata:
            entries[field.name] = field.metadata[MANIFEST]
            continue
        rule = max((r for r in rules if field.name.startswith(r.prefix)), key=lambda r: len(r.prefix), default=Rule("", "derived", source, "review_before_use"))
        status = "leakage_guard" if field.name.startswith(tuple(leaking)) else rule.status
        entries[field.name] = {"role": rule.role, "source": rule.source, "status": status}
    return df.select(*[F.col(f"`{f.name}`").alias(f.name, metadata={**f.metadata, MANIFEST: entries[f.name]}) for f in df.schema.fields])


def manifest_of(df: DataFrame) -> list[tuple[str, str, str, str]]:
    """(column, role, source, status) of the annotated columns, in order."""
    return [(f.name, *(f.metadata[MANIFEST][k] for k in ("role", "source", "status"))) for f in df.schema.fields if MANIFEST in f.metadata]


def safe_features(df: DataFrame, keys: Iterable[str]) -> list[str]:
    """Numeric columns that the manifest calls safe, in the table's order."""
    numeric = {n for n, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")}
    return [c for c, _, status in feature_manifest(df.columns, keys) if status == "feature_safe" and c in numeric]


def feature_sets(columns: Sequence[str], blocks: dict[str, Sequence[str]]) -> dict[str, list[str]]:
    """`all`, each block by its prefixes, and `all` without each block."""
    member = {b: [c for c in columns if c.startswith(tuple(p))] for b, p in blocks.items()}
    return {"all": list(columns)} | {f"only_{b}": m for b, m in member.items()} | {f"without_{b}": [c for c in columns if c not in m] for b, m in member.items()}


def balanced_weights(df: DataFrame, group: str, label: str, out: str) -> DataFrame:
    """1 / group size, scaled so that both classes weigh the same and the mean weight is 1."""
    size = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    each = df.join(size, group).withColumn("_w", 1 / F.col("_size"))
    classes = each.groupBy(label).agg(F.sum("_w").alias("_class"), F.count(F.lit(1)).alias("_n"))
    # Two rows: one per class.
    totals = F.broadcast(classes.withColumn("_rows", F.sum("_n").over(Window.partitionBy())).withColumn("_classes", F.count(F.lit(1)).over(Window.partitionBy())))
    return each.join(totals, label).withColumn(out, F.col("_w") / F.col("_class") * F.col("_rows") / F.col("_classes")).drop("_size", "_w", "_class", "_n", "_rows", "_classes")


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """(group, fold): the largest group left goes to the lightest fold; ties by name and fold."""
    sizes = df.groupBy(F.col(group)).agg(F.count(F.lit(1)).alias("n"))
    kind = dict(df.dtypes)[group]

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_name=pdf[group].astype(str)).sort_values(["n", "_name"], ascending=[False, True])
        heap = [(0, f) for f in range(k)]
        folds = []
        for n in pdf["n"]:
            weight, f = heapq.heappop(heap)
            folds.append(f)
            heapq.heappush(heap, (weight + int(n), f))
        return pdf.assign(fold=folds)[[group, "fold"]]

    return sizes.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(deal, f"`{group}` {kind}, fold long")


def _scaled(df: DataFrame, features: Sequence[str], fit: Column, fill: str = "median") -> DataFrame:
    """Adds `_f_` columns: median or zero for nulls, then zero mean and unit variance (population), fitted on rows where `fit` holds."""
    if fill not in ("median", "zero"):
        raise ValueError(f"fill is median or zero, not {fill}")
    medians = df.where(fit).agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in features]).first() if fill == "median" else dict.fromkeys(features)
    filled = df.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(float(medians[c] or 0.0))) for c in features})
    stats = filled.where(fit).agg(*[F.avg(f"_f_{c}").alias(f"m_{c}") for c in features], *[F.stddev_pop(f"_f_{c}").alias(f"s_{c}") for c in features]).first()
    return filled.withColumns({f"_f_{c}": (F.col(f"_f_{c}") - F.lit(float(stats[f"m_{c}"] or 0.0))) / F.lit(float(stats[f"s_{c}"] or 1.0)) for c in features})


def _one_hot(df: DataFrame, columns: Sequence[str], fit: Column) -> DataFrame:
    """Adds `_c_` vectors: a place per value seen where `fit` holds, null as `missing`; values not seen there have zeros."""
    text = df.withColumns({f"_t_{c}": F.coalesce(F.col(c).cast("string"), F.lit("missing")) for c in columns})
    index = StringIndexer(inputCols=[f"_t_{c}" for c in columns], outputCols=[f"_i_{c}" for c in columns], handleInvalid="keep").fit(text.where(fit))
    # The place of values not seen is the last one, which the encoder drops.
    told = index.transform(text)
    return OneHotEncoder(inputCols=[f"_i_{c}" for c in columns], outputCols=[f"_c_{c}" for c in columns], dropLast=True).fit(told).transform(told)


def _with_ones(df: DataFrame, features: Sequence[str], fit: Column) -> DataFrame:
    """Adds `_one`, a column of ones turned by 45 degrees with the first feature that varies.

    Spark gives columns without variance no weight. Turning two columns changes
    neither the squared norm nor the predictions, and both then vary.
    """
    spread = df.where(fit).agg(*[F.stddev_pop(f"_f_{c}").alias(c) for c in features]).first()
    turned = next((f"_f_{c}" for c in features if (spread[c] or 0.0) > 0), None)
    if turned is None:
        raise ValueError("a penalised intercept takes a feature that varies")
    half = F.lit(0.5**0.5)
    return df.withColumns({turned: (F.col(turned) + 1) * half, "_one": (F.col(turned) - 1) * half})


def out_of_fold(
    df: DataFrame, folds: DataFrame, group: str, label: str, weight: str, features: Sequence[str], k: int, c: float = 1.0, max_iter: int = 100, categories: Sequence[str] = (), fill: str = "median", penalised_intercept: bool = False
) -> DataFrame:
    """`df` with `fold` and `probability`, predicted by the model that did not see the row's fold.

    The objective is C times the weighted loss plus half the squared norm:
    Spark's regParam is 1 / (C * sum of weights). The intercept is free, or with
    `penalised_intercept` the weight of a column of ones, which takes a feature
    that varies. Columns that never vary in training get no weight. Nulls of `features`
    are filled by `fill`, the training rows' median or zero; `categories` are
    columns of names, one-hot and not scaled.
    """
    dealt = stage(attach(df, stage(folds, "folds"), [group], "inner"), "dealt") if k else df
    out = None
    for f in range(k):
        fit = F.col("fold") != f
        scaled = _scaled(dealt, features, fit, fill)
        scaled = _with_ones(scaled, features, fit) if penalised_intercept else scaled
        scaled = _one_hot(scaled, categories, fit) if categories else scaled
        inputs = [*[f"_f_{n}" for n in features], *[f"_c_{n}" for n in categories], *(["_one"] if penalised_intercept else [])]
        rows = VectorAssembler(inputCols=inputs, outputCol="_x").transform(scaled)
        train = rows.where(F.col("fold") != f)
        total = train.agg(F.sum(weight)).first()[0] or 1.0
        model = LogisticRegression(featuresCol="_x", labelCol=label, weightCol=weight, regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, fitIntercept=not penalised_intercept, maxIter=max_iter, tol=1e-9).fit(train)
        told = model.transform(rows.where(F.col("fold") == f)).withColumn("probability", vector_to_array("probability")[1])
        part = told.select(*df.columns, "fold", "probability")
        out = part if out is None else out.unionByName(part)
    return out


def coefficient_summary(df: DataFrame, name: str, value: str) -> DataFrame:
    """Mean, sample deviation and number of folds of each coefficient."""
    return df.groupBy(name).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("folds"))


def hybrids(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """`hybrid_min` and `hybrid_mean` of models; null where any model is null."""
    known = F.lit(True)
    for m in models:
        known = known & F.col(m).isNotNull()
    mean = sum((F.col(m) for m in models), F.lit(0.0)) / len(models)
    return df.withColumn("hybrid_min", F.when(known, F.least(*models))).withColumn("hybrid_mean", F.when(known, mean))


def derived(df: DataFrame, products: dict[str, tuple[str, str]], logs: dict[str, str]) -> DataFrame:
    """Products with null as 0, and log1p of values clipped at 0."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    made = {n: zero(a) * zero(b) for n, (a, b) in products.items()} | {n: F.log1p(F.greatest(zero(c), F.lit(0.0))) for n, c in logs.items()}
    return df.withColumns(made)
