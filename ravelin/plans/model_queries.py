"""Models of several feature sets over the labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ravelin.operators import feature_sets, fold_models, ml
from ravelin.plans.registry import query
from ravelin.plans.staging import stage


def _models(t) -> fold_models.OutOfFold:
    """Quality by counts, shares and language of documents; models see documents of 200 letters or more, and predict all."""
    n = F.length("text")
    count = lambda pattern: F.regexp_count("text", F.lit(pattern))
    made = {"size_text": n, "size_lines": count(r"\n"), "size_words": count(r"\S+"), "share_digits": count("[0-9]") / F.nullif(n, F.lit(0)), "share_marks": count("[^A-Za-z0-9 ]") / F.nullif(n, F.lit(0))}
    # Figures are taken in the scan, so that no text is shuffled.
    figures = t("documents").select("doc_id", "lang", "source", *[c.alias(name) for name, c in made.items()])
    e = figures.join(t("labels").select("doc_id", "quality"), "doc_id")
    e = ml.derived(e, {"size_text_x_share_digits": ("size_text", "share_digits")}, {"size_log": "size_text"})
    numbers = [*made, "size_text_x_share_digits", "size_log"]
    sets = feature_sets.generate(numbers, feature_sets.starting(size="size_", share="share_"), cross="_x_")
    sets = sets | {"all+lang": [*numbers, "lang"]}
    return fold_models.out_of_fold_sets(e, "source", "quality", sets, 5, F.col("size_text") >= 200, balance="source", categories=["lang"], fill="zero")


@query()
def model_sets(t):
    return _models(t).predictions.select("doc_id", "fold", "set", F.round("probability", 4).alias("probability"))


@query()
def model_coefficients(t):
    """Mean, deviation and number of folds of each set's coefficients."""
    found = _models(t).coefficients.withColumn("name", F.struct("set", "feature"))
    return ml.coefficient_summary(found, "name", "coefficient").select("name.set", "name.feature", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "folds")


_RULES = [ml.Rule("id_", "identifier", "lineitem", "not_a_feature"), ml.Rule("score_", "score", "lineitem"), ml.Rule("score_old_", "score", "archive", "baseline_only")]
_LATER = [ml.Rule("structure_", "structure", "orders"), ml.Rule("score_", "none", "nowhere", "not_a_feature")]
# What the two builders should say of each column.
_LINEAGE = {
    "id_order": ("l_orderkey", "identifier", "lineitem", "not_a_feature"), "score_price": ("l_extendedprice", "score", "lineitem", "feature_safe"), "score_old_tax": ("l_tax", "score", "archive", "baseline_only"),
    "label_quantity": ("l_quantity", "derived", "input", "leakage_guard"), "discount": ("l_discount", "derived", "input", "review_before_use"),
    "structure_date": ("o_totalprice", "structure", "orders", "feature_safe"), "product": ("l_tax", "derived", "second builder", "review_before_use"),
}


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, '{role}' AS role, '{source}' AS source, '{status}' AS status, count({of}) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey" for c, (of, role, source, status) in _LINEAGE.items()))
def feature_lineage(t):
    """The manifest that one builder leaves in a written table, and a second one extends."""
    first = t("lineitem").select(F.col("l_orderkey").alias("id_order"), F.col("l_extendedprice").alias("score_price"), F.col("l_tax").alias("score_old_tax"), F.col("l_quantity").alias("label_quantity"), F.col("l_discount").alias("discount"))
    kept = stage(ml.annotate(first, _RULES), "features")
    more = kept.join(t("orders").select(F.col("o_orderkey").alias("id_order"), F.col("o_totalprice").alias("structure_date")), "id_order")
    both = ml.annotate(more.withColumn("product", F.col("score_price") * F.col("score_old_tax")), _LATER, "second builder")
    sums = both.agg(*[F.count(c).alias(c) for c in both.columns])
    rows = [F.struct(F.lit(c).alias("name"), F.lit(role).alias("role"), F.lit(source).alias("source"), F.lit(status).alias("status"), F.col(c).alias("n")) for c, role, source, status in ml.manifest_of(both)]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
