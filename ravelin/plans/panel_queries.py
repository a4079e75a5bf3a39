"""Evaluation panels over overlapping subsets of labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ravelin.operators import panels
from ravelin.plans.registry import query, r6
from ravelin.plans.score_queries import _LABELLED, _labelled

#: Subsets overlap: languages part the rows, the others cut across them.
_SUBSETS = {"all": "true", **{lang: f"lang = '{lang}'" for lang in ("en", "de", "fr", "es")}, "clean": "toxic = 0", "long": "n_chars > 1000", "long_clean": "n_chars > 1000 AND toxic = 0"}
_UNIVERSES = {"whole": "true", "surface": "n_chars > 700"}
# The share of the longest text, to two digits so that there are ties; every eleventh text has no score.
_SCORE = "CASE WHEN doc_id % 11 <> 0 THEN round(n_chars / 20000.0{double}, 2) END"
_E = f"e AS (SELECT *, {_SCORE.format(double='::DOUBLE')} AS score, (doc_id * 37 % 1000) / 1000.0::DOUBLE AS other FROM ({_LABELLED}))"
_IN = " UNION ALL ".join(f"SELECT '{name}' AS subset, * FROM e WHERE {rule}" for name, rule in _SUBSETS.items())


def _scored(t):
    e = _labelled(t)
    return e.withColumn("score", F.expr(_SCORE.format(double="D"))).withColumn("other", (F.col("doc_id") * 37 % 1000) / 1000.0)


def _conditions(table):
    return {name: F.expr(rule) for name, rule in table.items()}


@query(f"""
    WITH {_E}, i AS ({_IN}), s AS (SELECT * FROM i WHERE score IS NOT NULL),
    t AS (SELECT subset, count(*) AS n_rows, sum(quality)::BIGINT AS positives, sum(1 - quality)::BIGINT AS negatives, count(score) AS scored FROM i GROUP BY 1),
    ar AS (SELECT *, rank() OVER (PARTITION BY subset ORDER BY score) + (count(*) OVER (PARTITION BY subset, score) - 1) / 2.0::DOUBLE AS r FROM s),
    roc AS (SELECT subset, CASE WHEN sum(quality) > 0 AND sum(quality) < count(*) THEN (sum(CASE WHEN quality = 1 THEN r END) - sum(quality) * (sum(quality) + 1) / 2.0::DOUBLE) / (sum(quality)::DOUBLE * (count(*) - sum(quality))) END AS roc_auc FROM ar GROUP BY 1),
    c AS (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY score DESC, quality) AS rn, sum(quality) OVER (PARTITION BY subset ORDER BY score DESC, quality ROWS UNBOUNDED PRECEDING) AS hit,
                 sum(quality) OVER (PARTITION BY subset ORDER BY score DESC) AS bh, count(*) OVER (PARTITION BY subset ORDER BY score DESC) AS bn, sum(quality) OVER (PARTITION BY subset) AS total FROM s),
    ap AS (SELECT subset, avg(hit / rn::DOUBLE) AS ap_conservative, avg(bh / bn::DOUBLE) AS ap_block FROM c WHERE quality = 1 GROUP BY 1),
    f AS (SELECT subset, 2.0::DOUBLE * bh / (bn + total) AS f1, score FROM c QUALIFY row_number() OVER (PARTITION BY subset ORDER BY f1 DESC, score DESC) = 1),
    m AS (SELECT subset, avg((least(1, score) - quality) * (least(1, score) - quality)) AS brier, count(*) FILTER (score >= 0.1 AND quality = 1) AS tp, count(*) FILTER (score >= 0.1 AND quality = 0) AS fp, count(*) FILTER (score < 0.1 AND quality = 1) AS fn, count(*) FILTER (score < 0.1 AND quality = 0) AS tn FROM s GROUP BY 1)
    SELECT subset, n_rows AS rows, positives, negatives, scored, round(roc_auc, 6) AS roc_auc, round(ap_conservative, 6) AS ap_conservative, round(ap_block, 6) AS ap_block, round(f.f1, 6) AS best_f1, f.score AS threshold, round(brier, 6) AS brier, tp, fp, fn, tn,
           round(CASE WHEN (tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END, 6) AS mcc
    FROM t LEFT JOIN roc USING (subset) LEFT JOIN ap USING (subset) LEFT JOIN f USING (subset) LEFT JOIN m USING (subset)""")
def subset_curves(t):
    """The whole panel of every subset; curves of all come from one sort."""
    out = panels.curves(_scored(t), _conditions(_SUBSETS), "score", "quality", 0.1)
    return out.select(*[r6(c) if c in ("roc_auc", "ap_conservative", "ap_block", "best_f1", "brier", "mcc") else c for c in out.columns])


@query(f"""
    WITH {_E}, i AS ({_IN}),
    g AS (SELECT subset, lang, source, count(*) AS n, sum(quality) AS positives, count(score) AS scored, count(DISTINCT score) AS kinds FROM i GROUP BY 1, 2, 3),
    k AS (SELECT subset, count(*) AS groups, count(*) FILTER (positives = 0) AS without_positive, count(*) FILTER (positives > 0 AND scored < n) AS missing_score, count(*) FILTER (positives > 0 AND scored = n) AS evaluated, count(*) FILTER (positives > 0 AND scored = n AND kinds = 1) AS constant_score FROM g GROUP BY 1),
    z AS (SELECT unnest(['top_1', 'top_5', 'tenth', 'third']) AS size),
    r AS (SELECT i.*, n, positives, row_number() OVER (PARTITION BY subset, lang, source ORDER BY i.score DESC, doc_id) AS rn FROM i JOIN g USING (subset, lang, source) WHERE positives > 0 AND scored = n),
    x AS (SELECT subset, size, lang, source, greatest(1, least(n, CASE size WHEN 'top_1' THEN 1 WHEN 'top_5' THEN 5 WHEN 'tenth' THEN ceil(n / 10.0) ELSE ceil(n / 3.0) END)) AS kk, any_value(n) AS n, any_value(positives) AS p, count(*) FILTER (rn <= kk AND quality = 1) AS tp FROM r, z GROUP BY 1, 2, 3, 4, kk),
    m AS (SELECT subset, size, avg(tp / kk::DOUBLE) AS precision, avg(tp / p::DOUBLE) AS recall, avg(tp / kk::DOUBLE * n / p) AS enrichment FROM x GROUP BY 1, 2)
    SELECT k.*, size, round(precision, 6) AS precision, round(recall, 6) AS recall, round(enrichment, 6) AS enrichment FROM k CROSS JOIN z LEFT JOIN m USING (subset, size)""")
def subset_top_k(t):
    """Fixed numbers and shares of each group's rows; groups with a missing score are told and left out."""
    sizes = {"top_1": F.lit(1), "top_5": F.lit(5), "tenth": F.col("n") / 10.0, "third": F.col("n") / 3.0}
    out = panels.top_k(_scored(t), _conditions(_SUBSETS), ["lang", "source"], "score", "quality", ["doc_id"], sizes)
    return out.select(*[r6(c) if c in ("precision", "recall", "enrichment") else c for c in out.columns])


_RATIO = "CASE WHEN {b} > 0 THEN {a} / ({b})::DOUBLE END"


@query(f"""
    WITH {_E}, i AS ({_IN}), u AS ({" UNION ALL ".join(f"SELECT '{name}' AS universe, * FROM i WHERE {rule}" for name, rule in _UNIVERSES.items())}),
    w AS (SELECT subset, lang, source, sum(quality) AS positives FROM i GROUP BY 1, 2, 3 HAVING sum(quality) > 0),
    g AS (SELECT w.*, un.universe, coalesce(n, 0) AS n, coalesce(inside, 0) AS inside FROM w CROSS JOIN (SELECT unnest(['whole', 'surface']) AS universe) un
          LEFT JOIN (SELECT subset, lang, source, universe, count(*) AS n, sum(quality) AS inside FROM u GROUP BY 1, 2, 3, 4) q USING (subset, lang, source, universe)),
    b AS (SELECT *, CASE budget WHEN 'five' THEN least(n, 5) WHEN 'fifth' THEN least(n, ceil(n * 0.2)) WHEN 'true' THEN least(n, positives) ELSE least(n, inside) END::BIGINT AS k FROM g CROSS JOIN (SELECT unnest(['five', 'fifth', 'true', 'true_inside']) AS budget)),
    m AS (SELECT subset, lang, source, universe, quality, doc_id, 'score' AS method, score AS s FROM u UNION ALL SELECT subset, lang, source, universe, quality, doc_id, 'other', other FROM u),
    r AS (SELECT *, row_number() OVER (PARTITION BY subset, lang, source, universe, method ORDER BY s DESC NULLS LAST, doc_id) AS rn FROM m),
    x AS (SELECT b.*, mm.method, (SELECT count(*) FROM r WHERE r.subset = b.subset AND r.lang = b.lang AND r.source = b.source AND r.universe = b.universe AND r.method = mm.method AND r.rn <= b.k AND r.quality = 1) AS tp FROM b CROSS JOIN (SELECT unnest(['score', 'other']) AS method) mm),
    y AS (SELECT subset, universe, method, budget, count(*) AS groups, count(*) FILTER (k > 0) AS choosing, sum(n)::BIGINT AS candidates, sum(k)::BIGINT AS selected, sum(positives)::BIGINT AS positives, sum(inside)::BIGINT AS inside, sum(tp)::BIGINT AS tp,
                 avg({_RATIO.format(a="tp", b="k")}) AS mean_precision, avg({_RATIO.format(a="tp", b="inside")}) AS mean_recall FROM x GROUP BY 1, 2, 3, 4),
    z AS (SELECT *, selected - tp AS fp, inside - tp AS fn_inside, positives - tp AS fn, {_RATIO.format(a="tp", b="selected")} AS p, {_RATIO.format(a="tp", b="inside")} AS ri, {_RATIO.format(a="tp", b="positives")} AS r FROM y)
    SELECT * EXCLUDE (p, ri, r, mean_precision, mean_recall), round(mean_precision, 6) AS mean_precision, round(mean_recall, 6) AS mean_recall, round(p, 6) AS precision, round(ri, 6) AS recall_inside, round(r, 6) AS recall,
           round(CASE WHEN p + ri > 0 THEN 2 * p * ri / (p + ri) END, 6) AS f1_inside, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END, 6) AS f1 FROM z""")
def subset_budgets(t):
    """Recovery within the whole group and within its surface, against the positives of either."""
    sizes = {"five": F.lit(5), "fifth": F.col("n") * 0.2, "true": F.col("positives"), "true_inside": F.col("inside")}
    out = panels.budgets(_scored(t), _conditions(_SUBSETS), _conditions(_UNIVERSES), ["lang", "source"], ["score", "other"], "quality", ["doc_id"], sizes)
    return out.select(*[r6(c) if c.startswith(("mean", "precision", "recall", "f1")) else c for c in out.columns])
