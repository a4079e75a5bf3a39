"""Matrices, marginals, evaluation, spatial joins, selection and models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ravelin.operators import aggregates, alignment, metrics, ml, nearest, scoring, selection, spatial, windows
from ravelin.plans import greedy_sql, pair_scoring
from ravelin.plans.registry import query, r6

_LABELLED = "SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)"


def _labelled(t):
    return t("documents").select("doc_id", "lang", "source", "n_chars").join(t("labels"), "doc_id")


@query("""
    WITH v AS (SELECT p_brand, c_mktsegment FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
    SELECT p_brand, c_mktsegment, count(*) AS votes, round(count(*) / (SELECT count(*) FROM v)::DOUBLE, 6) AS share FROM v GROUP BY 1, 2""")
def vote_matrix(t):
    v = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return aggregates.vote_share(v.select("p_brand", "c_mktsegment"), "p_brand", "c_mktsegment", "share").withColumn("share", r6("share"))


@query("""
    WITH l AS (SELECT unnest(range(1, length(c_name) + 1)) AS position, c_name FROM customer),
    c AS (SELECT position, substr(c_name, position, 1) AS letter, count(*) AS n FROM l GROUP BY 1, 2)
    SELECT position, sum(CASE WHEN letter NOT IN (' ', '-') THEN n ELSE 0 END)::BIGINT AS letters, sum(n)::BIGINT AS rows,
           round(max(CASE WHEN letter NOT IN (' ', '-') THEN n END) / sum(CASE WHEN letter NOT IN (' ', '-') THEN n ELSE 0 END)::DOUBLE, 6) AS top_share
    FROM c GROUP BY 1""")
def column_profile(t):
    return aggregates.column_profile(t("customer"), "c_name").withColumn("top_share", r6("top_share"))


@query("SELECT user_id, event_type, max(value) AS top FROM events GROUP BY 1, 2")
def cell_max(t):
    return t("events").groupBy("user_id", "event_type").agg(F.max("value").alias("top"))


@query("""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC) AS rn FROM lineitem WHERE l_extendedprice > 0)
    SELECT l_suppkey, round(max(l_extendedprice) + 0.5 * (sum(l_extendedprice) - max(l_extendedprice)), 4) AS weighted,
           round(max(l_extendedprice) / sum(l_extendedprice), 6) AS specificity FROM r WHERE rn <= 3 GROUP BY 1""")
def topk_weighted(t):
    df = aggregates.weighted_top_k(t("lineitem"), ["l_suppkey"], "l_extendedprice", 3, "weighted", "specificity")
    return df.select("l_suppkey", F.round("weighted", 4).alias("weighted"), r6("specificity"))


@query("""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC) AS rn FROM lineitem WHERE l_quantity > 0)
    SELECT l_partkey, round(max(l_quantity) / sum(l_quantity), 6) AS specificity FROM r WHERE rn <= 5 GROUP BY 1""")
def topk_specificity(t):
    return aggregates.weighted_top_k(t("lineitem"), ["l_partkey"], "l_quantity", 5, "weighted", "specificity").select("l_partkey", r6("specificity"))


@query("""
    WITH c AS (SELECT l_suppkey, count(DISTINCT l_partkey * 100 + l_linenumber) AS n, count(DISTINCT l_partkey) AS r, count(DISTINCT l_linenumber) AS k FROM lineitem GROUP BY 1),
    d AS (SELECT l_suppkey, n / (2000.0 * 7)::DOUBLE AS density, (r / 2000.0::DOUBLE + k / 7.0::DOUBLE) / 2 AS breadth FROM c)
    SELECT l_suppkey, round(density, 6) AS density, round(breadth, 6) AS breadth,
           round(greatest(0.05, least(1.0, 0.75 * (1 - density) + 0.25 * greatest(0.0, least(1.0, (1 - breadth) / 0.5)))), 6)::DOUBLE AS trust FROM d""")
def density_reliability(t):
    df = aggregates.reliability(t("lineitem"), ["l_suppkey"], "l_partkey", "l_linenumber", 2000, 7, "trust")
    return df.select("l_suppkey", r6("density"), r6("breadth"), r6("trust"))


@query("""
    WITH s AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
    SELECT count(*) AS n, round(avg(n), 6) AS mean, quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.75) AS q75, min(n) AS min, max(n) AS max,
           count(*) FILTER (n BETWEEN 0 AND 5) AS bin_0_5, count(*) FILTER (n BETWEEN 6 AND 10) AS bin_6_10, count(*) FILTER (n BETWEEN 11 AND 20) AS bin_11_20, count(*) FILTER (n > 20) AS bin_more FROM s""")
def size_distribution(t):
    sizes = t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return aggregates.size_distribution(sizes, "n", [(0, 5), (6, 10), (11, 20)]).withColumn("mean", r6("mean"))


_AUC = """
    WITH e AS ({rows}), r AS (SELECT *, (rank() OVER (PARTITION BY g ORDER BY score) + (count(*) OVER (PARTITION BY g, score) - 1) / 2.0::DOUBLE) AS ar FROM e)
    SELECT g, sum(y)::BIGINT AS n_pos, (count(*) - sum(y))::BIGINT AS n_neg,
           CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN round((sum(CASE WHEN y = 1 THEN ar END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y)::DOUBLE * (count(*) - sum(y))), 6) END AS roc_auc
    FROM r GROUP BY g"""


@query(_AUC.format(rows="SELECT lang AS g, n_chars AS score, quality AS y FROM documents JOIN labels USING (doc_id)"))
def roc_auc(t):
    return metrics.roc_auc(_labelled(t).withColumn("g", F.col("lang")), ["g"], "n_chars", "quality").withColumn("roc_auc", r6("roc_auc"))


@query(f"""
    WITH e AS ({_LABELLED}),
    c AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, quality) AS rn, sum(quality) OVER (PARTITION BY lang ORDER BY n_chars DESC, quality ROWS UNBOUNDED PRECEDING) AS hit,
                 sum(quality) OVER (PARTITION BY lang ORDER BY n_chars DESC) AS bh, count(*) OVER (PARTITION BY lang ORDER BY n_chars DESC) AS bn FROM e)
    SELECT lang, round(avg(hit / rn::DOUBLE), 6) AS ap_conservative, round(avg(bh / bn::DOUBLE), 6) AS ap_block FROM c WHERE quality = 1 GROUP BY lang""")
def average_precision(t):
    df = metrics.average_precision(_labelled(t), ["lang"], "n_chars", "quality")
    return df.select("lang", r6("ap_conservative"), r6("ap_block"))


@query(f"""
    WITH e AS ({_LABELLED}), s AS (SELECT lang, quality AS y, n_chars / (SELECT max(n_chars) FROM e)::DOUBLE AS p FROM e),
    c AS (SELECT lang, avg((p - y) * (p - y)) AS brier, count(*) FILTER (p >= 0.5 AND y = 1)::DOUBLE AS tp, count(*) FILTER (p >= 0.5 AND y <> 1)::DOUBLE AS fp,
                 count(*) FILTER (p < 0.5 AND y = 1)::DOUBLE AS fn, count(*) FILTER (p < 0.5 AND y <> 1)::DOUBLE AS tn FROM s GROUP BY lang)
    SELECT lang, round(brier, 6) AS brier, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn,
           CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) ELSE 0 END AS mcc FROM c""")
def brier_mcc(t):
    e = _labelled(t)
    scaled = e.crossJoin(F.broadcast(e.agg(F.max("n_chars").alias("top")))).withColumn("p", F.col("n_chars") / F.col("top"))
    df = metrics.threshold_panel(scaled, ["lang"], "p", "quality")
    return df.select("lang", r6("brier"), "tp", "fp", "fn", "tn", r6("mcc"))


@query(f"""
    WITH e AS ({_LABELLED}), b AS (SELECT lang, n_chars, sum(quality) AS p, count(*) AS n FROM e GROUP BY 1, 2),
    c AS (SELECT lang, n_chars, 2.0::DOUBLE * sum(p) OVER w / (sum(n) OVER w + sum(p) OVER (PARTITION BY lang)) AS f1 FROM b WINDOW w AS (PARTITION BY lang ORDER BY n_chars DESC)),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, n_chars DESC) AS rn FROM c)
    SELECT lang, round(f1, 6) AS best_f1, n_chars AS threshold FROM r WHERE rn = 1""")
def best_f1(t):
    return metrics.best_f1(_labelled(t), ["lang"], "n_chars", "quality").withColumn("best_f1", r6("best_f1"))


_CELLS = f"""
    e AS ({_LABELLED}), r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC NULLS LAST, doc_id) AS rn FROM e),
    k AS (SELECT unnest([1, 3, 5, 10])::BIGINT AS k),
    c AS (SELECT lang, source, k, count(*) AS n, count(*) FILTER (quality = 1) AS positives, count(*) FILTER (rn <= k) AS selected, count(*) FILTER (rn <= k AND quality = 1) AS recovered
          FROM r, k GROUP BY 1, 2, 3)"""


def _cells(t):
    return metrics.top_k(_labelled(t), ["lang", "source"], "n_chars", "quality", ["doc_id"], [1, 3, 5, 10])


@query(f"""
    WITH {_CELLS} SELECT k, count(*) AS groups, round(avg(recovered / selected::DOUBLE), 6) AS precision, round(avg(recovered / positives::DOUBLE), 6) AS recall,
        round(avg(recovered / selected::DOUBLE * n / positives), 6) AS enrichment FROM c WHERE positives > 0 GROUP BY k""")
def topk_macro(t):
    return metrics.top_k_macro(_cells(t)).select("k", "groups", r6("precision"), r6("recall"), r6("enrichment"))


@query(f"""
    WITH {_CELLS} SELECT k, sum(recovered)::BIGINT AS recovered, sum(selected)::BIGINT AS selected, round(sum(recovered) / sum(selected)::DOUBLE, 6) AS precision,
        round(sum(recovered) / sum(positives)::DOUBLE, 6) AS recall, round(sum(recovered) / sum(selected)::DOUBLE / (sum(positives) / sum(n)::DOUBLE), 6) AS enrichment FROM c GROUP BY k""")
def topk_micro(t):
    return metrics.top_k_micro(_cells(t)).select("k", "recovered", "selected", r6("precision"), r6("recall"), r6("enrichment"))


@query(f"""
    WITH e AS ({_LABELLED}), m AS (SELECT lang, source, quality, doc_id, 'n_chars' AS method, n_chars::DOUBLE AS score FROM e UNION ALL SELECT lang, source, quality, doc_id, 'doc_id', doc_id::DOUBLE FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, method ORDER BY score DESC NULLS LAST, doc_id) AS rn, count(*) OVER (PARTITION BY lang, source, method) AS n,
                 count(*) FILTER (quality = 1) OVER (PARTITION BY lang, source, method) AS positives FROM m),
    b AS (SELECT r.*, x.budget, CASE x.budget WHEN 'top_5' THEN 5 WHEN 'percent_20' THEN ceil(n * 0.2) ELSE positives END::BIGINT AS k FROM r, (SELECT unnest(['top_5', 'percent_20', 'true_n']) AS budget) x),
    c AS (SELECT lang, source, method, budget, count(*) FILTER (rn <= k) AS selected, count(*) FILTER (rn <= k AND quality = 1) AS tp, max(positives) AS positives FROM b GROUP BY 1, 2, 3, 4)
    SELECT method, budget, count(*) AS groups, sum(selected)::BIGINT AS selected, sum(tp)::BIGINT AS tp, sum(positives)::BIGINT AS positives,
           round(quantile_cont(CASE WHEN positives > 0 THEN tp / positives::DOUBLE END, 0.5), 6) AS median_recall, round(sum(tp) / sum(selected)::DOUBLE, 6) AS precision, round(sum(tp) / sum(positives)::DOUBLE, 6) AS recall,
           round(2 * (sum(tp) / sum(selected)::DOUBLE) * (sum(tp) / sum(positives)::DOUBLE) / (sum(tp) / sum(selected)::DOUBLE + sum(tp) / sum(positives)::DOUBLE), 6) AS f1
    FROM c GROUP BY 1, 2""")
def fixed_budget(t):
    budgets = {"top_5": F.lit(5), "percent_20": F.ceil(F.col("n") * F.lit(0.2)), "true_n": F.col("positives")}
    df = metrics.fixed_budget(_labelled(t), ["lang", "source"], ["n_chars", "doc_id"], "quality", ["doc_id"], budgets)
    return df.select("method", "budget", "groups", "selected", "tp", "positives", *[r6(c) for c in ("median_recall", "precision", "recall", "f1")])


@query(f"""
    WITH e AS ({_LABELLED})
    SELECT CASE WHEN grouping(lang) = 0 THEN 'lang=' || lang WHEN grouping(source) = 0 THEN 'source=' || source ELSE 'all' END AS subset,
           count(*) AS n, sum(quality)::BIGINT AS positives, round(avg(n_chars), 4) AS mean_chars FROM e GROUP BY GROUPING SETS ((), (lang), (source))
    UNION ALL SELECT 'mask=clean', count(*), sum(quality)::BIGINT, round(avg(n_chars), 4) FROM e WHERE toxic = 0
    UNION ALL SELECT 'mask=long', count(*), sum(quality)::BIGINT, round(avg(n_chars), 4) FROM e WHERE n_chars > 1000""")
def subset_sweep(t):
    e = _labelled(t)
    outs = [F.count(F.lit(1)).alias("n"), F.sum("quality").alias("positives"), F.round(F.avg("n_chars"), 4).alias("mean_chars")]
    name = F.when(F.grouping("lang") == 0, F.concat(F.lit("lang="), "lang")).when(F.grouping("source") == 0, F.concat(F.lit("source="), "source")).otherwise("all")
    disjoint = e.groupingSets([[], ["lang"], ["source"]], "lang", "source").agg(name.alias("subset"), *outs).select("subset", "n", "positives", "mean_chars")
    masks = F.explode(F.array_compact(F.array(F.when(F.col("toxic") == 0, F.lit("mask=clean")), F.when(F.col("n_chars") > 1000, F.lit("mask=long")))))
    return disjoint.unionByName(e.withColumn("subset", masks).groupBy("subset").agg(*outs))


_BY_MODEL = f"""
    e AS ({_LABELLED}), s AS (SELECT lang, 'n_chars' AS model, avg(n_chars * quality) / nullif(avg(n_chars), 0) AS m FROM e GROUP BY 1 UNION ALL SELECT lang, 'doc_id', avg(doc_id * quality) / nullif(avg(doc_id), 0) FROM e GROUP BY 1
                              UNION ALL SELECT lang, 'toxic', avg((1 - toxic) * quality) / nullif(avg(1 - toxic), 0) FROM e GROUP BY 1)"""


def _by_model(t):
    e = _labelled(t)
    made = [e.groupBy("lang").agg(F.try_divide(F.avg(c * F.col("quality")), F.avg(c)).alias("m")).select("lang", F.lit(n).alias("model"), "m") for n, c in (("n_chars", F.col("n_chars")), ("doc_id", F.col("doc_id")), ("toxic", 1 - F.col("toxic")))]
    return made[0].union(made[1]).union(made[2])


@query(f"WITH {_BY_MODEL} SELECT lang, model, round(m, 6) AS m, round(m - max(CASE WHEN model = 'doc_id' THEN m END) OVER (PARTITION BY lang), 6) AS delta FROM s")
def baseline_delta(t):
    return metrics.add_baseline_delta(_by_model(t), ["lang"], "model", "m", "doc_id", "delta").select("lang", "model", r6("m"), r6("delta"))


@query(f"WITH {_BY_MODEL} SELECT lang, model, round(m, 6) AS m FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY m DESC, model) AS rn FROM s WHERE m IS NOT NULL) WHERE rn = 1")
def best_by_metric(t):
    return aggregates.best_by_metric(_by_model(t), ["lang"], "m", "model").select("lang", "model", r6("m"))


@query(f"""
    WITH e AS ({_LABELLED}), w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY source) AS w0 FROM e)
    SELECT doc_id, round(w0 / sum(w0) OVER (PARTITION BY quality) * count(*) OVER () / (SELECT count(DISTINCT quality) FROM e), 6) AS weight FROM w""")
def group_weights(t):
    return ml.balanced_weights(_labelled(t), "source", "quality", "weight").select("doc_id", r6("weight"))


def _points(t):
    return t("embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(x) for i, x in enumerate("xyz")])


_XYZ = "SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings"
_NEAR = f"""
    p AS ({_XYZ}), d AS (SELECT a.vec_id AS a, b.vec_id AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM p a JOIN p b ON a.vec_id < b.vec_id)"""


@query(f"WITH {_NEAR} SELECT a, b, round(d2, 9) AS d2 FROM d WHERE d2 <= 0.1::DOUBLE * 0.1::DOUBLE")
def radius_grid(t):
    return spatial.radius_pairs(_points(t), "vec_id", "xyz", 0.1).select("a", "b", F.round("d2", 9).alias("d2"))


@query(f"""
    WITH {_NEAR}, n AS (SELECT a, b FROM d WHERE d2 <= 0.1::DOUBLE * 0.1::DOUBLE UNION ALL SELECT b, a FROM d WHERE d2 <= 0.1::DOUBLE * 0.1::DOUBLE UNION ALL SELECT vec_id, vec_id FROM p)
    SELECT n.a AS vec_id, count(*) AS mass, sum(label)::BIGINT AS label_sum, round(avg(label), 6) AS label_mean FROM n JOIN p ON n.b = p.vec_id GROUP BY 1""")
def radius_mass(t):
    points = _points(t)
    return spatial.neighbourhood(points, "vec_id", "xyz", 0.1, [F.count(F.lit(1)).alias("mass"), F.sum("label").alias("label_sum"), r6(F.avg("label"), "label_mean")]).withColumnRenamed("a", "vec_id")


@query("""
    WITH d AS (SELECT a.vec_id, b.vec_id AS neighbour, list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))) AS d2
               FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, neighbour) AS rn FROM d)
    SELECT vec_id, neighbour, round(sqrt(d2), 6) AS distance FROM r WHERE rn = 1""")
def nearest_neighbour(t):
    return nearest.nearest(t("embeddings").select("vec_id", "embedding"), "vec_id", "embedding").withColumn("distance", r6("distance"))


@query(f"""
    WITH {_NEAR}, c AS (SELECT l.label, d.* FROM d JOIN p l ON d.a = l.vec_id WHERE d2 <= 0.2::DOUBLE * 0.2::DOUBLE)
    SELECT label, count(*) FILTER (d2 <= 0.05::DOUBLE * 0.05::DOUBLE) AS contacts_0_05, count(DISTINCT CASE WHEN d2 <= 0.05::DOUBLE * 0.05::DOUBLE THEN a END) AS points_0_05,
           count(*) FILTER (d2 <= 0.1::DOUBLE * 0.1::DOUBLE) AS contacts_0_1, count(DISTINCT CASE WHEN d2 <= 0.1::DOUBLE * 0.1::DOUBLE THEN a END) AS points_0_1,
           count(*) FILTER (d2 <= 0.2::DOUBLE * 0.2::DOUBLE) AS contacts_0_2, count(DISTINCT CASE WHEN d2 <= 0.2::DOUBLE * 0.2::DOUBLE THEN a END) AS points_0_2 FROM c GROUP BY 1""")
def contact_counts(t):
    points = _points(t)
    return spatial.contact_counts(spatial.radius_pairs(points, "vec_id", "xyz", 0.2), ["label"], [0.05, 0.1, 0.2], points, "vec_id")


_NATION_RANK = """
    s AS (SELECT o_orderpriority AS pair, c_nationkey AS nation, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    p AS (SELECT pair, nation, cume_dist() OVER (PARTITION BY pair ORDER BY v) AS pct FROM s)"""


@query(f"WITH {_NATION_RANK} SELECT a.pair, a.nation AS i, b.nation AS j, round(a.pct * b.pct, 6) AS priority FROM p a JOIN p b USING (pair)")
def outer_priority(t):
    sums = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("o_orderpriority").alias("pair"), F.col("c_nationkey").alias("nation")).agg(F.sum("o_totalprice").alias("v"))
    pct = windows.positive_percentile(sums, "v", ["pair"], "pct")
    return scoring.outer_product(pct, pct, ["pair"], "nation", "nation", "pct").withColumn("priority", r6("priority"))


_KERNEL = ", ".join(f"({d - len(scoring.gaussian(s)) // 2}, {w!r}::DOUBLE)" for s in (3.0,) for d, w in enumerate(scoring.gaussian(s)))
_KERNEL_2 = ", ".join(f"({d - len(scoring.gaussian(s)) // 2}, {w!r}::DOUBLE)" for s in (2.0,) for d, w in enumerate(scoring.gaussian(s)))


@query(f"""
    WITH k1(d, w) AS (VALUES {_KERNEL}), k2(d, w) AS (VALUES {_KERNEL_2}),
    c AS (SELECT event_type, (date_diff('day', TIMESTAMP '2024-01-01', date_trunc('day', ts)) % 32)::BIGINT AS i, extract(hour FROM ts)::BIGINT AS j, count(*) AS n FROM events GROUP BY 1, 2, 3),
    a AS (SELECT event_type, i + d AS i, j, sum(n * w) AS v FROM c, k1 WHERE i + d BETWEEN 0 AND 31 GROUP BY ALL),
    b AS (SELECT event_type, i, j + d AS j, sum(v * w) AS v FROM a, k2 WHERE j + d BETWEEN 0 AND 23 GROUP BY ALL)
    SELECT event_type, i, j, round(v, 6) AS smooth FROM b""")
def gauss_smooth(t):
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) % 32
    cells = t("events").groupBy("event_type", day.cast("long").alias("i"), F.hour("ts").cast("long").alias("j")).agg(F.count(F.lit(1)).alias("n"))
    return scoring.smooth(cells, ["event_type"], "i", "j", "n", (3.0, 2.0), (32, 24), "smooth").select("event_type", "i", "j", r6("smooth"))


@query("""
    WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS rn, max(value) OVER (PARTITION BY user_id) AS peak FROM events),
    a AS (SELECT *, value >= 0.75::DOUBLE * peak AND rn <= 10 AS act FROM p WHERE value > 0),
    n AS (SELECT *, count(*) FILTER (act) OVER (PARTITION BY user_id) AS na FROM a)
    SELECT event_id, CASE WHEN act THEN 'active' ELSE 'passive' END AS role FROM n WHERE act OR (value >= 0.35::DOUBLE * peak AND rn - na <= 10)""")
def adaptive_select(t):
    return selection.adaptive(t("events"), ["user_id"], "event_id", "value").select("event_id", "role")


@query(f"""
    WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
    ordered AS (SELECT user_id AS g, {{'k': pos, 'value': value}} AS s, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, pos) AS o FROM e WHERE value > 0),
    {greedy_sql.greedy("ordered", "abs(a.k - r.s.k) <= 3", 5)}
    SELECT g AS user_id, k AS pos, s.value AS value, seed FROM chosen""")
def greedy_seeds(t):
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return selection.greedy_line(t("events").withColumn("pos", pos), ["user_id"], "pos", "value", 5, 3)


@query(f"""
    WITH RECURSIVE ordered AS (SELECT label AS g, {{'k': vec_id, 'x': x, 'y': y, 'z': z, 'score': x + 1.0::DOUBLE}} AS s, row_number() OVER (PARTITION BY label ORDER BY x + 1.0::DOUBLE DESC, vec_id) AS o FROM ({_XYZ}) WHERE x + 1.0::DOUBLE > 0),
    {greedy_sql.greedy("ordered", greedy_sql.close("a", "r.s", 0.2).replace("<=", "<"), 10)}
    SELECT g AS label, k AS vec_id, s.score AS score, seed FROM chosen""")
def greedy_spatial(t):
    points = _points(t).withColumn("score", F.col("x") + F.lit(1.0))
    return selection.greedy_space(points, ["label"], "vec_id", "xyz", "score", 10, 0.2)


@query(f"""
    WITH RECURSIVE p AS (SELECT label AS g, x + 1.0::DOUBLE AS score, abs(y) AS support, {{'k': vec_id, 'x': x, 'y': y, 'z': z}} AS s FROM ({_XYZ})),
    ordered AS (SELECT g, s, row_number() OVER (PARTITION BY g ORDER BY score DESC, s.k) AS o FROM p WHERE score > 0),
    {greedy_sql.greedy("ordered", greedy_sql.close("a", "r.s", 0.2).replace("<=", "<"), 5)},
    m AS (SELECT r.*, c.seed, row_number() OVER (PARTITION BY r.g, c.seed ORDER BY r.score DESC) AS rn FROM p r JOIN (SELECT g, seed, s AS a FROM chosen) c ON c.g = r.g AND {greedy_sql.close("a", "r.s", 0.15)}),
    w AS (SELECT g, seed, sum(support) + 0.75 * sum(CASE WHEN rn <= 3 THEN score ELSE 0 END) AS worth FROM m GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY g ORDER BY worth DESC, seed) = 1)
    SELECT m.g AS label, m.s.k AS vec_id, round(worth, 6) AS worth FROM m JOIN w USING (g, seed)""")
def support_cluster(t):
    points = _points(t).withColumn("score", F.col("x") + F.lit(1.0)).withColumn("support", F.abs("y"))
    return selection.support_cluster(points, ["label"], "vec_id", "xyz", "score", "support", 5, 0.2, 0.15).withColumn("worth", r6("worth"))


_REPEATS = " + ".join([f"CASE WHEN {greedy_sql.seen('type')} = 0 THEN 100 ELSE 0 END", *[f"CASE WHEN {greedy_sql.seen(c)} = 0 THEN 10 ELSE -3 * {greedy_sql.seen(c)} END" for c in ("size", "name")]])


@query(f"""
    WITH RECURSIVE d AS (SELECT p_brand AS g, {{'k': p_partkey, 'name': p_name, 'size': p_size, 'type': p_type}} AS s FROM part),
    {greedy_sql.diverse("d", _REPEATS, "-abs(r.s.size - 25), -r.s.k", 8)}
    SELECT g AS p_brand, k AS p_partkey, pick FROM picked""")
def diverse_sample(t):
    return selection.diverse(t("part"), ["p_brand"], "p_partkey", "p_size", ["p_size", "p_name"], "p_type", 8, 25.0)


def _percentile(value: str, group: str) -> str:
    return f"CASE WHEN {value} > 0 THEN cume_dist() OVER (PARTITION BY {group}, {value} > 0 ORDER BY {value}) ELSE 0 END"


@query(f"""
    WITH RECURSIVE c AS (SELECT l_returnflag AS pair, l_linestatus AS side, l_suppkey AS position, {_percentile("l_extendedprice", "l_returnflag")} AS p FROM lineitem),
    t AS (SELECT * FROM c WHERE p > 0 QUALIFY row_number() OVER (PARTITION BY pair, side, position ORDER BY p DESC) <= 3),
    m AS (SELECT pair, side, position, max(p) + (sum(p ORDER BY p DESC) - max(p)) * 0.5::DOUBLE AS marginal FROM t GROUP BY 1, 2, 3),
    b AS (SELECT *, {_percentile("marginal", "pair, side")} AS base FROM m),
    ordered AS (SELECT (pair, side) AS g, {{'k': position}} AS s, row_number() OVER (PARTITION BY pair, side ORDER BY base DESC, position) AS o FROM b WHERE base > 0),
    {greedy_sql.greedy("ordered", "abs(a.k - r.s.k) <= 3", 3)},
    k AS (SELECT b.*, coalesce((SELECT sum((5.0::DOUBLE - abs(b.position - c.k)) / 5.0::DOUBLE) FROM chosen c WHERE c.g = (b.pair, b.side) AND abs(b.position - c.k) <= 4), 0) AS region FROM b),
    r AS (SELECT *, base * (0.25::DOUBLE + 0.75::DOUBLE * least(region, 1)) AS raw FROM k),
    f AS (SELECT *, {_percentile("raw", "pair, side")} AS final FROM r)
    SELECT pair, side, position, round(marginal, 6) AS marginal, round(base, 6) AS base, round(region, 6) AS region, round(final, 6) AS final, row_number() OVER (PARTITION BY pair, side ORDER BY final DESC, position) AS rank FROM f""")
def residue_first(t):
    cells = t("lineitem").select(F.col("l_returnflag").alias("pair"), F.col("l_linestatus").alias("side"), F.col("l_suppkey").alias("position"), "l_partkey", "l_extendedprice")
    out = scoring.residue_first(cells, ["pair"], "side", "position", "l_extendedprice")
    return out.select("pair", "side", "position", r6("marginal"), r6("base"), r6("region"), r6("final"), "rank")


@query()
def needleman(t):
    one = t("part").select("p_brand", F.col("p_name").alias("a"), F.col("p_type").alias("b"))
    return alignment.align_pairs(one, "a", "b").select("a", "b", "score", "matches", "aligned", r6("identity"), r6("block_identity"))


@query()
def logreg_oof(t):
    e = _labelled(t).join(t("documents").select("doc_id", F.length("text").alias("length"), F.regexp_count("text", F.lit(r"\n")).alias("lines"), F.regexp_count("text", F.lit("[0-9]")).alias("digits")), "doc_id")
    e = ml.balanced_weights(ml.derived(e, {"length_lines": ("length", "lines")}, {"log_length": "length"}), "source", "quality", "weight")
    folds = ml.group_folds(e, "source", 3)
    out = ml.out_of_fold(e, folds, "source", "quality", "weight", ["length", "lines", "digits", "length_lines", "log_length"], 3)
    return out.select("doc_id", "fold", F.round("probability", 4).alias("probability"))


_STRENGTHS = ", ".join(f"coalesce(max({c}) FILTER (branch = '{b}'), 0) AS {b}_strength" for b, c in (("fragments", "top"), ("conservation", "best"), ("coupling", "top")))
_COMPONENTS = ", ".join(f"{_percentile(f'{b}_strength', 'pair, side')} AS {b}_component" for b in ("fragments", "conservation", "coupling"))
_ORDERED = ", ".join(f"o_{b} AS (SELECT (pair, side) AS g, {{'k': idx, 'h': {b}_component}} AS s, row_number() OVER (PARTITION BY pair, side ORDER BY {b}_component DESC, idx) AS o FROM comp WHERE {b}_component > 0), {greedy_sql.greedy(f'o_{b}', 'abs(a.k - r.s.k) <= 2', 3, f'c_{b}')}" for b in ("fragments", "conservation"))
_REGIONS = ", ".join(f"coalesce((SELECT sum(c.s.h * (3.0::DOUBLE - abs(comp.idx - c.k)) / 3.0::DOUBLE) FROM c_{b} c WHERE c.g = (comp.pair, comp.side) AND abs(comp.idx - c.k) <= 2), 0) AS {b}_region" for b in ("fragments", "conservation"))


@query(f"""
    WITH RECURSIVE l AS (SELECT o_orderpriority AS pair, c_nationkey + 1 AS i, s_nationkey + 1 AS j, l_quantity, l_extendedprice, l_returnflag
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
    sums AS (SELECT pair, i, j, max(l_quantity) FILTER (l_returnflag = 'R') AS fragments, round(sum(l_quantity), 2) AS conservation, round(max(l_extendedprice), 2) AS coupling FROM l GROUP BY 1, 2, 3),
    cells AS (SELECT * FROM (SELECT pair, i, j, 'fragments' AS branch, fragments::DOUBLE AS score FROM sums UNION ALL SELECT pair, i, j, 'conservation', conservation FROM sums UNION ALL SELECT pair, i, j, 'coupling', coupling FROM sums) WHERE score > 0),
    best AS (SELECT *, row_number() OVER (PARTITION BY pair, branch ORDER BY score DESC, i, j) AS rn, max(score) OVER (PARTITION BY pair, branch) AS peak, cume_dist() OVER (PARTITION BY pair, branch ORDER BY score) AS pct FROM cells),
    norm AS (SELECT pair, branch, i, j, CASE WHEN branch = 'coupling' THEN score / peak ELSE pct END AS score FROM best WHERE branch <> 'coupling' OR rn <= 40),
    flat AS (SELECT pair, branch, 1 AS side, i AS idx, score FROM norm UNION ALL SELECT pair, branch, 2, j, score FROM norm),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY pair, side, idx, branch ORDER BY score DESC) AS rn FROM flat),
    tops AS (SELECT pair, side, idx, branch, max(score) AS best, max(score) + (sum(score ORDER BY score DESC) FILTER (rn <= 3) - max(score)) * 0.5::DOUBLE AS top FROM ranked GROUP BY 1, 2, 3, 4),
    every AS (SELECT pair, side, idx FROM (SELECT DISTINCT pair FROM cells), (VALUES (1), (2)) v(side), range(1, 26) r(idx)),
    strength AS (SELECT every.pair, every.side, every.idx, {_STRENGTHS} FROM every LEFT JOIN tops USING (pair, side, idx) GROUP BY 1, 2, 3),
    comp AS (SELECT *, {_COMPONENTS} FROM strength),
    {_ORDERED},
    regions AS (SELECT *, {_REGIONS} FROM comp),
    spread AS (SELECT pair, count(*) / 625::DOUBLE AS density, (count(DISTINCT i) / 25::DOUBLE + count(DISTINCT j) / 25::DOUBLE) / 2 AS breadth FROM norm WHERE branch = 'fragments' GROUP BY 1),
    trust AS (SELECT pair, greatest(0.05::DOUBLE, least(1, 0.75::DOUBLE * (1 - density) + 0.25::DOUBLE * greatest(0, least(1, (1 - breadth) / 0.5::DOUBLE)))) AS reliability FROM spread),
    patched AS (SELECT regions.*, conservation_region + coalesce(reliability, 0) * fragments_region + 0.5::DOUBLE * least(conservation_region, coalesce(reliability, 0) * fragments_region) AS raw FROM regions LEFT JOIN trust USING (pair)),
    patch AS (SELECT *, {_percentile("raw", "pair, side")} AS patch FROM patched),
    guided AS (SELECT *, coupling_component * (0.25::DOUBLE + 0.75::DOUBLE * patch) AS led FROM patch),
    bonus AS (SELECT *, {_percentile("led", "pair, side")} AS bonus FROM guided),
    total AS (SELECT bonus.*, patch + 0.35::DOUBLE * least(1, coalesce(n, 0) / 40::DOUBLE) * bonus AS total FROM bonus LEFT JOIN (SELECT pair, count(*) AS n FROM norm WHERE branch = 'coupling' GROUP BY 1) USING (pair)),
    done AS (SELECT *, {_percentile("total", "pair, side")} AS final FROM total)
    SELECT pair, side, idx, round(fragments_component, 6) AS fragments_component, round(conservation_component, 6) AS conservation_component, round(coupling_component, 6) AS coupling_component, round(patch, 6) AS patch, round(final, 6) AS final,
           row_number() OVER (PARTITION BY pair, side ORDER BY final DESC, idx) AS rank FROM done""")
def pair_scores(t):
    """Order priorities as pairs, nations of customers and suppliers as their sides, three figures as branches."""
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    cell = lines.select(F.col("o_orderpriority").alias("pair"), (F.col("c_nationkey") + 1).cast("long").alias("i"), (F.col("s_nationkey") + 1).cast("long").alias("j"), "l_quantity", "l_extendedprice", "l_returnflag")
    branches = {"fragments": F.max(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))), "conservation": F.round(F.sum("l_quantity"), 2), "coupling": F.round(F.max("l_extendedprice"), 2)}
    sums = cell.groupBy("pair", "i", "j").agg(*[c.alias(b) for b, c in branches.items()])
    cells = sums.select("pair", "i", "j", F.explode(F.array(*[F.struct(F.lit(b).alias("branch"), F.col(b).cast("double").alias("score")) for b in branches])).alias("x")).select("pair", "i", "j", "x.*").where("score > 0")
    sizes = cells.select("pair").distinct().withColumn("l1", F.lit(25)).withColumn("l2", F.lit(25))
    out = pair_scoring.score_pairs(pair_scoring.normalise(cells, ["coupling"]), sizes, {"coupling": 0.35}, seeds=3, radius=2)
    return out.select("pair", "side", "idx", *[r6(c) for c in ("fragments_component", "conservation_component", "coupling_component", "patch", "final")], "rank")


@query("""
    WITH q AS (SELECT c_mktsegment, min(c_name) AS q FROM customer GROUP BY 1),
    l AS (SELECT c_mktsegment, unnest(range(1, length(q) + 1)) AS position, q, c_name FROM customer JOIN q USING (c_mktsegment)),
    c AS (SELECT c_mktsegment, position, count(*) AS n, count(*) FILTER (substr(c_name, position, 1) NOT IN ('-', '.', '')) AS f,
                 count(*) FILTER (substr(c_name, position, 1) = substr(q, position, 1) AND substr(c_name, position, 1) NOT IN ('-', '.', '')) AS m FROM l GROUP BY 1, 2)
    SELECT c_mktsegment, position, round(CASE WHEN f > 0 THEN m / f::DOUBLE ELSE 0 END, 6) AS conservation, round(f / n::DOUBLE, 6) AS coverage,
           round(CASE WHEN f > 0 THEN m / f::DOUBLE ELSE 0 END * (f / n::DOUBLE), 6) AS profile FROM c""")
def conservation_profile(t):
    names = t("customer")
    rows = names.join(names.groupBy("c_mktsegment").agg(F.min("c_name").alias("q")), "c_mktsegment")
    df = aggregates.conservation_profile(rows, ["c_mktsegment"], "q", "c_name")
    return df.select("c_mktsegment", "position", r6("conservation"), r6("coverage"), r6("profile"))
