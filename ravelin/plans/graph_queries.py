"""Pairs, evidence, look-ups, audits and set operations over the order tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ravelin.functions import identifiers
from ravelin.operators import aggregates, evidence, joins, scoring, selection
from ravelin.plans.registry import query, r6
from ravelin.plans.staging import tasks_for

_PAIRS = """
    SELECT a.l_partkey AS a, b.l_partkey AS b, count(DISTINCT a.l_orderkey) AS support
    FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b
      ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2"""


def _pairs(t):
    lines = t("lineitem")
    one = lines.select("l_orderkey", "l_partkey").distinct()
    two = one.select("l_orderkey", F.col("l_partkey").alias("b"))
    lo, hi = identifiers.ordered_pair(F.col("l_partkey"), F.col("b"))
    # A pair of parts of an order, each order once. Few pairs are alike, so they are dealt to as many tasks as the lines ask before they are counted.
    met = one.join(two, "l_orderkey").where("l_partkey < b").select(lo.alias("a"), hi.alias("b"))
    return met.repartition(tasks_for(lines), "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("support"))


@query(_PAIRS)
def pair_graph(t):
    return _pairs(t)


@query("""
    WITH f AS (
        SELECT l_partkey, l_suppkey, l_returnflag, count(*) AS seen,
               min({'o': l_orderkey, 'n': l_linenumber, 's': l_linestatus, 'd': l_shipdate}) AS first
        FROM lineitem GROUP BY 1, 2, 3)
    SELECT l_partkey, l_suppkey, count(*) AS evidence, sum(seen)::BIGINT AS seen,
           array_to_string(list_sort(list(DISTINCT l_returnflag)), ';') AS flags, array_to_string(list_sort(list(DISTINCT first.s)), ';') AS states
    FROM f GROUP BY 1, 2""")
def pair_first_writer(t):
    key = ["l_partkey", "l_suppkey", "l_returnflag"]
    first = aggregates.first_writer(t("lineitem"), key, ["l_orderkey", "l_linenumber", "l_linestatus", "l_shipdate"], ["l_linestatus"], "seen")
    sets = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ";")
    return first.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("evidence"), F.sum("seen").alias("seen"), sets("l_returnflag").alias("flags"), sets("l_linestatus").alias("states"))


@query("""
    WITH p AS (SELECT o_custkey, o_orderpriority, min(o_orderstatus) AS lo, max(o_orderstatus) AS hi FROM orders GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rn FROM p)
    SELECT o_custkey, CASE WHEN lo = hi THEN lo END AS status FROM b WHERE rn = 1""")
def alias_resolve(t):
    return aggregates.best_unambiguous(t("orders"), ["o_custkey"], "o_orderpriority", "o_orderstatus", "status")


@query("""
    SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def best_hit(t):
    best = aggregates.best_row(t("orders"), ["o_custkey"], [-F.col("o_totalprice"), F.col("o_orderdate"), F.col("o_orderkey")])
    return best.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")


@query(f"""
    WITH p AS ({_PAIRS}), l AS (SELECT l_partkey AS k, max(l_quantity) AS lq FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
    r AS (SELECT l_partkey AS k, max(l_tax) AS rt FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
    SELECT a, b, support, lq, rt FROM p JOIN l ON a = l.k JOIN r ON b = r.k
    UNION ALL SELECT a, b, support, lq, rt FROM p JOIN l ON b = l.k JOIN r ON a = r.k""")
def orientation_join(t):
    li = t("lineitem")
    left = li.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("k")).agg(F.max("l_quantity").alias("lq"))
    right = li.where("l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("k")).agg(F.max("l_tax").alias("rt"))
    return joins.orientations(_pairs(t), left, right, "a", "b", "k").select("a", "b", "support", "lq", "rt")


@query(f"""
    WITH p AS ({_PAIRS}), s AS (SELECT a AS node, b AS partner, support FROM p UNION ALL SELECT b, a, support FROM p)
    SELECT node, partner, support, row_number() OVER (PARTITION BY node ORDER BY support DESC, partner) AS rank FROM s""")
def neighbour_partners(t):
    return joins.neighbours(_pairs(t), "a", "b", "support")


@query("""
    SELECT 'order_without_lines' AS problem, o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT 'customer_without_orders', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def completeness_anti(t):
    o, li, c = t("orders"), t("lineitem"), t("customer")
    lines = o.join(li, o["o_orderkey"] == li["l_orderkey"], "left_anti").select(F.lit("order_without_lines").alias("problem"), F.col("o_orderkey").alias("key"))
    idle = c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select(F.lit("customer_without_orders"), "c_custkey")
    return lines.union(idle)


@query("""
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (
        SELECT l_orderkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')""")
def semi_backed(t):
    n = t("nation").join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    li = t("lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return t("orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, c.n_name AS customer_nation, s.n_name AS supplier_nation,
           CASE WHEN c.n_name IS NULL THEN 'customer_missing' WHEN s.n_name IS NULL THEN 'supplier_missing' ELSE 'kept' END AS reason
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation c ON c_nationkey = c.n_nationkey
    LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation s ON s_nationkey = s.n_nationkey""")
def double_lookup(t):
    n = t("nation")
    customer = t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("customer_nation"))
    supplier = t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("supplier_nation"))
    o = t("orders").select("o_orderkey", "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    both = t("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    reason = joins.first_reason([("customer_missing", F.col("customer_nation").isNull()), ("supplier_missing", F.col("supplier_nation").isNull())])
    return both.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "customer_nation", "supplier_nation", reason.alias("reason"))


@query("""
    WITH o AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders),
    s AS (SELECT l_orderkey AS k, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS v FROM lineitem GROUP BY 1),
    l AS (SELECT k, CASE WHEN count(*) = 1 THEN min(v) END AS v, count(*) AS n FROM (SELECT * FROM o UNION ALL SELECT * FROM o WHERE k % 70 = 0) GROUP BY 1),
    r AS (SELECT k, CASE WHEN count(*) = 1 THEN min(v) END AS v, count(*) AS n FROM (SELECT * FROM s UNION ALL SELECT k, v + 1 FROM s WHERE k % 50 = 0) GROUP BY 1)
    SELECT coalesce(l.k, r.k) AS k, l.v AS left_value, r.v AS right_value,
           CASE WHEN l.n > 1 OR r.n > 1 THEN 'duplicate' WHEN r.k IS NULL THEN 'missing_right' WHEN l.k IS NULL THEN 'extra_right' WHEN abs(l.v - r.v) <= 0.01 THEN 'matched' ELSE 'mismatch' END AS status
    FROM l FULL JOIN r ON l.k = r.k""")
def audit_full_outer(t):
    """Orders against their lines; some keys occur twice on either side."""
    orders = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))), 2).alias("v"))
    twice = lambda df, n, v: df.unionByName(df.where(F.col("k") % n == 0).withColumn("v", v))
    return joins.audit(twice(orders, 70, F.col("v")), twice(lines, 50, F.col("v") + 1), ["k"], "v", 0.01)


@query("""
    WITH a AS (SELECT doc_id, min(quality) AS v1, count(DISTINCT quality) AS n1 FROM labels GROUP BY 1),
    b AS (SELECT source, lang, min(toxic) AS v2, count(DISTINCT toxic) AS n2 FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2)
    SELECT doc_id, coalesce(CASE WHEN n1 = 1 THEN v1 WHEN n1 > 1 THEN NULL WHEN n2 = 1 THEN v2 END, -1) AS value,
           CASE WHEN n1 = 1 THEN '1' WHEN n1 > 1 THEN 'ambiguous' WHEN n2 = 1 THEN '2' WHEN n2 > 1 THEN 'ambiguous' ELSE 'not_found' END AS status
    FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN b USING (source, lang)""")
def cascade_lookup(t):
    d = t("documents").select("doc_id", "source", "lang")
    by_place = d.join(t("labels"), "doc_id").select("source", "lang", "toxic")
    return joins.cascade(d, [(t("labels"), ["doc_id"], "quality"), (by_place, ["source", "lang"], "toxic")], "value").select("doc_id", F.coalesce("value", F.lit(-1)).alias("value"), "status")


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CASE WHEN l_quantity < 5 THEN 'small' WHEN l_discount > 0.08 THEN 'discounted' WHEN l_returnflag = 'R' THEN 'returned' ELSE 'kept' END AS reason
    FROM lineitem""")
def drop_reasons(t):
    reason = joins.first_reason([("small", F.col("l_quantity") < 5), ("discounted", F.col("l_discount") > 0.08), ("returned", F.col("l_returnflag") == "R")])
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", reason.alias("reason"))


@query("""
    WITH r AS (SELECT l_linestatus AS source, CASE WHEN l_quantity < 5 THEN 'small' WHEN l_discount > 0.08 THEN 'discounted' ELSE 'kept' END AS reason FROM lineitem)
    SELECT source, reason, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY source)::DOUBLE, 6) AS share FROM r GROUP BY 1, 2""")
def drop_accounting(t):
    reason = joins.first_reason([("small", F.col("l_quantity") < 5), ("discounted", F.col("l_discount") > 0.08)])
    counts = t("lineitem").groupBy(F.col("l_linestatus").alias("source"), reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("source"))))


@query("""
    WITH o AS (
        SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f, max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS o,
               max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS p, count(DISTINCT o_orderpriority) AS kinds, count(*) AS n, max(o_totalprice)::BIGINT AS top
        FROM orders GROUP BY 1)
    SELECT o_custkey, round(4.0 * f + 3.5 * o + 1.0 * p + 0.5 * least(kinds, 4) + 0.05 * least(n, 10) + least(top, 1000) / 1000.0, 6)::DOUBLE AS score,
           CASE WHEN f + o + p = 0 THEN 'unknown' WHEN f + o + p = 1 THEN array_to_string(list_filter([CASE WHEN f > 0 THEN 'f' END, CASE WHEN o > 0 THEN 'o' END, CASE WHEN p > 0 THEN 'p' END], lambda x: x IS NOT NULL), '') || '_only'
                ELSE array_to_string(list_filter([CASE WHEN f > 0 THEN 'f' END, CASE WHEN o > 0 THEN 'o' END, CASE WHEN p > 0 THEN 'p' END], lambda x: x IS NOT NULL), '_plus_') END AS source_label
    FROM o""")
def support_score(t):
    has = lambda s: F.max((F.col("o_orderstatus") == s).cast("int"))
    o = t("orders").groupBy("o_custkey").agg(has("F").alias("f"), has("O").alias("o"), has("P").alias("p"), F.count_distinct("o_orderpriority").alias("kinds"), F.count(F.lit(1)).alias("n"), F.round(F.max("o_totalprice")).cast("long").alias("top"))
    scored = scoring.support_score(o, {"f": 4.0, "o": 3.5, "p": 1.0}, {"kinds": (0.5, 4), "n": (0.05, 10)}, "top", {"f": "f", "o": "o", "p": "p"}, "score")
    return scored.select("o_custkey", r6("score"), "source_label")


@query("""
    SELECT p_partkey, CASE WHEN p_size IS NULL THEN 'unknown' WHEN p_size < 10 THEN 'small' WHEN p_size <= 30 THEN 'medium' ELSE 'large' END AS size_bin,
           CASE WHEN p_size IS NULL OR p_size = 0 THEN 'unknown' WHEN p_retailprice / p_size <= 50 THEN 'low' WHEN p_retailprice / p_size <= 200 THEN 'mid' ELSE 'high' END AS ratio_bin
    FROM part""")
def binning(t):
    ratio = identifiers.safe_ratio(F.col("p_retailprice"), F.col("p_size"))
    size = F.when(F.col("p_size") < 10, "small").otherwise(identifiers.binned(F.col("p_size"), [(30, "medium")], "large"))
    return t("part").select("p_partkey", size.alias("size_bin"), identifiers.binned(ratio, [(50, "low"), (200, "mid")], "high").alias("ratio_bin"))


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, c.channel, c.score FROM lineitem,
        LATERAL (SELECT unnest(['quantity', 'discount', 'tax']) AS channel, unnest([l_quantity, l_discount, l_tax]) AS score) c WHERE c.score > 0
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'generic', NULL FROM lineitem
    WHERE NOT (coalesce(l_quantity, 0) > 0 OR coalesce(l_discount, 0) > 0 OR coalesce(l_tax, 0) > 0)""")
def channel_unpivot(t):
    keep = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    df = t("lineitem").select(*keep, F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return joins.unpivot_positive(df, keep, ["quantity", "discount", "tax"], "generic")


@query("""
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, regexp_replace(lower(event_type), '[^a-z0-9]+', '_', 'g') AS kind FROM events""")
def term_parse(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.regexp_replace(F.lower("event_type"), "[^a-z0-9]+", "_").alias("kind"))


@query(r"""
    SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_replace(regexp_replace(lower(url), '^https?://', ''), '[?#].*$', '') AS canonical FROM pages""")
def canonical_id(t):
    canonical = F.regexp_replace(F.regexp_replace(F.lower("url"), "^https?://", ""), "[?#].*$", "")
    return t("pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), canonical.alias("canonical"))


@query("""
    SELECT 'union' AS op, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'intersect', k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'except', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)""")
def set_ops(t):
    c, s = t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k"))
    parts = {"union": c.union(s).distinct(), "intersect": c.intersect(s), "except": c.exceptAll(s).distinct().join(s, "k", "left_anti")}
    out = [df.select(F.lit(op).alias("op"), "k") for op, df in parts.items()]
    return out[0].union(out[1]).union(out[2])


@query("""
    SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_extendedprice DESC, l_quantity DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM lineitem)
    WHERE rank <= 10""")
def top_limit(t):
    order = [F.col("l_shipdate"), F.col("l_extendedprice").desc(), F.col("l_quantity").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return selection.first_rows(t("lineitem"), ["l_suppkey"], order, 10).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "rank")


@query(f"""
    WITH p AS ({_PAIRS}), j AS (
        SELECT p.*, x.p_brand AS ba, y.p_brand AS bb FROM p JOIN part x ON a = x.p_partkey JOIN part y ON b = y.p_partkey)
    SELECT least(ba, bb) AS lo, greatest(ba, bb) AS hi, a, b, support FROM (
        SELECT *, row_number() OVER (PARTITION BY least(ba, bb), greatest(ba, bb) ORDER BY support DESC, a, b) AS rn FROM j) WHERE rn = 1""")
def cluster_pair_best(t):
    brand = t("part").select("p_partkey", "p_brand")
    j = _pairs(t).join(brand.toDF("a", "ba"), "a").join(brand.toDF("b", "bb"), "b")
    best = selection.best_per_pair(j, "ba", "bb", [F.col("support").desc(), F.col("a"), F.col("b")])
    return best.select(F.least("ba", "bb").alias("lo"), F.greatest("ba", "bb").alias("hi"), "a", "b", "support")


@query("""
    WITH c AS (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1), s AS (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1),
    p AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
    SELECT l_partkey, l_suppkey, c.q + s.q AS rank_sum, row_number() OVER (PARTITION BY l_suppkey ORDER BY c.q + s.q DESC, l_partkey) AS rank
    FROM p JOIN c USING (l_partkey) JOIN s USING (l_suppkey)""")
def common_key_top(t):
    li = t("lineitem")
    c, s = li.groupBy("l_partkey").agg(F.sum("l_quantity").alias("cq")), li.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("sq"))
    both = li.select("l_partkey", "l_suppkey").distinct().join(c, "l_partkey").join(s, "l_suppkey").withColumn("rank_sum", F.col("cq") + F.col("sq"))
    rank = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.col("rank_sum").desc(), "l_partkey")).cast("long")
    return both.select("l_partkey", "l_suppkey", "rank_sum", rank.alias("rank"))


@query("""
    WITH e AS (SELECT l_returnflag AS source, unnest([l_partkey, l_suppkey]) AS protein, unnest([l_linestatus, l_returnflag]) AS taxid FROM lineitem)
    SELECT protein, array_to_string(list_sort(list(DISTINCT source)), ';') AS sources, array_to_string(list_sort(list(DISTINCT taxid)), ';') AS taxids FROM e GROUP BY 1""")
def protein_universe(t):
    df = evidence.universe(t("lineitem"), "l_partkey", "l_suppkey", "l_linestatus", "l_returnflag", "l_returnflag")
    return df.select("protein", F.array_join("sources", ";").alias("sources"), F.array_join("taxids", ";").alias("taxids"))


@query("""
    WITH m AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
    SELECT c_custkey, c_name, o_orderstatus, o_orderpriority FROM customer LEFT JOIN m ON c_custkey = o_custkey AND rn = 1""")
def case_metadata(t):
    m = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    return evidence.add_metadata(t("customer"), m, "c_custkey", ["o_orderdate", "o_orderkey"]).select("c_custkey", "c_name", "o_orderstatus", "o_orderpriority")


@query("""
    SELECT d.doc_id, d.lang, d.n_chars, coalesce(l.quality, -1) AS quality, coalesce(l.n_chars, -1) AS n_chars__from_labels FROM documents d
    LEFT JOIN (SELECT doc_id, quality, toxic AS n_chars FROM labels) l USING (doc_id)""")
def merged_scores(t):
    other = t("labels").select("doc_id", "quality", F.col("toxic").alias("n_chars"))
    df = evidence.merge_scores(t("documents").select("doc_id", "lang", "n_chars"), other, ["doc_id"], "labels")
    fill = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return df.select("doc_id", "lang", "n_chars", fill("quality"), fill("n_chars__from_labels"))


@query("""
    WITH e AS (SELECT s.n_regionkey AS region, list_sort(list(DISTINCT c_mktsegment)) AS r, list_sort(list(DISTINCT o_orderpriority)) AS l
               FROM customer JOIN nation s ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1),
    x AS (SELECT region, unnest(r) AS receptor, generate_subscripts(r, 1) AS i, l FROM e), y AS (SELECT region, receptor, i, unnest(l) AS ligand, generate_subscripts(l, 1) AS j FROM x)
    SELECT region, receptor, ligand, row_number() OVER (PARTITION BY region ORDER BY i, j) AS pair_number FROM y""")
def chain_expansion(t):
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("orders"), F.col("o_custkey") == F.col("c_custkey"))
    sets = rows.groupBy(F.col("n_regionkey").alias("region")).agg(F.array_sort(F.collect_set("c_mktsegment")).alias("r"), F.array_sort(F.collect_set("o_orderpriority")).alias("l"))
    return evidence.expand_chains(sets, "region", "r", "l").select("region", "receptor", "ligand", "pair_number")


@query("""
    WITH f AS (SELECT c_nationkey AS k, 0 AS priority, c_name AS name FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey, 1, s_name FROM supplier),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY priority, name) AS rn FROM f)
    SELECT n_nationkey AS k, coalesce(priority, -1) AS priority, coalesce(name, 'missing') AS name FROM nation LEFT JOIN r ON n_nationkey = k AND rn = 1""")
def source_priority(t):
    first = t("customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"))
    second = t("supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"))
    found, missing = evidence.by_priority([first, second], "k", t("nation").select(F.col("n_nationkey").alias("k")))
    return found.select("k", "priority", "name").unionByName(missing.select("k", F.lit(-1).alias("priority"), F.lit("missing").alias("name")))


@query("""
    WITH e AS (SELECT doc_id, lang, source, n_chars, quality FROM documents JOIN labels USING (doc_id)), g AS (SELECT lang, source, sum(quality)::BIGINT AS positives, max(n_chars) AS peak FROM e GROUP BY 1, 2),
    q AS (SELECT quantile_cont(peak, 0.75) AS peak_quantile FROM g WHERE peak > 0)
    SELECT doc_id, positives, peak, round(peak_quantile, 6) AS peak_quantile, positives > 0 AND peak >= peak_quantile AS is_primary FROM e JOIN g USING (lang, source), q""")
def group_annotations(t):
    e = t("documents").join(t("labels"), "doc_id").select("doc_id", "lang", "source", "n_chars", "quality")
    return evidence.annotate(e, ["lang", "source"], "quality", "n_chars").select("doc_id", "positives", "peak", r6("peak_quantile"), "is_primary")


@query("""
    WITH c AS (SELECT DISTINCT o_orderpriority AS entry, l_linenumber AS pa, l_quantity::INT AS pb FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    m AS (SELECT o_orderpriority AS entry, o_orderstatus AS chain, (o_orderkey % 50)::INT AS pos, (o_custkey % 100)::INT AS at_pos FROM orders),
    j AS (SELECT c.entry, l.chain AS cl, r.chain AS cr, l.at_pos AS i, r.at_pos AS j FROM c JOIN m l ON c.entry = l.entry AND l.chain = 'F' AND c.pa = l.pos JOIN m r ON c.entry = r.entry AND r.chain = 'O' AND c.pb = r.pos
          UNION ALL SELECT c.entry, l.chain, r.chain, l.at_pos, r.at_pos FROM c JOIN m l ON c.entry = l.entry AND l.chain = 'O' AND c.pb = l.pos JOIN m r ON c.entry = r.entry AND r.chain = 'F' AND c.pa = r.pos),
    b AS (SELECT *, min({'c': cl, 'd': cr}) OVER (PARTITION BY entry) AS best FROM j)
    SELECT DISTINCT entry, i, j FROM b WHERE cl = best.c AND cr = best.d""")
def contact_transfer(t):
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    contacts = lines.select(F.col("o_orderpriority").alias("entry"), F.lit("F").alias("chain_a"), F.col("l_linenumber").alias("pos_a"), F.lit("O").alias("chain_b"), F.col("l_quantity").cast("int").alias("pos_b")).distinct()
    m = t("orders").select(F.col("o_orderpriority").alias("entry"), F.col("o_orderstatus").alias("chain"), (F.col("o_orderkey") % 50).cast("int").alias("pos"), (F.col("o_custkey") % 100).cast("int").alias("at"), F.lit(0.0).alias("evalue"), F.lit(1.0).alias("bits"))
    return evidence.transfer_contacts(contacts, m, m)
