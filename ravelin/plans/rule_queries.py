"""Rules on values, rows and columns: identifiers, properties, alignments, joins that check, features, structures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.functions import identifiers, residues
from ravelin.operators import aggregates, alignment, clusters, evidence, feature_sets, joins, ml, scoring, spatial
from ravelin.plans import greedy_sql
from ravelin.plans.registry import query, r6
from ravelin.plans.score_queries import _XYZ, _points

_NAMED = "SELECT c_custkey AS k, c_custkey % 6 AS v, 'P' || lpad((c_custkey % 100000)::VARCHAR, 5, '0') AS p, 'A0A' || lpad((c_custkey % 10000000)::VARCHAR, 7, '0') AS ten FROM customer"


def _named(t):
    k, v = F.col("c_custkey"), F.col("c_custkey") % 6
    p, ten = F.concat(F.lit("P"), F.lpad((k % 100000).cast("string"), 5, "0")), F.concat(F.lit("A0A"), F.lpad((k % 10000000).cast("string"), 7, "0"))
    forms = [F.concat(F.lit("uniprotkb:"), p), F.concat(F.lit(" sp|"), p, F.lit("|NAME_X ")), F.concat(F.lower(p), F.lit("-2")), F.concat(F.lit("chebi:"), p), F.concat(F.lit("9606:"), p), ten]
    return t("customer").select(k.alias("k"), p.alias("p"), F.element_at(F.array(*forms), (v + 1).cast("int")).alias("x"))


@query(f"""
    WITH n AS ({_NAMED}) SELECT k, coalesce(CASE WHEN v <= 2 THEN p END, 'none') AS strict, coalesce(CASE WHEN v IN (1, 2, 4) THEN p WHEN v = 5 THEN ten END, 'none') AS with_taxid,
           coalesce(CASE WHEN v IN (1, 2) THEN p WHEN v = 5 THEN ten END, 'none') AS loose FROM n""")
def accessions(t):
    told = {"strict": identifiers.accession_strict, "with_taxid": identifiers.accession_with_taxid, "loose": identifiers.accession_loose}
    return _named(t).select("k", *[F.coalesce(f(F.col("x")), F.lit("none")).alias(n) for n, f in told.items()])


@query(f"""
    WITH n AS ({_NAMED}) SELECT k, CASE k % 4 WHEN 1 THEN 'none' WHEN 3 THEN 'none' ELSE p END AS value, CASE k % 4 WHEN 1 THEN 'ambiguous' WHEN 3 THEN 'missing' ELSE 'ok' END AS status FROM n""")
def resolved_ids(t):
    n = _named(t)
    first = F.element_at(F.array(F.concat(F.lit("uniprotkb:"), "p", F.lit("|chebi:7|"), "p"), F.concat(F.lit("uniprotkb:"), "p", F.lit("|uniprotkb:Q00001")), F.lit(""), F.lit("-")), (F.col("k") % 4 + 1).cast("int"))
    second = F.when(F.col("k") % 4 == 3, "intact:EBI-1").otherwise(F.col("p"))
    found = identifiers.resolve([first, second], identifiers.accession_strict)
    return n.select("k", found.alias("f")).select("k", F.coalesce("f.value", F.lit("none")).alias("value"), "f.status")


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 1 THEN -1 ELSE l_partkey END AS taxid, coalesce(CASE l_linenumber % 4 WHEN 0 THEN l_quantity WHEN 1 THEN l_discount END, -1) AS number,
           coalesce(CASE WHEN l_linenumber % 4 = 0 OR (l_linenumber % 4 = 1 AND l_discount = 0) THEN CASE WHEN l_linenumber % 4 = 0 THEN l_quantity::BIGINT ELSE 0 END END, -1) AS whole,
           l_returnflag = 'A' AS yes, CASE WHEN l_returnflag = 'N' THEN 'NA' ELSE (l_returnflag = 'A')::VARCHAR END AS shown
    FROM lineitem""")
def parsed_numbers(t):
    li = t("lineitem")
    text = F.element_at(F.array(F.col("l_quantity").cast("string"), F.col("l_discount").cast("string"), F.lit("NaN"), F.lit("x1")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    tax = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("taxid:-"), "l_partkey", F.lit("(in vitro)"))).when(F.col("l_partkey") == 0, F.lit("none")).otherwise(F.concat(F.lit("taxid:"), "l_partkey", F.lit("(human)")))
    word = F.when(F.col("l_returnflag") == "A", F.lit(" Yes ")).otherwise("no")
    state = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "A")
    minus = F.lit(-1)
    taxid = F.when((F.col("l_partkey") == 0) & (F.col("l_linenumber") != 1), F.lit(0)).otherwise(F.coalesce(identifiers.taxid(tax), minus))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", taxid.alias("taxid"), F.coalesce(identifiers.number(text), minus.cast("double")).alias("number"), F.coalesce(identifiers.whole_number(text), minus.cast("long")).alias("whole"), identifiers.flag(word).alias("yes"), identifiers.shown(state).alias("shown"))


@query("""
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || ' (x)=MI:' || lpad((event_id % 10000)::VARCHAR, 4, '0') WHEN 1 THEN event_type || '=MI:0001;second=MI:0002' ELSE '-=-' END AS terms,
           'method:' || event_type || '_a_b' AS slug
    FROM events""")
def term_pairs(t):
    code = F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0")
    one = F.concat(F.lit('psi-mi:"MI:'), code, F.lit('"('), "event_type", F.lit(" (x))"))
    two = F.concat(F.lit('psi-mi:"MI:0001"('), "event_type", F.lit(')|psi-mi:"MI:0002"(second)|psi-mi:"MI:0001"('), "event_type", F.lit(")"))
    field = F.element_at(F.array(one, two, F.lit("-")), (F.col("event_id") % 3 + 1).cast("int"))
    pairs = F.transform(identifiers.terms(field), lambda p: F.concat_ws("=", p["label"], p["id"]))
    return t("events").select("event_id", F.array_join(pairs, ";").alias("terms"), identifiers.slug(F.concat(F.lit("--"), F.upper("event_type"), F.lit(" / A-b!")), "method").alias("slug"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount <= 0 THEN 300 ELSE round(-log10(l_discount), 6) END AS strength FROM lineitem")
def safe_logs(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(identifiers.safe_neglog10(F.col("l_discount")), "strength"))


_LETTERS = "ARNDCQEGHILKMFPSTWYVX"
_PROPERTIES = ", ".join(
    f"('{a}', {residues.CHARGE.get(a, 0)}, {str(a in residues.HYDROPHOBIC).lower()}, {str(a in residues.POLAR).lower()}, {str(a in residues.AROMATIC).lower()}, {residues.LARGEST_AREA.get(a, 'NULL')}::DOUBLE, {residues.HYDROPATHY.get(a, 0.0)}::DOUBLE)" for a in _LETTERS
)


@query(f"""
    WITH r(a, charge, hydrophobic, polar, aromatic, area, hydropathy) AS (VALUES {_PROPERTIES}), p AS (SELECT *, '{_LETTERS}'[(p_partkey % 21 + 1)::INT] AS a FROM part)
    SELECT p_partkey, a AS letter, charge, hydrophobic, polar, aromatic, hydropathy, coalesce(round(p_retailprice / area, 6), -1) AS relative FROM p JOIN r USING (a)""")
def residue_properties(t):
    names = {v: k for k, v in residues.ONE_LETTER.items() if k != "MSE"}
    code = F.element_at(F.array(*[F.lit(names.get(a, "UNK")) for a in _LETTERS]), (F.col("p_partkey") % 21 + 1).cast("int"))
    a = F.col("letter")
    flags = {"hydrophobic": residues.HYDROPHOBIC, "polar": residues.POLAR, "aromatic": residues.AROMATIC}
    rows = t("part").withColumn("letter", residues.one_letter(F.lower(code)))
    return rows.select("p_partkey", "letter", residues.charge(a).alias("charge"), *[residues.in_class(a, m).alias(n) for n, m in flags.items()], residues.hydropathy(a).alias("hydropathy"), F.coalesce(r6(residues.relative_area(F.col("p_retailprice"), a)), F.lit(-1.0)).alias("relative"))


_ALIGNED = """
    a AS (SELECT c_custkey AS k, upper(regexp_replace(substr(md5(c_name), 1, 16), '[0-3]', '-', 'g')) AS q, upper(regexp_replace(substr(md5(c_name), 17, 16), '[4-6]', '-', 'g')) AS s, (c_custkey % 5 + 1)::INT AS start FROM customer)"""


def _aligned(t):
    cut = lambda at, gap: F.upper(F.regexp_replace(F.substring(F.md5(F.col("c_name").cast("binary")), at, 16), gap, "-"))
    return t("customer").select(F.col("c_custkey").alias("k"), cut(1, "[0-3]").alias("q"), cut(17, "[4-6]").alias("s"), (F.col("c_custkey") % 5 + 1).cast("int").alias("start"))


@query(f"""
    WITH {_ALIGNED}, r AS (SELECT *, array_to_string(list_transform(list_filter(range(1, 17), lambda i: q[i] <> '-'), lambda i: s[i]), '') AS kept FROM a)
    SELECT k, rpad(repeat('-', start - 1) || kept, 24, '-') AS row, kept AS trimmed FROM r""")
def aligned_rows(t):
    q, s = F.col("q"), F.col("s")
    return _aligned(t).select("k", residues.query_row(q, s, F.col("start"), F.lit(24)).alias("row"), residues.trim_gaps(s, q).alias("trimmed"))


_SEEN = "list_transform(list_filter(range(1, 17), lambda i: q[i] <> '-' AND s[i] <> '-'), lambda i: {})"


@query(f"""
    WITH {_ALIGNED} SELECT k, array_to_string({_SEEN.format("(start + len(replace(q[1:i - 1], '-', '')))::VARCHAR")}, ',') AS up, array_to_string({_SEEN.format("(90 - len(replace(q[1:i - 1], '-', '')))::VARCHAR")}, ',') AS down,
           array_to_string({_SEEN.format("(40 + len(replace(s[1:i - 1], '-', '')))::VARCHAR || ':' || (start + len(replace(q[1:i - 1], '-', '')))::VARCHAR")}, ',') AS map FROM a""")
def aligned_positions(t):
    q, s, start = F.col("q"), F.col("s"), F.col("start")
    places = residues.position_map(q, s, start, start + 30, F.lit(40), F.lit(70))
    pairs = F.transform(F.array_sort(F.map_entries(places)), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return _aligned(t).select("k", listed(residues.covered(q, s, start, start + 30)).alias("up"), listed(residues.covered(q, s, F.lit(90), F.lit(60))).alias("down"), F.array_join(pairs, ",").alias("map"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def complete_join(t):
    orders = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return joins.require_complete(t("lineitem"), orders, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_orderstatus")


@query("SELECT o_orderkey, 1::BIGINT AS n FROM orders")
def unique_keys(t):
    return aggregates.require_unique(t("orders"), ["o_orderkey"])


@query(f"""
    WITH p AS ({_XYZ}) SELECT a.label, a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON a.label = b.label AND a.vec_id < b.vec_id
    WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.15::DOUBLE * 0.15::DOUBLE""")
def radius_brute(t):
    return spatial.radius_pairs(_points(t), "vec_id", "xyz", 0.15, ["label"]).select("label", "a", "b")


@query("""
    WITH p AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_returnflag = 'A')
    SELECT a, b, md5(s_name) || md5(p_name || p_partkey) AS paired FROM p JOIN supplier ON a = s_suppkey JOIN part ON b = p_partkey WHERE s_acctbal > 0 AND p_size > 5""")
def paired_alignment(t):
    pairs = t("lineitem").where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    left = t("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("key"), F.md5(F.col("s_name").cast("binary")).alias("row"))
    right = t("part").where("p_size > 5").select(F.col("p_partkey").alias("key"), F.md5(F.concat("p_name", "p_partkey").cast("binary")).alias("row"))
    return evidence.paired_rows(pairs, left, right, "a", "b", "key", "row").select("a", "b", "paired")


@query("""
    WITH s AS (SELECT o_custkey AS k, o_orderkey AS c, o_totalprice / 3000 AS identity FROM orders),
    r AS (SELECT *, row_number() OVER w AS rn, identity - coalesce(lead(identity) OVER w, 0) AS margin FROM s WINDOW w AS (PARTITION BY k ORDER BY identity DESC, c))
    SELECT k, c, round(identity, 6) AS identity, round(margin, 6) AS margin,
           CASE WHEN identity < 90 AND margin < 5 THEN 'low_identity,ambiguous' WHEN identity < 90 THEN 'low_identity' WHEN margin < 5 THEN 'ambiguous' ELSE 'accepted' END AS status FROM r WHERE rn = 1""")
def best_chain(t):
    scored = t("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("c"), (F.col("o_totalprice") / 3000).alias("identity"))
    return alignment.best_match(scored, "k", "c", "identity", 90.0, 5.0).select("k", "c", r6("identity"), r6("margin"), "status")


@query("""
    WITH p AS (SELECT l_suppkey AS q, l_partkey AS pos, l_returnflag AS role FROM lineitem), m AS (SELECT DISTINCT l_suppkey AS q, l_partkey AS pos, (l_partkey * 7) % 500 AS bound FROM lineitem WHERE l_partkey % 3 > 0),
    i AS (SELECT DISTINCT l_suppkey AS q, (l_partkey * 7) % 500 AS bound FROM lineitem WHERE l_quantity > 40)
    SELECT p.q, p.role, count(*) AS n, count(m.bound) AS mapped, count(i.bound) AS hits, coalesce(round(count(i.bound) / nullif(count(m.bound), 0)::DOUBLE, 6), -1) AS precision
    FROM p LEFT JOIN m ON p.q = m.q AND p.pos = m.pos LEFT JOIN i ON i.q = p.q AND i.bound = m.bound GROUP BY 1, 2""")
def role_precision(t):
    li = t("lineitem").select(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("pos"), F.col("l_returnflag").alias("role"), "l_quantity")
    bound = (F.col("pos") * 7) % 500
    mapping = li.where("pos % 3 > 0").select("q", "pos", bound.alias("bound")).distinct()
    out = evidence.evaluate_roles(li.select("q", "pos", "role"), mapping, li.where("l_quantity > 40").select("q", bound.alias("bound")), "q", "pos", "role")
    return out.select("q", "role", "n", "mapped", "hits", F.coalesce(r6("precision"), F.lit(-1.0)).alias("precision"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, count(value) AS folds FROM events GROUP BY 1")
def coefficient_table(t):
    return ml.coefficient_summary(t("events"), "event_type", "value").select("event_type", r6("mean"), r6("sd"), "folds")


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(l_tax - 0.04, 0) + 0.6 * greatest(l_discount, 0) + 0.4 * greatest(l_quantity - 25, 0), 6) AS direct, round((2 * l_tax + l_discount) / 3, 6) AS mean
    FROM lineitem""")
def direct_support(t):
    li = t("lineitem").withColumn("over", F.col("l_quantity") - 25)
    direct, mean = scoring.direct_support(F.col("l_tax") - F.lit(0.04), {"l_discount": 0.6, "over": 0.4}), scoring.weighted_mean({"l_tax": 2.0, "l_discount": 1.0, "l_quantity": 0.0})
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(direct, "direct"), r6(mean, "mean"))


@query("""
    SELECT doc_id, coalesce(CASE WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN least(quality, toxic, n_chars / 1000.0::DOUBLE) END, -1)::DOUBLE AS hybrid_min,
           coalesce(CASE WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN round((quality + toxic + n_chars / 1000.0::DOUBLE) / 3, 6) END, -1)::DOUBLE AS hybrid_mean FROM documents LEFT JOIN labels USING (doc_id)""")
def hybrid_scores(t):
    d = t("documents").join(t("labels"), "doc_id", "left").withColumn("long", F.col("n_chars") / 1000.0).withColumn("quality", F.col("quality").cast("double")).withColumn("toxic", F.col("toxic").cast("double"))
    out = ml.hybrids(d, ["quality", "toxic", "long"])
    return out.select("doc_id", *[F.coalesce(r6(c), F.lit(-1.0)).alias(c) for c in ("hybrid_min", "hybrid_mean")])


_ROLES = {"l_orderkey": ("identifier", "not_a_feature"), "label_price": ("target", "leakage_guard"), "score__tax": ("score", "feature_safe"), "window_discount": ("feature", "feature_safe"), "structure_quantity": ("feature", "feature_safe"), "l_returnflag": ("feature", "feature_safe")}
_FROM = {"l_orderkey": "l_orderkey", "label_price": "l_extendedprice", "score__tax": "l_tax", "window_discount": "l_discount", "structure_quantity": "l_quantity", "l_returnflag": "l_returnflag"}
_SETS = {"score__tax": "all,only_scores,without_structure,without_windows", "window_discount": "all,only_windows,without_scores,without_structure", "structure_quantity": "all,only_structure,without_scores,without_windows"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, '{r}' AS role, '{s}' AS status, '{_SETS.get(c, '')}' AS sets, count({_FROM[c]}) AS n, {f'round(avg({_FROM[c]}), 6)' if c in _SETS else '-1'}::DOUBLE AS mean FROM lineitem" for c, (r, s) in _ROLES.items()))
def feature_roles(t):
    df = t("lineitem").select(*[F.col(c).alias(n) for n, c in _FROM.items()])
    roles = {c: (r, s) for c, r, s in ml.feature_manifest(df.columns, ["l_orderkey"])}
    safe = ml.safe_features(df, ["l_orderkey"])
    sets = ml.feature_sets(safe, {"scores": ["score__"], "windows": ["window_"], "structure": ["structure_"]})
    named = {c: ",".join(sorted(n for n, m in sets.items() if c in m)) for c in df.columns}
    sums = df.agg(*[F.count(c).alias(f"n_{c}") for c in df.columns], *[F.avg(c).alias(f"m_{c}") for c in safe])
    rows = [F.struct(F.lit(c).alias("name"), F.lit(roles[c][0]).alias("role"), F.lit(roles[c][1]).alias("status"), F.lit(named[c]).alias("sets"), F.col(f"n_{c}").alias("n"), (r6(f"m_{c}") if c in safe else F.lit(-1.0)).alias("mean")) for c in df.columns]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


#: Two tables as features: name to expression, blocks by how names begin, unions that are asked for.
_FEATURES = {
    "lineitem": ({"size_quantity": "l_quantity", "size_price": "l_extendedprice", "rate_discount": "l_discount", "rate_tax": "l_tax", "rate_discount_x_size_quantity": "l_discount * l_quantity", "line": "l_linenumber"}, {"size": "size_", "rate": "rate_", "absent": "absent_"}, [("size", "rate")]),
    "orders": ({"who_customer": "o_custkey", "price_total": "o_totalprice", "time_month": "month(o_orderdate)", "time_month_x_price_total": "month(o_orderdate) * o_totalprice"}, {"who": "who_", "price": "price_", "time": "time_"}, [("who", "price"), ("price", "time")]),
}


@query("""
    WITH s(source, name, members) AS (VALUES
        ('lineitem', 'all', 'abcdef'), ('lineitem', 'only size', 'ab'), ('lineitem', 'without size', 'cdf'), ('lineitem', 'only rate', 'cd'), ('lineitem', 'without rate', 'abf'), ('lineitem', 'size+rate', 'abcde'),
        ('orders', 'all', 'ghij'), ('orders', 'only who', 'g'), ('orders', 'without who', 'hij'), ('orders', 'only price', 'h'), ('orders', 'without price', 'gi'), ('orders', 'only time', 'i'), ('orders', 'without time', 'gh'), ('orders', 'who+price', 'gh'), ('orders', 'price+time', 'hij')),
    m AS (SELECT avg(l_quantity) AS a, avg(l_extendedprice) AS b, avg(l_discount) AS c, avg(l_tax) AS d, avg(l_discount * l_quantity) AS e, avg(l_linenumber) AS f FROM lineitem),
    n AS (SELECT avg(o_custkey) AS g, avg(o_totalprice) AS h, avg(month(o_orderdate)) AS i, avg(month(o_orderdate) * o_totalprice) AS j FROM orders),
    u AS (SELECT * FROM (UNPIVOT m ON a, b, c, d, e, f INTO NAME letter VALUE mean) UNION ALL SELECT * FROM (UNPIVOT n ON g, h, i, j INTO NAME letter VALUE mean))
    SELECT source, name, count(*) AS n, round(sum(mean), 3) AS total FROM s JOIN u ON contains(members, letter) GROUP BY 1, 2""")
def feature_set_means(t):
    """Of each generated set over two tables taken as features: its columns, and the sum of their means."""
    out = []
    for source, (features, prefixes, unions) in _FEATURES.items():
        df = t(source).select(*[F.expr(e).cast("double").alias(n) for n, e in features.items()])
        sets = feature_sets.generate(ml.safe_features(df, []), feature_sets.starting(**prefixes), unions, cross="_x_")
        means = df.agg(*[F.avg(c).alias(c) for c in df.columns])
        rows = [F.struct(F.lit(name).alias("name"), F.lit(len(cs)).cast("long").alias("n"), F.round(sum(F.col(c) for c in cs), 3).alias("total")) for name, cs in sets.items()]
        out.append(means.select(F.lit(source).alias("source"), F.inline(F.array(*rows))))
    return out[0].unionByName(out[1])


def _structure(t) -> DataFrame:
    letter = F.element_at(F.array(*map(F.lit, _LETTERS)), (F.col("vec_id") % 21 + 1).cast("int"))
    return _points(t).withColumn("letter", letter).withColumn("b", F.lit(60.0) + F.col("vec_id") % 40).withColumn("base", F.col("x") + F.lit(0.1)).withColumn("surface", F.abs("z") >= 0.02)


@query(f"""
    WITH h(a, hydropathy) AS (VALUES {", ".join(f"('{a}', {max(residues.HYDROPATHY.get(a, 0.0), 0.0)}::DOUBLE)" for a in _LETTERS)}),
    p AS (SELECT vec_id, label, x, y, z, greatest(x + 0.1::DOUBLE, 0) AS base, abs(z) >= 0.02::DOUBLE AS surface, hydropathy AS wet, 60.0::DOUBLE + vec_id % 40 AS b FROM ({_XYZ}) JOIN h ON a = '{_LETTERS}'[(vec_id % 21 + 1)::INT]),
    q AS (SELECT label, quantile_cont(b, 0.25) AS q1, quantile_cont(b, 0.5) AS q2, quantile_cont(b, 0.75) AS q3 FROM p GROUP BY 1),
    d AS (SELECT a.vec_id, b.base, b.wet, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM p a JOIN p b ON a.label = b.label WHERE a.surface AND b.surface),
    s AS (SELECT vec_id, round(sum(CASE WHEN d2 <= 0.15::DOUBLE * 0.15::DOUBLE THEN base ELSE 0 END), 9) AS m, (count(*) FILTER (d2 <= 0.15::DOUBLE * 0.15::DOUBLE) - 1)::DOUBLE AS n, round(avg(wet) FILTER (d2 <= 0.1::DOUBLE * 0.1::DOUBLE), 9) AS w FROM d GROUP BY 1),
    j AS (SELECT p.*, coalesce(m, 0) AS m, coalesce(n, 0) AS n, coalesce(w, 0) AS w, CASE WHEN q2 >= 70 AND q3 >= 82.5 AND q1 >= 55 THEN least(1, greatest(0, (b - 50) / 40)) ELSE 1 END AS conf FROM p JOIN q USING (label) LEFT JOIN s USING (vec_id)),
    r AS (SELECT *, CASE WHEN m > 0 THEN cume_dist() OVER (PARTITION BY label, m > 0 ORDER BY m) ELSE 0 END AS mass, CASE WHEN n > 0 THEN cume_dist() OVER (PARTITION BY label, n > 0 ORDER BY n) ELSE 0 END AS density, CASE WHEN w > 0 THEN cume_dist() OVER (PARTITION BY label, w > 0 ORDER BY w) ELSE 0 END AS wetness FROM j)
    SELECT vec_id, round(mass, 6) AS mass, round(density, 6) AS density, round(wetness, 6) AS hydrophobic, round(conf, 6)::DOUBLE AS confidence,
           CASE WHEN surface THEN round(base * (0.6 + 0.4 * conf) + 0.35 * mass + 0.15 * density + 0.02 * wetness, 6) ELSE 0 END AS reranked FROM r""")
def structure_rerank(t):
    points = scoring.confidence(_structure(t), ["label"], "b", "confidence")
    rows = scoring.structure_features(points, ["label"], "vec_id", "xyz", F.col("base"), F.col("letter"), F.col("surface"), 0.15, 0.1)
    out = scoring.rerank(rows, F.greatest("base", F.lit(0.0)), F.col("confidence"), F.col("mass"), F.col("density"), F.col("hydrophobic"), 0.02, F.col("surface"))
    return out.select("vec_id", r6("mass"), r6("density"), r6("hydrophobic"), r6("confidence"), r6("reranked"))


@query("""
    WITH v AS (SELECT s_nationkey AS pair, 1 AS side, s_suppkey % 9 AS pos, s_acctbal AS v FROM supplier UNION ALL SELECT c_nationkey, 2, c_custkey % 9, c_acctbal FROM customer),
    a AS (SELECT pair, side, pos, max(v) AS v FROM v GROUP BY 1, 2, 3)
    SELECT pair, side, pos, round(avg(v) OVER (PARTITION BY pair, pos), 6) AS v FROM a""")
def homomer_mean(t):
    one = t("supplier").select(F.col("s_nationkey").alias("pair"), F.lit(1).alias("side"), (F.col("s_suppkey") % 9).alias("pos"), F.col("s_acctbal").alias("v"))
    two = t("customer").select(F.col("c_nationkey"), F.lit(2), F.col("c_custkey") % 9, "c_acctbal")
    best = one.union(two).groupBy("pair", "side", "pos").agg(F.max("v").alias("v"))
    return scoring.symmetrise(best, ["pair"], "side", "pos", "v").select("pair", "side", "pos", r6("v"))


@query("""
    WITH c AS (SELECT l_returnflag AS pair, l_linenumber AS i, l_suppkey % 7 + 1 AS j, max(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2, 3), b AS (SELECT pair, i, j, v FROM c UNION ALL SELECT pair, j, i, v FROM c)
    SELECT pair, i, j, max(v) AS v FROM b GROUP BY 1, 2, 3""")
def homomer_anchor(t):
    c = t("lineitem").groupBy(F.col("l_returnflag").alias("pair"), F.col("l_linenumber").cast("long").alias("i"), (F.col("l_suppkey") % 7 + 1).alias("j")).agg(F.max("l_extendedprice").alias("v"))
    return scoring.homomer_cells(c, ["pair"], "i", "j", "v")


@query()
def redundancy_pruned(t):
    """Parts of a brand in order of key, without those whose name and type resemble an earlier one's."""
    p = t("part").select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("n"), F.col("p_name").alias("a"), F.col("p_type").alias("b"), F.col("p_name").alias("sa"), F.col("p_type").alias("sb"))
    return alignment.prune_redundant(p, "g", "n", "a", "b", "sa", "sb", 90.0)


def _supported(t) -> DataFrame:
    return _points(t).withColumn("score", F.round(F.col("x") + F.lit(0.3), 6)).withColumn("support", F.round(F.abs("y"), 6)).withColumn("tie", F.round("z", 6))


_CANDIDATES = f"""
    c AS (SELECT g, k, score, support, support + greatest(tie, 0) AS secondary, {{'k': k, 'x': x, 'y': y, 'z': z}} AS s
          FROM (SELECT label AS g, vec_id AS k, round(x + 0.3::DOUBLE, 6) AS score, round(abs(y), 6) AS support, round(z, 6) AS tie, x, y, z FROM ({_XYZ})) WHERE score > 0 AND support > 0)"""


def _near(distance: float) -> str:
    return greedy_sql.close("a", "r.s", distance)


@query(f"""
    WITH RECURSIVE p AS (SELECT label AS g, vec_id AS k, round(x + 0.3::DOUBLE, 6) AS score, greatest(round(z, 6), 0) AS tie, {{'k': vec_id, 'x': x, 'y': y, 'z': z}} AS s FROM ({_XYZ})),
    able AS (SELECT * FROM p WHERE score > 0),
    m AS (SELECT r.g, r.k, round(r.score + coalesce(sum(o.score) FILTER (o.k <> r.k), 0), 9) AS mass FROM able r JOIN (SELECT g, k, score, s AS a FROM able) o ON o.g = r.g AND {_near(0.3)} GROUP BY r.g, r.k, r.score),
    ordered AS (SELECT able.g, s, row_number() OVER (PARTITION BY able.g ORDER BY score DESC, mass DESC, tie DESC, able.k) AS o FROM able JOIN m USING (g, k)),
    {greedy_sql.greedy("ordered", _near(0.3), 6)}
    SELECT g AS label, k AS vec_id, seed FROM chosen""")
def spatial_seeds(t):
    return clusters.seeds(_supported(t), ["label"], "vec_id", "xyz", "score", 6, 0.3, tie_break="tie")


@query(f"""
    WITH RECURSIVE {_CANDIDATES}, {greedy_sql.best_cluster("c", _near(0.3), _near(0.35), _near(0.3), _near(0.35))}
    SELECT g AS label, k AS vec_id, round(worth, 6) AS worth FROM members""")
def supported_members(t):
    out = clusters.best_cluster(_supported(t), ["label"], "vec_id", "xyz", "score", "support", 4, 0.3, 0.35, tie_break="tie")
    return out.select("label", "vec_id", r6("worth"))


@query(f"""
    WITH RECURSIVE {_CANDIDATES}, {greedy_sql.best_cluster("c", _near(10), _near(12), _near(10), _near(12))}, {greedy_sql.roles("c", _near(0.3), 4, 12)}
    SELECT g AS label, k AS vec_id, role FROM roles""")
def docking_roles(t):
    return clusters.roles(_supported(t), ["label"], "vec_id", "xyz", "score", "support", 4, 12, 0.75, 0.35, 0.3, tie_break="tie")


@query(f"""
    WITH RECURSIVE e AS (SELECT user_id AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, value AS score, round(value % 7, 6) AS support FROM events),
    c AS (SELECT *, support AS secondary, {{'k': k}} AS s FROM e WHERE score > 0 AND support > 0),
    {greedy_sql.best_cluster("c", "abs(a.k - r.s.k) <= 3", "abs(a.k - r.s.k) <= 4", "abs(a.k - r.s.k) <= 3", None)}, {greedy_sql.roles("c", "abs(a.k - r.s.k) <= 3", 4, 6)}
    SELECT g AS user_id, k AS pos, role FROM roles""")
def docking_roles_line(t):
    """Without coordinates: positions of each user's events."""
    from ravelin.plans.window_queries import _events

    e = _events(t).withColumn("support", F.round(F.col("value") % 7, 6))
    return clusters.roles(e, ["user_id"], "pos", [], "value", "support", 4, 6)


_GAIN = " + ".join([f"CASE WHEN {greedy_sql.seen('type')} = 0 THEN 100 ELSE 0 END - 3 * {greedy_sql.seen('type')}", *[f"CASE WHEN {greedy_sql.seen(c)} = 0 THEN 10 ELSE 0 END" for c in ("name", "size")]])


@query(f"""
    WITH RECURSIVE d AS (SELECT p_brand AS g, {{'k': p_partkey, 'name': p_name, 'size': p_size, 'type': p_type}} AS s FROM part),
    {greedy_sql.diverse("d", _GAIN, "-abs(r.s.size - 40), -(r.s.k % 3), r.s.k", 8)}
    SELECT g AS p_brand, k AS p_partkey, pick FROM picked""")
def diverse_pick(t):
    p = t("part").withColumn("hard", F.col("p_partkey") % 3)
    return clusters.diverse_sample(p, ["p_brand"], "p_partkey", "p_size", "hard", ["p_name", "p_size"], "p_type", 8)


@query("""
    WITH s AS (SELECT l_returnflag AS g, l_suppkey % 60 AS i, sum(l_quantity)::DOUBLE AS a, count(*)::DOUBLE AS b FROM lineitem GROUP BY 1, 2),
    r AS (SELECT l_returnflag AS g, l_suppkey % 60 AS i, max((l_partkey % 100) / 100.0::DOUBLE) AS rel FROM lineitem WHERE l_returnflag <> 'A' AND l_suppkey % 7 <> 0 AND l_linenumber = 7 GROUP BY 1, 2),
    k AS (SELECT DISTINCT g FROM r)
    SELECT s.g AS mode, s.i AS position, CASE WHEN k.g IS NULL OR rel >= 0.5 THEN a ELSE 0 END AS quantity, CASE WHEN k.g IS NULL OR rel >= 0.5 THEN b ELSE 0 END AS lines, CASE WHEN k.g IS NULL THEN 'unknown' WHEN rel >= 0.5 THEN 'exposed' ELSE 'buried' END AS state
    FROM s LEFT JOIN r USING (g, i) LEFT JOIN k ON k.g = s.g""")
def surface_signals(t):
    """Two signals per mode and position, zero where the position is buried; one mode has no areas."""
    li = t("lineitem").withColumn("mode", F.col("l_returnflag")).withColumn("position", F.col("l_suppkey") % 60)
    signals = li.groupBy("mode", "position").agg(F.sum("l_quantity").cast("double").alias("quantity"), F.count(F.lit(1)).cast("double").alias("lines"))
    areas = li.where("l_returnflag <> 'A' AND l_suppkey % 7 <> 0 AND l_linenumber = 7").select("mode", "position", ((F.col("l_partkey") % 100) / 100.0).alias("relative"))
    out = scoring.surface_masked(signals, areas, ["mode"], "position", "relative", ["quantity", "lines"], 0.5)
    state = F.when(F.col("exposed").isNull(), "unknown").when(F.col("exposed"), "exposed").otherwise("buried")
    return out.select("mode", "position", "quantity", "lines", state.alias("state"))


@query()
def chain_match(t):
    """Suppliers of a nation as chains, and their counterparts: some letters changed, cut short, doubled, or another's."""
    s = t("supplier").select(F.col("s_nationkey").alias("case"), F.col("s_suppkey").alias("place"), F.concat(F.lit("c"), "s_suppkey").alias("chain"), F.upper(F.md5(F.col("s_name").cast("binary"))).alias("sequence"))
    kind = F.col("place") % 5
    other = F.when(kind == 0, F.translate("sequence", "A", "X")).when(kind == 1, F.left("sequence", F.lit(20))).when(kind == 2, F.concat("sequence", "sequence")).when(kind == 3, F.lit(None).cast("string")).otherwise(F.col("sequence"))
    renamed = F.when(F.col("place") % 2 == 0, F.concat(F.lit("d"), "place")).otherwise(F.col("chain"))
    free = s.where(F.col("case") % 6 != 0).select("case", "place", renamed.alias("chain"), other.alias("sequence"))
    out = alignment.match_chains(s, free, "case", "chain", "place", "sequence")
    return out.select("case", "chain", "best", r6("identity"), r6("coverage_bound"), r6("coverage_free"), r6("second"), "matched", "status", "reason", "fallback")
