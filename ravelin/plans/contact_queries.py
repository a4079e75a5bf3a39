"""Nearest partners, smallest distances and contacts of two tables' points, nation by nation.

A customer's points are the orders, a supplier's the lines; a nation is a case.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ravelin.operators import contacts
from ravelin.plans.registry import query, r6

_SIDES = """
    l AS (SELECT c_nationkey AS g, 'c' || c_custkey AS label, c_custkey AS place, o_totalprice / 1000.0::DOUBLE AS x, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) / 10.0::DOUBLE AS y, (o_orderkey % 1000) / 10.0::DOUBLE AS z
          FROM orders JOIN customer ON o_custkey = c_custkey),
    r AS (SELECT s_nationkey AS g, 's' || s_suppkey AS label, s_suppkey AS place, l_extendedprice / 1000.0::DOUBLE + {shift} AS x, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) / 10.0::DOUBLE AS y, (l_orderkey % 1000) / 10.0::DOUBLE AS z
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R'),
    d AS (SELECT l.g, l.label AS a, l.place AS ap, r.label AS b, r.place AS bp, min((l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) + (l.z - r.z) * (l.z - r.z)) AS d2 FROM l JOIN r USING (g) GROUP BY ALL)"""
_FAR = "CASE WHEN s_nationkey % 2 = 0 THEN 3000.0::DOUBLE ELSE 0 END"


def _sides(t, shift=None):
    days = lambda c: F.date_diff(F.col(c).cast("date"), F.lit("1992-01-01").cast("date")) / 10.0
    last = lambda c: (F.col(c) % 1000) / 10.0
    left = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("g"), F.concat(F.lit("c"), "c_custkey").alias("label"), F.col("c_custkey").alias("place"), (F.col("o_totalprice") / 1000.0).alias("x"), days("o_orderdate").alias("y"), last("o_orderkey").alias("z"))
    away = F.lit(0.0) if shift is None else shift
    right = t("lineitem").where("l_returnflag = 'R'").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("g"), F.concat(F.lit("s"), "s_suppkey").alias("label"), F.col("s_suppkey").alias("place"), (F.col("l_extendedprice") / 1000.0 + away).alias("x"), days("l_shipdate").alias("y"), last("l_orderkey").alias("z"))
    return left, right, "g", "label", "place"


@query(f"""
    WITH {_SIDES.format(shift="0")},
    both_ways AS (SELECT g, 0 AS side, a AS label, b AS partner, bp AS place, d2 FROM d UNION ALL SELECT g, 1, b, a, ap, d2 FROM d),
    best AS (SELECT * FROM both_ways QUALIFY row_number() OVER (PARTITION BY g, side, label ORDER BY d2, place) = 1),
    every AS (SELECT DISTINCT g, 0 AS side, label FROM l UNION ALL SELECT DISTINCT g, 1, label FROM r)
    SELECT g AS nation, side, label, round(sqrt(d2), 6) AS distance, partner, coalesce(sqrt(d2) <= 5, false) AS interface FROM every LEFT JOIN best USING (g, side, label)""")
def nearest_partner(t):
    """Each customer's nearest supplier of the nation, and each supplier's nearest customer."""
    out = contacts.nearest_partners(*_sides(t), cutoff=5.0)
    return out.select(F.col("case").alias("nation"), "side", "label", r6("distance"), "partner", "interface")


@query(f"""
    WITH {_SIDES.format(shift=_FAR)}
    SELECT g AS nation, round(sqrt(min(d2)), 6) AS distance FROM d GROUP BY g""")
def smallest_distance(t):
    """The smallest distance per nation; in every second one the sides are far beyond any cutoff."""
    out = contacts.smallest_distance(*_sides(t, F.when(F.col("s_nationkey") % 2 == 0, 3000.0).otherwise(0.0)))
    return out.select(F.col("case").alias("nation"), r6("distance"))


_WITHIN = ", ".join(f"count(*) FILTER (d2 <= {c} * {c}) AS contacts_{c}, count(DISTINCT a) FILTER (d2 <= {c} * {c}) AS left_{c}, count(DISTINCT b) FILTER (d2 <= {c} * {c}) AS right_{c}" for c in (2, 4, 8))


@query(f"""
    WITH {_SIDES.format(shift=_FAR)},
    p AS (SELECT l.g, l.label AS a, r.label AS b, (l.x - r.x) * (l.x - r.x) + (l.y - r.y) * (l.y - r.y) + (l.z - r.z) * (l.z - r.z) AS d2 FROM l JOIN r USING (g)),
    c AS (SELECT g, round(sqrt(min(d2)), 6) AS distance, {_WITHIN} FROM (SELECT g FROM l UNION SELECT g FROM r) LEFT JOIN p USING (g) GROUP BY g)
    SELECT g AS nation, * EXCLUDE (g), contacts_2 >= 3 AS contacting FROM c""")
def side_contacts(t):
    """Contacts of either side within three cutoffs, and nations that have at least three within the first."""
    out = contacts.contact_stats(*_sides(t, F.when(F.col("s_nationkey") % 2 == 0, 3000.0).otherwise(0.0)), cutoffs=[2.0, 4.0, 8.0], least=3)
    return out.withColumnRenamed("case", "nation").withColumn("distance", r6("distance"))
