"""Ranking and frame windows over events and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.operators import selection, windows
from ravelin.plans.registry import query, r6

_POS = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events"


def _events(t) -> DataFrame:
    return t("events").withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))


@query("""
    SELECT event_id, CASE WHEN value > 0 THEN round(cume_dist() OVER (PARTITION BY user_id, coalesce(value > 0, false) ORDER BY value), 6) ELSE 0 END AS pct
    FROM events""")
def pos_percentile(t):
    return windows.positive_percentile(t("events"), "value", ["user_id"], "pct").select("event_id", r6("pct"))


@query("""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey) AS rn,
                      max(l_extendedprice) OVER (PARTITION BY l_suppkey) AS top FROM lineitem)
    SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, CASE WHEN rn <= 40 AND l_extendedprice > 0 THEN round(l_extendedprice / top, 6) ELSE 0 END AS gated FROM r""")
def top_gate(t):
    df = windows.top_gate(t("lineitem"), "l_extendedprice", ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], 40, "gated")
    return df.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", r6("gated"))


@query("""
    SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey,
           round((rank() OVER (PARTITION BY l_partkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_partkey, l_quantity) - 1) / 2.0::DOUBLE)
                 / count(*) OVER (PARTITION BY l_partkey), 6) AS pct
    FROM lineitem""")
def avg_rank_pct(t):
    return t("lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", r6(windows.average_rank("l_quantity", ["l_partkey"]), "pct"))


@query(f"""
    WITH e AS ({_POS})
    SELECT event_id,
           round(avg(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS mean_3,
           max(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS max_5,
           round(sum(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING), 4) AS sum_10
    FROM e""")
def rolling_center(t):
    roll = lambda half, how: windows.rolling("value", ["user_id"], ["pos"], half, how)
    return _events(t).select("event_id", r6(roll(3, "mean"), "mean_3"), roll(5, "max").alias("max_5"), F.round(roll(10, "sum"), 4).alias("sum_10"))


@query("""
    WITH q AS (SELECT user_id, quantile_cont(value, 0.9) AS q90 FROM events WHERE value > 0 GROUP BY user_id)
    SELECT event_id, round(q90, 6) AS q90, coalesce(value >= q90, false) AS is_top FROM events LEFT JOIN q USING (user_id)""")
def pos_quantile_flag(t):
    df = t("events").withColumn("q90", windows.positive_quantile("value", ["user_id"], 0.9))
    return df.select("event_id", r6("q90"), F.coalesce(F.col("value") >= F.col("q90"), F.lit(False)).alias("is_top"))


@query(f"""
    WITH e AS ({_POS}), f AS (SELECT *, coalesce(value >= 90, false) AS flag FROM e),
    i AS (SELECT *, sum(CASE WHEN flag THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY pos) AS island FROM f)
    SELECT event_id, (CASE WHEN flag THEN count(*) OVER (PARTITION BY user_id, island, flag) ELSE 0 END)::BIGINT AS run FROM i""")
def run_length(t):
    return windows.run_length(_events(t), F.col("value") >= 90, ["user_id"], ["pos"], "run").select("event_id", "run")


@query(f"""
    WITH e AS ({_POS}), m AS (SELECT *, CASE WHEN event_type = 'error' THEN pos END AS flag_pos FROM e),
    n AS (SELECT *, last_value(flag_pos IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b,
                 first_value(flag_pos IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM m)
    SELECT event_id, coalesce(least(pos - b, a - pos), -1) AS distance FROM n""")
def nearest_flag(t):
    return _events(t).select("event_id", F.coalesce(windows.nearest_flag("pos", F.col("event_type") == "error", ["user_id"]), F.lit(-1)).alias("distance"))


@query("""
    SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value NULLS LAST, event_id) AS place,
           count(*) OVER (PARTITION BY event_type) AS group_length FROM events""")
def group_order(t):
    return windows.group_order(t("events"), ["event_type"], ["value", "event_id"], "place", "group_length").select("event_id", "place", "group_length")


@query(f"""
    WITH e AS ({_POS}),
    s AS (SELECT user_id, pos AS seed FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, pos) AS rn FROM e) WHERE rn <= 2)
    SELECT e.event_id, round(coalesce(sum((5.0::DOUBLE - abs(e.pos - s.seed)) / 5.0), 0), 6) AS signal
    FROM e LEFT JOIN s ON e.user_id = s.user_id AND abs(e.pos - s.seed) <= 4 GROUP BY e.event_id""")
def seed_kernel(t):
    e = _events(t)
    seeds = selection.first_rows(e, ["user_id"], [F.col("value").desc_nulls_last(), F.col("pos")], 2)
    return windows.seed_kernel(e, ["user_id"], "pos", seeds, 4, "signal").select("event_id", r6("signal"))


@query(f"""
    WITH e AS ({_POS}), f AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y FROM e)
    SELECT event_id, max(y) OVER w AS near_error, sum(y) OVER w::BIGINT AS errors
    FROM f WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def soft_label(t):
    y = F.when(F.col("event_type") == "error", 1).otherwise(0)
    return _events(t).select("event_id", windows.rolling(y, ["user_id"], ["pos"], 3, "max").alias("near_error"), windows.rolling(y, ["user_id"], ["pos"], 3, "sum").alias("errors"))


@query(f"""
    WITH e AS ({_POS})
    SELECT event_id, round(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w * max(value) OVER w, 6) AS crossed
    FROM e WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)""")
def anchor_cross(t):
    y = F.when(F.col("event_type") == "error", 1).otherwise(0)
    roll = lambda c, how: windows.rolling(c, ["user_id"], ["pos"], 5, how)
    return _events(t).select("event_id", r6(roll(y, "sum") * roll("value", "max"), "crossed"))


@query(f"""
    WITH e AS ({_POS})
    SELECT event_id, round(sum(CASE WHEN event_type <> 'signup' THEN value ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 4) AS support FROM e""")
def window_support(t):
    kept = F.when(F.col("event_type") != "signup", F.col("value")).otherwise(F.lit(0.0))
    return _events(t).select("event_id", F.round(windows.rolling(kept, ["user_id"], ["pos"], 4, "sum"), 4).alias("support"))
