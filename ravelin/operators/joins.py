"""Graph, look-up, audit and set joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.plans.staging import running_before


def orientations(pairs: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Pairs joined with hits of both queries in both directions, as a bag.

    A pair (a, b) matches left a and right b, and left b and right a; a pair of
    equal ends therefore appears twice. `left` and `right` hold `key` and other
    columns under different names.
    """
    def one(x: str, y: str) -> DataFrame:
        return pairs.join(left.withColumnRenamed(key, "_l"), F.col(x) == F.col("_l")).join(right.withColumnRenamed(key, "_r"), F.col(y) == F.col("_r"))

    return one(a, b).unionByName(one(b, a))


def neighbours(edges: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """(node, partner, weight, rank) of undirected edges, partners ranked by weight, then name.

    Ranks are counted by ranges of (node, weight, partner), so a node of very
    many edges spans many tasks. Edges with a null end are left out.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("partner"), weight).unionByName(edges.where(F.col(a) != F.col(b)).select(F.col(b).alias("node"), F.col(a).alias("partner"), weight))
    ordered = both.where("node IS NOT NULL AND partner IS NOT NULL").withColumn("_none", F.col(weight).isNull()).withColumn("_down", -F.col(weight))
    ranked = running_before(ordered, ["node"], ["_none", "_down", "partner"], F.lit(1), "rank", "neighbours")
    return ranked.select("node", "partner", weight, (F.col("rank") + 1).cast("long").alias("rank"))


def require_complete(df: DataFrame, reference: DataFrame, on: Sequence[str]) -> DataFrame:
    """`df` joined with `reference`; a row without a match stops the job with its key."""
    found = reference.withColumn("_here", F.lit(True))
    key = F.concat_ws(",", *[F.col(c).cast("string") for c in on])
    checked = F.when(F.col("_here").isNull(), F.raise_error(F.concat(F.lit("no match for "), key)).cast("boolean")).otherwise(F.col("_here"))
    return df.join(found, list(on), "left").withColumn("_here", checked).where("_here").drop("_here")


#: Bits of the filter per wanted key, and most bits: 32 MB are broadcast at most.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 28
_BITMAP = 8 * 4096


def may_be_in(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The rows of `df` whose key passes a Bloom filter of one hash over `wanted`, told before any shuffle.

    No row whose key is wanted is lost; of the others one in FILTER_BITS stays,
    or more where the wanted keys are so many that the filter is full, so an
    exact join belongs behind it. The filter is a broadcast table of bitmaps,
    and rows meet theirs by an equi join. Null keys do not pass.
    """
    n = wanted.count()
    bits = min(MOST_FILTER_BITS, _BITMAP * max(1, -(-n * FILTER_BITS // _BITMAP)))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    maps = wanted.where(F.col(wanted_key).isNotNull()).select(place(F.col(wanted_key)).alias("p"))
    maps = maps.groupBy(F.bitmap_bucket_number("p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_map"))
    marked = df.withColumn("_place", F.when(key.isNotNull(), place(key))).withColumn("_bucket", F.bitmap_bucket_number("_place")).withColumn("_bit", F.bitmap_bit_position("_place"))
    byte = F.conv(F.hex(F.expr("substring(_map, cast(_bit div 8 AS int) + 1, 1)")), 16, 10).cast("int")
    passed = marked.join(F.broadcast(maps), "_bucket").where(F.lit(1) == F.floor(byte / F.pow(F.lit(2), F.col("_bit") % 8)).cast("int") % 2)
    return passed.select(*[F.col(f"`{c}`") for c in df.columns])


def audit(left: DataFrame, right: DataFrame, on: Sequence[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """One row per key of either side: both values and matched, missing_right, extra_right, mismatch or duplicate.

    A key that occurs more than once on a side is a duplicate, and its value
    there is null. Sides are counted before they are joined, so no repeated key
    multiplies rows. Null keys are compared like any other.
    """
    one = lambda df, side: df.groupBy(*on).agg(F.when(F.count(F.lit(1)) == 1, F.first(value)).alias(f"{side}_value"), F.count(F.lit(1)).alias(f"_{side}")).select(*[F.col(c).alias(f"_{side}_{c}") for c in on], f"{side}_value", f"_{side}")
    equal = reduce(lambda a, b: a & b, [F.col(f"_left_{c}").eqNullSafe(F.col(f"_right_{c}")) for c in on])
    rows = one(left, "left").join(one(right, "right"), equal, "full_outer")
    same = F.coalesce(F.abs(F.col("left_value") - F.col("right_value")) <= tolerance, F.col("left_value").isNull() & F.col("right_value").isNull())
    many = (F.coalesce("_left", F.lit(0)) > 1) | (F.coalesce("_right", F.lit(0)) > 1)
    status = F.when(many, "duplicate").when(F.col("_right").isNull(), "missing_right").when(F.col("_left").isNull(), "extra_right").when(same, "matched").otherwise("mismatch")
    return rows.select(*[F.coalesce(f"_left_{c}", f"_right_{c}").alias(c) for c in on], "left_value", "right_value", status.alias("status"))


def cascade(df: DataFrame, lookups: Sequence[tuple[DataFrame, Sequence[str], str]], out: str) -> DataFrame:
    """First look-up that knows a row's key decides; a key with several values is ambiguous.

    Each look-up is (table, key columns, value column). Adds `out` and
    `status`: the number of the look-up, ambiguous or not_found.
    """
    value, status = F.lit(None), F.lit("not_found")
    for n, (table, keys, column) in reversed(list(enumerate(lookups, 1))):
        known = table.groupBy(*keys).agg(F.min(column).alias(f"_v{n}"), F.count_distinct(column).alias(f"_n{n}"))
        df = df.join(known, list(keys), "left")
        hit = F.coalesce(F.col(f"_n{n}"), F.lit(0))
        value = F.when(hit == 1, F.col(f"_v{n}")).when(hit > 1, F.lit(None)).otherwise(value)
        status = F.when(hit == 1, F.lit(str(n))).when(hit > 1, F.lit("ambiguous")).otherwise(status)
    names = [f"_{k}{n}" for n in range(1, len(lookups) + 1) for k in "vn"]
    return df.withColumn(out, value).withColumn("status", status).drop(*names)


def first_reason(reasons: Sequence[tuple[str, Column]], kept: str = "kept") -> Column:
    """Name of the first condition that holds, in order; else `kept`."""
    out = F
    for name, test in reasons:
        out = out.when(F.coalesce(test, F.lit(False)), F.lit(name))
    return out.otherwise(F.lit(kept))


def unpivot_positive(df: DataFrame, keep: Sequence[str], channels: Sequence[str], default: str) -> DataFrame:
    """A row (channel, score) for every positive channel; one default row if there is none."""
    pairs = F.filter(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("score")) for c in channels]), lambda p: p["score"] > 0)
    rows = F.when(F.size(pairs) > 0, pairs).otherwise(F.array(F.struct(F.lit(default).alias("channel"), F.lit(None).cast("double").alias("score"))))
    return df.select(*keep, F.explode(rows).alias("_p")).select(*keep, "_p.*")
