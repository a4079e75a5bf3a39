"""Sections of sheets, files by role, manifests in columns' metadata."""

import pytest
from pyspark.sql import functions as F
from ravelin.operators import ml
from ravelin.sources import archives

SCHEMA = "path string, row long, cells array<string>"


def test_sections_carry_forward_within_a_sheet(spark):
    rows = [
        ("a", 1, ["1AAA_A:B", "x"]), ("a", 2, [" Easy "]), ("a", 3, ["1BBB_A:B", "x"]), ("a", 4, []), ("a", 5, ["note"]), ("a", 6, ["1CCC_A:B", None]), ("a", 7, ["Hard", "y"]), ("a", 8, ["1DDD_A:B", "x"]),
        ("b", 9, ["1EEE_A:B", "x"]), ("b", 10, [None, "x"]), ("b", 11, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = archives.sectioned(df, {"Easy": "easy", "Hard": "hard"}, "^[A-Z0-9]{4}_.+:.+", 2).orderBy("row").collect()
    assert [(r.path, r.row, r.section) for r in got] == [("a", 1, None), ("a", 3, "easy"), ("a", 6, "easy"), ("a", 8, "hard"), ("b", 9, None)]
    with pytest.raises(Exception, match="too few cells in row 3 of a"):
        archives.sectioned(df, {"Easy": "easy"}, "^1", 3).where("row = 3").collect()
    assert archives.sectioned(df.limit(0), {"Easy": "easy"}, "^1", 3).count() == 0
    assert {r.section for r in archives.sectioned(df, {}, "^1", 1).collect()} == {None}


def test_files_by_role(spark, tmp_path):
    for name in ("1A_own.pdb", "1A_all.pdb", "2B_all.pdb", "3C_own.pdb", "3C_x_own.pdb", "3C_all.pdb", "._4D_own.pdb", "5E_own.pdb.bak"):
        (tmp_path / name).write_text("x")
    wanted = spark.createDataFrame([("1A",), ("1A",), ("2B",), ("3C",), ("4D",), ("5E",), (None,)], "id string")
    got = {r.id: (r.status, r.role, r.path and r.path.rsplit("/", 1)[1]) for r in archives.role_files(spark, str(tmp_path), wanted, {"own": r"([^_]+)_(?:x_)?own\.pdb", "all": r"([^_]+)_all\.pdb"}).collect()}
    assert got == {"1A": ("found", "own", "1A_own.pdb"), "2B": ("found", "all", "2B_all.pdb"), "3C": ("ambiguous", "own", None), "4D": ("missing", None, None), "5E": ("missing", None, None)}


def test_a_manifest_is_kept_and_extended(spark, tmp_path):
    rules = [ml.Rule("s_", "score", "a"), ml.Rule("s_old_", "score", "b", "baseline_only"), ml.Rule("target_", "score", "c")]
    df = ml.annotate(spark.range(2).select(F.col("id").alias("s_x"), F.col("id").alias("s_old_y"), F.col("id").alias("target_z"), F.col("id").alias("odd.name")), rules)
    want = [("s_x", "score", "a", "feature_safe"), ("s_old_y", "score", "b", "baseline_only"), ("target_z", "score", "c", "leakage_guard"), ("odd.name", "derived", "input", "review_before_use")]
    assert ml.manifest_of(df) == want
    df.write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert ml.manifest_of(back) == want
    more = ml.annotate(back.drop("s_old_y").withColumn("n", F.lit(1)), [ml.Rule("", "other", "z"), ml.Rule("s_", "none", "none")], "second")
    assert ml.manifest_of(more) == [want[0], *want[2:], ("n", "other", "z", "feature_safe")]
    assert more.count() == 2 and ml.manifest_of(spark.range(1)) == []
