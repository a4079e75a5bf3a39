"""Matrices in NumPy's format: round trips, ranges of rows, NumPy's own reading, and jobs that fail."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from ravelin.sources import npy_source


def matrix(spark, n, m=5):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, m))
    return x, spark.createDataFrame([(i, row.tolist(), "x") for i, row in enumerate(x)], "row long, values array<double>, file string")


@pytest.mark.parametrize("n", [1, 7, 3000])
def test_round_trip_and_ranges(spark, tmp_path, monkeypatch, n):
    x, df = matrix(spark, n)
    folder = str(tmp_path / "m")
    npy_source.write_matrix(df.orderBy(F.rand(1)), folder)
    got = np.array([r["values"] for r in npy_source.read_matrix(spark, folder).orderBy("row").collect()])
    assert (got == x).all()
    index = json.loads((tmp_path / "m" / npy_source.INDEX).read_text())
    assert (index["rows"], index["columns"]) == (n, 5)
    assert (np.concatenate([np.load(tmp_path / "m" / f[0]) for f in index["files"]]) == x).all()  # NumPy reads the files
    some = npy_source.read_matrix(spark, folder, n // 3, n // 2).orderBy("row").collect()
    assert [r.row for r in some] == list(range(n // 3, n // 2 + 1)) and (np.array([r["values"] for r in some]) == x[n // 3 : n // 2 + 1]).all()


def test_failures_leave_no_matrix(spark, tmp_path):
    _, df = matrix(spark, 40)
    bad = {"gap": df.where("row <> 17"), "twice": df.union(df.where("row = 3")), "uneven": df.withColumn("values", F.expr("IF(row = 9, slice(values, 1, 2), values)")), "null": df.withColumn("values", F.expr("IF(row = 9, null, values)"))}
    for name, rows in bad.items():
        with pytest.raises(Exception, match="matrix"):
            npy_source.write_matrix(rows, str(tmp_path / name))
        assert not (tmp_path / name / npy_source.INDEX).exists()
        with pytest.raises(Exception, match=r"(?i)no such file|does not exist|failed to open"):
            npy_source.read_matrix(spark, str(tmp_path / name)).collect()
    npy_source.write_matrix(df.limit(0), str(tmp_path / "none"))
    assert npy_source.read_matrix(spark, str(tmp_path / "none")).count() == 0


def test_only_what_the_index_names_is_read(spark, tmp_path):
    """As after a task that ran twice: its other attempt's file lies there too."""
    x, df = matrix(spark, 20)
    npy_source.write_matrix(df, str(tmp_path / "m"))
    np.save(tmp_path / "m" / "rows-000000000000-99-deadbeef.npy", np.zeros((20, 5)))
    got = np.array([r["values"] for r in npy_source.read_matrix(spark, str(tmp_path / "m")).orderBy("row").collect()])
    assert (got == x).all()
