"""What findings of round 3 asked for: results that hold with more rows and more tasks, and plans that grow with the input."""

import duckdb
import pytest
from pyspark.sql import functions as F
from ravelin.operators import clusters, evidence, spatial
from ravelin.plans import catalogue, graph_queries, source_queries, staging

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def tables(spark, **given):
    return lambda name: given[name] if name in given else spark.read.parquet(f"{SF}/{name}.parquet")


def test_hits_on_one_position_do_not_multiply_each_other(spark):
    contacts = spark.createDataFrame([("e", "A", 1, "B", 2), ("e", "A", 1, "C", 3)], "entry string, chain_a string, pos_a int, chain_b string, pos_b int")
    many = spark.range(100_000).select(F.lit("e").alias("entry"), F.element_at(F.array(F.lit("A"), F.lit("B")), (F.col("id") % 2 + 1).cast("int")).alias("chain"), (F.col("id") % 2 + 1).cast("int").alias("pos"), (F.floor(F.col("id") / 2) % 20).cast("int").alias("at"), (F.col("id") % 7).cast("double").alias("evalue"), F.lit(1.0).alias("bits"))
    worse = spark.createDataFrame([("e", "C", 3, 77, 9.0, 1.0)], many.schema)
    got = evidence.transfer_contacts(contacts, many.union(worse), many.union(worse)).collect()
    assert sorted((r.entry, r.i, r.j) for r in got) == [("e", i, j) for i in range(20) for j in range(20)]


def test_every_archive_has_its_own_headers(spark):
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = sorted(tuple(r) for r in catalogue.QUERIES["zip_experimental"](spark, SF).select("p1", "p2", "support", "method_ids").collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    assert got == sorted(con.execute(f"SELECT p1, p2, support, method_ids FROM ({catalogue.ORACLE_SQL['zip_experimental']})").fetchall())


def test_a_record_that_nobody_asks_for_hides_no_other(spark):
    rows = [(1, "Customer#1", 1, 100.0, "BUILDING"), (100001, "Customer#100001", 1, 6000.0, "BUILDING"), (200001, "Customer#200001", 1, 7000.0, "MACHINERY"), (2, "Customer#2", 1, 6000.0, "BUILDING"), (4, "Customer#4", 1, 10.0, "BUILDING")]
    customer = spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    con = duckdb.connect()
    con.register("customer", customer.toPandas())
    want = sorted(con.execute(catalogue.ORACLE_SQL["fasta_wanted"]).fetchall())
    assert len(want) == 2 and sorted(tuple(r) for r in source_queries.fasta_wanted(tables(spark, customer=customer)).collect()) == want


def test_pairs_of_parts_are_dealt_to_tasks_by_the_lines(spark, monkeypatch):
    monkeypatch.setattr(staging, "ROWS_A_TASK", 1000)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert graph_queries._pairs(tables(spark)).rdd.getNumPartitions() == -(-lines // 1000) > staging.shuffle_width(spark)


def test_strict_hits_carry_no_file_names(spark):
    assert "file_path" not in plan(catalogue.QUERIES["hit_scan_strict"](spark, SF))


def test_archives_are_read_once(spark):
    assert "zip_lines" not in plan(catalogue.QUERIES["zip_molecular"](spark, SF))


def test_coupling_lines_are_split_once(spark):
    assert plan(catalogue.QUERIES["coupled_scan"](spark, SF)).count("split(") == 1


def test_single_records_lie_in_one_folder(spark):
    s = spark.createDataFrame([("1", ">a\nAC"), ("2", ">b\nGT")], "file string, content string")
    path = source_queries._flat_files(s, "flat")
    files = spark.read.text(path, wholetext=True).select("value", "_metadata.file_name").collect()
    assert sorted((r.file_name, r.value) for r in files) == [("1", ">a\nAC"), ("2", ">b\nGT")]


def test_a_pair_is_found_from_one_of_its_cells(spark):
    points = spark.createDataFrame([(k, (k * 37 % 100) / 50, (k * 61 % 100) / 50, (k * 83 % 100) / 50, k % 3) for k in range(300)], "k long, x double, y double, z double, g int")
    rows = points.collect()
    close = lambda a, b: (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 0.25
    want = {(a.k, b.k, a.g, b.g) for a in rows for b in rows if a.k < b.k and close(a, b)}
    pairs = spatial.radius_pairs(points, "k", "xyz", 0.5, carry="g")
    assert len(want) == pairs.count() and {(r.a, r.b, r.va, r.vb) for r in pairs.collect()} == want
    # Half of the 27 cells, the own one included.
    assert plan(pairs).count("struct(") >= 1 and "_other" in plan(pairs)
    counted = {r.g: (r.contacts_0_5, r.points_0_5) for r in spatial.contact_counts(pairs, ["g"], [0.5], points, "k").collect()}
    assert counted == {g: (sum(x[2] == g for x in want), len({x[0] for x in want if x[2] == g})) for g in range(3)}


@pytest.mark.parametrize("distance", [0.5, 10.0])
def test_mass_of_groups_within_reach_and_beyond(spark, distance):
    points = spark.createDataFrame([(k, (k * 37 % 100) / 50, (k * 61 % 100) / 50, 0.0, k % 3, float(k % 11)) for k in range(200)], "k long, x double, y double, z double, g int, v double")
    rows = points.collect()
    want = {a.k: sum(b.v for b in rows if b.g == a.g and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= distance**2) for a in rows}
    out = clusters._mass(points, ["g"], "k", "xyz", "v", distance, 0, "m")
    assert {r.k: r.m for r in out.collect()} == pytest.approx(want)


def test_points_of_one_place_probe_as_one(spark, monkeypatch):
    monkeypatch.setattr(spatial, "ROWS_A_BLOCK", 50, raising=False)
    at = lambda k, p: (k, p * 37 % 100 / 50, p * 61 % 100 / 50, p * 83 % 100 / 50, k % 3)
    # Places of one, of ten and of more points than are compared as one, and a key that occurs twice.
    rows = [*[at(k, k % 30) for k in range(300)], *[at(1000 + k, 7) for k in range(150)], *[at(2000 + k, 30 + k) for k in range(40)], at(5, 8), (9000, None, 0.0, 0.0, 0), (9001, float("nan"), 0.0, 0.0, 0)]
    points = spark.createDataFrame(rows, "k long, x double, y double, z double, g int")
    sound = [r for r in rows if r[0] < 9000]
    want = sorted((a[0], b[0], a[4], b[4]) for a in sound for b in sound if a[0] < b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 0.25)
    assert sorted((r.a, r.b, r.va, r.vb) for r in spatial.radius_pairs(points, "k", "xyz", 0.5, carry="g").collect()) == want


def test_pairs_of_copies_follow_each_other(spark, tmp_path):
    """Of places with eight points each the distances are written in runs, which compress without a dictionary of them."""
    copies = spark.range(0, 1600, 1, 4).select(F.col("id").alias("k"), *[(F.pmod(F.xxhash64(F.col("id") % 200, F.lit(i)), F.lit(1_000_000)) / 1e6).alias(x) for i, x in enumerate("xyz")])
    spatial.radius_pairs(copies, "k", "xyz", 2.0).write.option("parquet.enable.dictionary", "false").parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 1600 * 1599 // 2
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").iterdir()) / (1600 * 1599 // 2) < 4.3
