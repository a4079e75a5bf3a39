"""Line order over files and splits, archives beyond 2 GB, and lines that real files hold besides."""

import zipfile

import pytest
from pyspark.sql import functions as F
from ravelin.operators import aggregates, joins
from ravelin.sources import text, zip_source


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_order_is_that_of_reading_files_one_after_another(spark, tmp_path, small_splits):
    """A small file named first, a large one of many splits, one of short lines: sizes must not decide."""
    hit = lambda q, s, n: "\t".join([q, s, "90", "10", "0", "0", "1", "10", "1", "10", "1e-5", str(n)])
    files = {"a.tsv": [hit("q1", "first", 1)], "b.tsv": [hit(f"q{i % 7}", f"b{i}", i) for i in range(9000)], "c.tsv": [hit("q9", "c", 0), hit("q1", "late", 5)]}
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    rows = text.hits(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() > 10
    ordered = [r.subject for r in rows.orderBy("n").collect()]
    assert ordered == [line.split("\t")[1] for lines in files.values() for line in lines]
    first = {r["query"]: r.subject for r in aggregates.first_writer(rows, ["query"], ["n"], ["subject"]).collect()}
    assert first == {"q1": "first", "q0": "b0", "q2": "b2", "q3": "b3", "q4": "b4", "q5": "b5", "q6": "b6", "q9": "c"}
    (tmp_path / "fasta").mkdir()
    (tmp_path / "fasta/1.fasta").write_text(">X one\nAA\n")
    (tmp_path / "fasta/2.fasta").write_text("".join(f">{'X' if i % 500 == 0 else f'Y{i}'} two\n{'ACGT' * 30}\n" for i in range(2000)))
    found = text.wanted_records(text.fasta(spark, str(tmp_path / "fasta")), spark.createDataFrame([("X",), ("Y1501",)], "id string"))
    assert {r.id: r.sequence for r in found.collect()} == {"X": "AA", "Y1501": "ACGT" * 30}


def test_members_are_partitions_and_stream(spark, tmp_path):
    """A member of over 2 GB, which no cell could hold, beside small, empty and unwanted ones."""
    line = ("x" * 990 + "\ty\tz\n").encode()
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        with z.open("big.txt", "w", force_zip64=True) as out:
            block, count = line * 2200, 1000
            for _ in range(count):
                out.write(block)
        z.writestr("empty.txt", "")
        z.writestr("note.md", "a\tb\tc\n")
        z.writestr("readme.txt", "a\tb\tc\n")
        z.writestr("small.txt", "h\nä\tb\tc\r\n#a\tb\tc\nshort\n")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("one.txt", b"h\n\xff\tb\tc")
    assert zipfile.ZipFile(tmp_path / "a.zip").getinfo("big.txt").file_size == len(line) * 2_200_000 > 1 << 31
    lines = zip_source.zip_lines(spark, str(tmp_path / "*.zip"), ".txt", ["ReadMe"])
    assert lines.rdd.getNumPartitions() == 4
    got = {r.member: (r.n, r.low, r.high) for r in lines.groupBy("member").agg(F.count("*").alias("n"), F.min("line").alias("low"), F.max("line").alias("high")).collect()}
    assert got == {"big.txt": (2_200_000, 0, 2_199_999), "small.txt": (4, 0, 3), "one.txt": (2, 0, 1)}
    rows = text.zipped_rows(spark, str(tmp_path / "*.zip"), ["readme", "big"], 3, header_lines=1).orderBy("n").collect()
    assert [(r.member, r.columns) for r in rows] == [("small.txt", ["ä", "b", "c"]), ("one.txt", ["\ufffd", "b", "c"])]
    assert {r.member for r in zip_source.zip_lines(spark, str(tmp_path / "b.zip"), first_only=True).collect()} == {"one.txt"}
    assert zip_source.zip_lines(spark, str(tmp_path / "b.zip"), ".csv").count() == 0
    with pytest.raises(FileNotFoundError):
        zip_source.zip_lines(spark, str(tmp_path / "none*.zip"))


def test_strangers_among_atoms(spark, tmp_path):
    line = "{:<6}{:>5} {:<4} {:>3} A{:>4}    {:8.3f}{:8.3f}{:8.3f}  1.00 20.00          {:>2}"
    atoms = [("HETATM", 1, " O", "HOH", 1, 0, 0, 0, "O"), ("ATOM", 2, " CA", "ALA", 2, 1, 1, 1, "C"), ("ATOM", 3, " CA", "ALA", 2, 9, 9, 9, "C"), ("HETATM", 4, "ZN", "ZN", 3, 0, 0, 0, "ZN"), ("HETATM", 5, " CA", "MSE", 4, 2, 2, 2, "C"), ("ATOM", 6, " CA", "gly", 5, 3, 3, 3, "C")]
    (tmp_path / "a.pdb").write_text("\n".join(line.format(*a) for a in atoms))
    rows = text.residues(text.atoms(spark, str(tmp_path / "a.pdb"))).orderBy("idx").collect()
    assert [(r.idx, r.name, r.x) for r in rows] == [(1, "ALA", 1.0), (2, "MSE", 2.0), (3, "GLY", 3.0)]


def test_repeated_keys_are_told_and_multiply_nothing(spark):
    left = spark.createDataFrame([(1, 1.0), (2, 2.0), (2, 2.0), (3, 3.0), (None, 5.0), (6, None)], "k int, v double")
    right = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 2.0), (4, 4.0), (None, 5.0), (6, None), (7, 1.0), (7, 1.0)], "k int, v double")
    rows = {r.k: (r.left_value, r.right_value, r.status) for r in joins.audit(left, right, ["k"], "v").collect()}
    assert rows == {1: (1.0, None, "duplicate"), 2: (None, 2.0, "duplicate"), 3: (3.0, None, "missing_right"), 4: (None, 4.0, "extra_right"), None: (5.0, 5.0, "matched"), 6: (None, None, "matched"), 7: (None, None, "duplicate")}


def test_wanted_ids_by_either_form_and_a_filter_before_the_shuffle(spark, tmp_path):
    lines = [">sp|P12345|A_HUMAN x", "AA", ">Q99999", "CC", ">tr|Q99999|B", "GG", ">other", "TT", ">P12345-2", "AC"]
    (tmp_path / "a.fasta").write_text("\n".join(lines))
    records = text.fasta(spark, str(tmp_path / "a.fasta"))
    wanted = spark.createDataFrame([("P12345",), ("tr|Q99999|B",), ("Q99999",), ("other",), ("absent",), (None,)], "id string")
    assert {r.id: r.sequence for r in text.wanted_records(records, wanted).collect()} == {"P12345": "AA", "tr|Q99999|B": "GG", "Q99999": "CC", "other": "TT"}
    plan = text.wanted_records(records, wanted)._jdf.queryExecution().optimizedPlan().toString()
    assert "bitmap_construct_agg" in plan.lower() or "bitmapconstructagg" in plan.lower()


def test_filter_loses_nothing_and_sifts(spark):
    wanted = spark.range(0, 5000, 1).select(F.concat(F.lit("k"), F.col("id") * 7).alias("w"))
    rows = spark.range(0, 70_000).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("_bucket_"))
    passed = {r.k for r in joins.may_be_in(rows, F.col("k"), wanted, "w").collect()}
    hits = {f"k{i * 7}" for i in range(5000)}
    assert hits <= passed and len(passed - hits) < 65_000 / 10
    assert joins.may_be_in(rows, F.col("k"), wanted.limit(0), "w").count() == 0


def test_one_chain_of_a_structure(spark):
    from ravelin.sources import sinks

    line = "ATOM  %5d  CA  ALA %s%4d       1.000   2.000   3.000  1.00 10.00           C"
    lines = spark.createDataFrame([(line % (i, "AB"[i % 2], i),) for i in range(6)] + [("TER",), ("REMARK            A",)], "line string")
    assert sorted(r.line[22:26] for r in sinks.only_chain(lines, "line", "A").collect()) == ["   0", "   2", "   4"]
