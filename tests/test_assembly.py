"""From files to ranks: damaged pairs among good ones, resuming, runs that died, and votes of rectangles."""

import itertools
import random

import pytest
from pyspark.sql import functions as F
from ravelin.operators import evidence
from ravelin.plans import assembly

ALA = "ATOM  {n:5d}  CA  ALA A{n:4d}    {n:8.3f}   0.000   0.000  1.00 10.00           C\n"


@pytest.fixture
def sources(tmp_path):
    def write(name, *lines):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("".join(x if x.endswith("\n") else x + "\n" for x in lines))
        return str(tmp_path / name)

    hit = lambda q, s, a, b: "\t".join(map(str, (q, s, 90.0, 3, 0, 0, a, b, 1, 3, 0.001, 50.0)))
    for protein in ("A", "B"):
        write(f"pdb/{protein}.pdb", *[ALA.format(n=i) for i in range(1, 6)])
    write("pdb/E.pdb", *[ALA.format(n=i) for i in range(1, 4)])
    return assembly.Sources(
        pairs=write("pairs.tsv", "accA\taccB", "A\tB", "A\tB", "A\tC", "A\tD", "A\tE", "B\tX", "B\tF", "D\tF"),
        sequences=write("all.fa", ">A first", "AAAAA", ">B", "AAA", "AA", ">C", "AA-AA", ">D", "AAAA", ">E", "AAAA", ">F", "AAAAAA"),
        hits=write("hits.tsv", hit("A", "s", 2, 4), hit("B", "t", 1, 2), hit("D", "s", 3, 9), "broken line"),
        interactions=write("met.tsv", "accA\taccB", "t\ts", "s\tt", "t\tt"),
        conservation=write("prof.tsv", "protein\tposition\tvalue", *[f"A\t{i}\t{i / 10}" for i in range(1, 6)], *[f"B\t{i}\t0.5" for i in range(1, 6)], "F\t1\t0.5"),
        coupling=write("di.tsv", "accA\taccB\ti\tj\tscore", "A\tB\t3\t2\t0.9", "A\tB\t1\t1\t0.4"),
        structures=str(tmp_path / "pdb"),
    )


WANT = {
    "A|B": ("scored", None),
    "A|C": ("quarantined", "sequence with gaps"),
    "A|D": ("quarantined", "hit outside the sequence"),
    "A|E": ("quarantined", "structure differs from the sequence"),
    "B|X": ("quarantined", "no sequence"),
    "B|F": ("quarantined", "profile does not cover the sequence"),
    "D|F": ("quarantined", "hit outside the sequence"),  # of two faults the first named
}


def test_bad_pairs_are_set_aside_and_good_ones_ranked(spark, sources, tmp_path):
    out = f"file://{tmp_path}/out"
    assembly.run(spark, sources, out, seeds=2, radius=1, active=2, passive=1)
    assert {r.pair: (r.status, r.reason) for r in assembly.status(spark, out).collect()} == WANT
    ranked = {(r.side, r.idx): r for r in assembly.results(spark, out, "ranked").collect()}
    assert set(ranked) == {(s, i) for s in (1, 2) for i in range(1, 6)}
    assert {(r.protein, r.letter, r.label) for (s, i), r in ranked.items() if i == 3} == {("A", "A", "A.ALA.3"), ("B", "A", "A.ALA.3")}
    # s on A meets t on B: positions 2 to 4 with 1 and 2.
    assert [ranked[1, i].fragments_strength > 0 for i in range(1, 6)] == [False, True, True, True, False]
    assert [ranked[2, i].fragments_strength > 0 for i in range(1, 6)] == [True, True, False, False, False]
    assert [ranked[1, i].coupling_strength > 0 for i in range(1, 6)] == [True, False, True, False, False]
    lines = [r.line for r in assembly.results(spark, out, "restraints").orderBy("n").collect()]
    best = {s: [i for _, i in sorted((ranked[s, i]["rank"], i) for i in range(1, 6))] for s in (1, 2)}
    assert lines == [f"{c} A.ALA.{i}" for c, s in (("R", 1), ("L", 2)) for i in best[s][:2]] + [f"{c} A.ALA.{best[s][2]} P" for c, s in (("R", 1), ("L", 2))]


def test_runs_resume_and_dead_runs_are_not_read(spark, sources, tmp_path):
    out = f"file://{tmp_path}/out"
    assembly.run(spark, sources, out, seeds=2, radius=1)
    first = sorted(map(str, assembly.results(spark, out, "ranked").collect()))
    # A run that died before it entered the log: its rows are there, and nobody reads them.
    assembly.results(spark, out, "ranked").withColumn("final", F.lit(9.0)).write.parquet(f"{out}/ranked/run=rdead")
    assert sorted(map(str, assembly.results(spark, out, "ranked").collect())) == first
    # Nothing is left to do, so the next run is empty.
    again = assembly.run(spark, sources, out, seeds=2, radius=1)
    assert spark.read.parquet(f"{out}/ranked/run={again}").count() == 0 and spark.read.parquet(f"{out}/log").count() == len(WANT)
    # A new pair, and one that was mended: only `again` takes up the latter.
    with open(sources.pairs, "a") as f:
        f.write("B\tA\n")
    with open(sources.sequences, "a") as f:
        f.write(">X\nAAA\n")
    spark.catalog.refreshByPath(sources.pairs)
    assembly.run(spark, sources, out, seeds=2, radius=1)
    told = {r.pair: r.status for r in assembly.status(spark, out).collect()}
    assert told["B|A"] == "scored" and told["B|X"] == "quarantined"
    assembly.run(spark, sources, out, again=True, seeds=2, radius=1)
    told = {r.pair: r.status for r in assembly.status(spark, out).collect()}
    assert told["B|X"] == "scored" and len(told) == len(WANT) + 1
    rows = assembly.results(spark, out, "ranked").groupBy("pair", "side", "idx").count().collect()
    assert {r["count"] for r in rows} == {1} and {r.pair for r in rows} == {"A|B", "B|A", "B|X"}


def test_unreadable_and_outlying_couplings_and_profiles(spark, sources):
    scans = assembly.scan(spark, sources)
    reason = lambda **changed: {r.pair: r.reason for r in assembly.check(assembly.Scans(**{**scans.__dict__, **changed})).collect()}["A|B"]
    cells = lambda *rows: spark.createDataFrame([("A|B", *r) for r in rows], "pair string, i long, j long, score double")
    assert reason() is None and reason(coupling=cells((5, 5, 1.0))) is None
    for bad in ((6, 1, 1.0), (1, 6, 1.0), (0, 1, 1.0), (1, 1, None), (None, 1, 1.0)):
        assert reason(coupling=cells((1, 1, 0.5), bad)) == "coupling outside the matrix"
    profile = lambda rows: spark.createDataFrame([("A", *r) for r in rows], "protein string, position long, value double")
    whole = [(i, 0.1) for i in range(1, 6)]
    assert reason(conservation=profile(whole)) is None
    for rows in (whole[1:], [*whole, (6, 0.1)], [*whole, (5, 0.1)], [*whole[:4], (5, None)], [*whole[:4], (None, 0.1)]):
        assert reason(conservation=profile(rows)) == "profile does not cover the sequence"
    empty = {name: table.limit(0) for name, table in scans.__dict__.items() if name not in ("pairs", "sequences")}
    nothing = assembly.assemble(assembly.Scans(scans.pairs, scans.sequences, **empty))
    assert {r.final for r in nothing.ranked.collect()} == {0.0} and nothing.restraints.count() == 0
    none = assembly.assemble(assembly.Scans(**{**scans.__dict__, "pairs": scans.pairs.limit(0)}))
    assert none.ranked.count() == none.restraints.count() == none.status.count() == 0


def test_rectangle_votes_by_counting(spark):
    rng = random.Random(3)
    sizes = {"p": (9, 7), "q": (1, 4), "r": (5, 5)}
    found = []
    for pair, (l1, l2) in sizes.items():
        for _ in range({"p": 40, "q": 3, "r": 0}[pair]):
            i, j = sorted(rng.choices(range(1, l1 + 1), k=2)), sorted(rng.choices(range(1, l2 + 1), k=2))
            found.append((pair, *i, *j))
    got = evidence.rectangle_votes(spark.createDataFrame(found, "pair string, i0 long, i1 long, j0 long, j1 long"), spark.createDataFrame([(p, *s) for p, s in sizes.items()], "pair string, l1 long, l2 long"))
    want = {}
    for pair, i0, i1, j0, j1 in found:
        for cell in itertools.product(range(i0, i1 + 1), range(j0, j1 + 1)):
            want[pair, *cell] = want.get((pair, *cell), 0) + 1
    assert {(r.pair, r.i, r.j): r.votes for r in got.collect()} == want


def test_interactions_come_down_to_subjects_of_hits_before_they_meet_them(spark, monkeypatch):
    many = spark.range(5000).select(F.concat(F.lit("s"), F.col("id") % 2).alias("a"), F.concat(F.lit("x"), "id").alias("b")).union(spark.createDataFrame([("s0", "s1"), ("s1", "s0"), ("s1", "s1")], "a string, b string"))
    hits = [("A", "s0", 2, 4), ("A", "s1", 2, 4), ("B", "s1", 1, 2), ("B", "s0", 1, 2), ("C", "s0", 1, 3), ("C", "x7", 1, 3)]
    best = spark.createDataFrame(hits, "query string, subject string, qstart long, qend long")
    good = spark.createDataFrame([("A|B", "A", "B", 5, 3)], "pair string, a string, b string, l1 long, l2 long")
    staged, real = {}, assembly.stage
    monkeypatch.setattr(assembly, "stage", lambda df, name: staged.setdefault(name, real(df, name)))
    got = {(r.pair, r.i, r.j): r.score for r in assembly._fragments(good, best, many).collect()}
    # s0 with s1, s1 with s0 and s1 with itself, all over the same cells.
    assert got == {("A|B", i, j): 3.0 for i in (2, 3, 4) for j in (1, 2)}
    assert staged["hit-interactions"].count() == 3 and staged["best-hits"].count() == 4


def test_hits_are_brought_down_once_for_checks_and_votes(spark, sources, monkeypatch):
    scans = assembly.scan(spark, sources)
    best = assembly.best_hits(scans.hits)
    assert {r.pair: r.reason for r in assembly.check(scans, best).collect()} == {pair: reason for pair, (_, reason) in WANT.items()}
    hits = spark.createDataFrame([("q", "s", 5, 9, 1, 2, 1.0), ("q", "s", 7, 6, 1, 2, 3.0), ("q", "s", 7, 8, 1, 2, 3.0), ("q", "t", 1, 2, 1, 2, 1.0)], "query string, subject string, qstart long, qend long, sstart long, send long, bitscore double")
    assert sorted(tuple(r) for r in assembly.best_hits(hits).collect()) == [("q", "s", 7, 6, 5, 9, True), ("q", "t", 1, 2, 1, 2, False)]
    read = []
    real = assembly.stage
    monkeypatch.setattr(assembly, "stage", lambda df, name: read.append((name, any("hits.tsv" in f for f in df.inputFiles()))) or real(df, name))
    assembly.assemble(scans, seeds=2, radius=1)
    # The file of hits is read on the way to one table only.
    assert [name for name, scanned in read if scanned] == ["subject-hits"]


def test_weighed_rectangles_are_repeated_ones(spark):
    rows = [("p", 1, 3, 2, 2), ("p", 2, 4, 1, 3), ("p", 2, 4, 1, 3), ("p", 2, 4, 1, 3)]
    one = spark.createDataFrame(rows, "pair string, i0 long, i1 long, j0 long, j1 long")
    sizes = spark.createDataFrame([("p", 5, 5)], "pair string, l1 long, l2 long")
    weighed = one.groupBy(*one.columns).agg(F.count(F.lit(1)).alias("w"))
    votes = lambda df, *more: {tuple(r) for r in evidence.rectangle_votes(df, sizes, *more).collect()}
    assert votes(weighed, "w") == votes(one)


def test_status_asks_for_no_ranks(spark, monkeypatch):
    import duckdb
    from ravelin.plans import catalogue

    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(assembly.pair_scoring, "score_pairs", lambda *a, **k: pytest.fail("pairs are scored"))
    con = duckdb.connect()
    for name in ("nation", "lineitem", "orders", "customer", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = sorted(map(str, con.execute(f"SELECT pair, status, reason FROM ({catalogue.ORACLE_SQL['files_to_status']})").fetchall()))
    assert sorted(str(tuple(r)) for r in catalogue.QUERIES["files_to_status"](spark, folder).select("pair", "status", "reason").collect()) == want
