"""The two long plans on small inputs with known results."""

import zipfile

import pytest
from ravelin.plans import pair_scoring, universe
from ravelin.sources import text

CELLS = {
    "fragments": [(1, 3, 0.8), (2, 2, 0.6), (2, 3, 0.7), (4, 1, 0.1), (4, 2, 0.2), (4, 4, 1.0)],
    "conservation": [(1, 1, 0.2), (1, 2, 0.1), (1, 3, 0.1), (2, 1, 0.8), (2, 2, 1.0), (2, 3, 0.9), (2, 4, 0.1), (3, 1, 0.2), (3, 2, 0.1), (3, 3, 0.2), (4, 1, 0.6), (4, 2, 0.7), (4, 3, 0.5), (4, 4, 0.1)],
    "coupling": [(1, 2, 1.0), (3, 1, 0.6), (3, 3, 0.8), (4, 4, 0.4)],
}
WANT = {
    "fragments_strength": [[0.8, 1.0, 0, 1.15], [0.1, 0.7, 1.15, 1.0]],
    "fragments_component": [[1 / 3, 2 / 3, 0, 1], [0.25, 0.5, 1, 0.75]],
    "conservation_component": [[0.5, 1, 0.5, 0.75], [0.5, 1, 0.75, 0.25]],
    "coupling_component": [[2 / 3, 0, 1, 1 / 3], [0.5, 1, 0.75, 0.25]],
    "patch": [[0.25, 0.5, 0.75, 1], [0.5, 1, 0.75, 0.25]],
    "coupling_bonus": [[1 / 3, 0, 1, 2 / 3], [0.5, 1, 0.75, 0.25]],
    "final": [[0.25, 0.5, 0.75, 1], [0.5, 1, 0.75, 0.25]],
}


def test_worked_example_and_a_pair_without_evidence(spark):
    data = [("toy", b, i, j, s) for b, cells in CELLS.items() for i, j, s in cells]
    cells = spark.createDataFrame(data, "pair string, branch string, i long, j long, score double")
    sizes = spark.createDataFrame([("toy", 4, 4), ("none", 4, 2)], "pair string, l1 int, l2 int")
    rows = pair_scoring.score_pairs(cells, sizes, {"coupling": 0.35}, seeds=2, radius=1, full=4).collect()
    at = {(r.pair, r.side, r.idx): r for r in rows}
    for name, both in WANT.items():
        for side, values in enumerate(both, 1):
            assert [at["toy", side, i][name] for i in range(1, 5)] == pytest.approx(values), name
    assert at["toy", 1, 1].reliability == pytest.approx(0.53125)
    none = sorted((r.side, r.idx, r.rank, r.final, r.patch) for r in rows if r.pair == "none")
    assert none == [(s, i, i, 0.0, 0.0) for s, n in ((1, 4), (2, 2)) for i in range(1, n + 1)]
    outer = {(r.i, r.j): r.priority for r in pair_scoring.priorities(spark.createDataFrame(rows)).collect()}
    assert len(outer) == 16 and outer[4, 2] == 1.0 and outer[1, 4] == 0.0625


def molecular(**fields):
    row = ["-"] * 36
    for i, v in {0: "uniprotkb:P12345", 1: "uniprotkb:Q9Y6K9", 6: 'psi-mi:"MI:0018"(two hybrid)', 9: "taxid:9606(human)", 10: "taxid:10090(mouse)", 11: 'psi-mi:"MI:0915"(physical association)', 20: 'psi-mi:"MI:0326"(protein)', 21: 'psi-mi:"MI:0326"(protein)', 35: "false"}.items():
        row[i] = v
    for i, v in fields.items():
        row[int(i[1:])] = v
    return "\t".join(row)


def test_universe_of_three_sources(spark, tmp_path):
    lines = [
        molecular(),
        molecular(c9="taxid:1(other)"),  # a duplicate: its taxid must not count
        molecular(c0="uniprotkb:Q9Y6K9", c1="uniprotkb:P12345", c6='psi-mi:"MI:0004"(affinity)'),  # ends swapped
        molecular(c35="true"),
        molecular(c11='psi-mi:"MI:0208"(genetic interaction)'),
        molecular(c20='psi-mi:"MI:0319"(dna)'),
        molecular(c0="refseq:NP_1"),
        molecular(c1="uniprotkb:Q9Y6K9|uniprotkb:P67890"),
        molecular(c1="uniprotkb:P12345"),  # a self pair
        "too\tshort",
    ]
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("intact.txt", "\n".join(["#header", *lines]))
        z.writestr("intact_negative.txt", molecular())
    row = [""] * 29
    row[11], row[12], row[15], row[16], row[23], row[27] = "Two-hybrid", "physical", "9606", "9606", "P12345", "A0A022YWF9"
    genetic = [*row[:12], "genetic", *row[13:]]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("BIOGRID.tab3.txt", "\n".join(["h\t" * 30, "\t".join(row), "\t".join(genetic)]))
    links = spark.createDataFrame([(0, "9606.a", "9606.b", 900, 10, 0), (1, "9606.a", "9606.b", 100, 10, 0), (2, "9606.x", "9606.b", 900, 0, 0), (3, "9606.b", "9606.c", 900, 0, 0)], "n long, protein1 string, protein2 string, combined_score int, experimental int, database int")
    aliases = spark.createDataFrame([("9606.a", "P12345", "UniProt_AC"), ("9606.a", "Q9Y6K9", "Ensembl_UniProt"), ("9606.b", "Q9Y6K9", "Ensembl_UniProt"), ("9606.c", "P12345", "UniProt_AC"), ("9606.c", "P67890", "UniProt_AC"), ("9606.x", "junk", "UniProt_AC")], "string_id string, alias string, source string")
    rows = universe.molecular(text.zipped_rows(spark, str(tmp_path / "m.zip"), ["readme", "negative"], 36, first_only=True)).unionByName(universe.experimental(text.zipped_rows(spark, str(tmp_path / "b.zip"), ["readme"], 29, header_lines=1))).unionByName(universe.scored_links(links, universe.resolve_aliases(aliases)))
    unique = universe.evidence(rows)
    got = {(r.p1, r.p2): r for r in universe.pairs(unique).collect()}
    assert set(got) == {("P12345", "Q9Y6K9"), ("P12345", "P12345"), ("A0A022YWF9", "P12345")}
    pair = got["P12345", "Q9Y6K9"]
    assert pair.sources == ["IntAct", "STRING"] and pair.support == 3 and pair.method_ids == ["MI:0004", "MI:0018", "string:experimental"]
    assert pair.taxids_1 == [9606, 10090] and pair.same_species and pair.cross_species and not pair.self_interaction
    assert got["P12345", "P12345"].self_interaction
    counts = {(r.source, r.outcome): r.n for r in universe.accounting(rows, unique).collect()}
    assert counts == {("IntAct", "evidence"): 3, ("IntAct", "duplicate"): 1, ("IntAct", "negative"): 1, ("IntAct", "nonphysical"): 1, ("IntAct", "nonprotein"): 1, ("IntAct", "map_a"): 1, ("IntAct", "map_b"): 1, ("BioGRID", "evidence"): 1, ("BioGRID", "duplicate"): 0, ("BioGRID", "nonphysical"): 1, ("STRING", "evidence"): 1, ("STRING", "duplicate"): 0, ("STRING", "low_score"): 1, ("STRING", "map_a"): 1, ("STRING", "map_b"): 1}
