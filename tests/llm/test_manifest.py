"""The manifest against plain Python on trees of many shapes, and its SQL twin."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from ravelin.llm import manifest
from ravelin.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text) rows."""

    def leaf(r):
        return h(*map(field, r))

    def tree(level):
        """Root, and each leaf's steps (left, right)."""
        steps, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for i, p in enumerate(at):
                run = p - p % 2
                steps[i].append(("".join(level[run:p]), "".join(level[p + 1 : run + 2])))
                at[i] = p // 2
            level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0], steps

    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    ordered = {k: sorted(by[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for k in langs}
    trees = {k: tree([leaf(r) for r in ordered[k]]) for k in langs}
    root, tops = tree([trees[k][0] for k in langs])
    out = []
    for k, top in zip(langs, tops, strict=True):
        for r, steps in zip(ordered[k], trees[k][1], strict=True):
            changed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                changed = (*r[:3], r[3] + 1, r[4])
            folded = leaf(changed)
            for left, right in [*steps, *top]:
                folded = h(left, folded, right)
            out.append((r[0], leaf(r), trees[k][0], root, h(*[a + b for a, b in [*steps, *top]]), folded, folded == root))
    return out


def result(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


@pytest.mark.parametrize("sizes", [[1], [2], [3], [16], [17], [1, 1], [33, 1, 2], [5, 256, 1, 16, 7], [1, 2, 3, 4, 5, 6, 7]])
def test_trees_of_many_shapes(spark, sizes):
    rows = [(1000 * k + i, f"s{i % 3}", f"l{k}", i, f"t {i}") for k, n in enumerate(sizes) for i in range(n)]
    assert result(manifest.manifest(table(spark, rows))) == sorted(brute(rows), key=repr)


def test_levels_per_shuffle_change_nothing(spark):
    rows = [(i, None, None if i % 3 == 0 else "é" if i % 3 == 1 else "z", i, "x" * (i % 5)) for i in range(70)]
    want = sorted(brute(rows), key=repr)
    assert all(result(manifest.manifest(table(spark, rows), levels=k)) == want for k in (1, 3))


def test_awkward_rows(spark, awkward, empty):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in awkward.collect()]
    got = result(manifest.manifest(awkward))
    assert got == sorted(brute(rows), key=repr) and any(r[0] is None for r in got)
    assert manifest.manifest(empty).count() == 0
    odd = [(None, None, None, None, None)] * 3 + [(i, None, None, None, None) for i in range(30)] + [(5, "a", "", 1, ""), (5, "a", "", 1, "")]
    assert result(manifest.manifest(table(spark, odd))) == sorted(brute(odd), key=repr)


def test_tampered_rows_alone_fail(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = manifest.manifest(docs).collect()
    assert all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) for r in rows) and not all(r.verified for r in rows)


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = QUERIES["op12_manifest"](spark, SF).toPandas()
    want = con.execute(ORACLE_SQL["op12_manifest"]).fetchdf()[list(got.columns)]
    assert got.sort_values("doc_id").to_numpy().tolist() == want.sort_values("doc_id").to_numpy().tolist()
