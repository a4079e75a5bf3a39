"""Archives of other writers, and vectors whose hashes collide or whose ids repeat."""

import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F
from ravelin.llm import base, embedding_dedup, warc


def record(kind, block, *fields):
    head = "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", f"Content-Length: {len(block)}", *fields])
    return gzip.compress(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_archives_of_other_writers_are_read(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    members = [
        record("warcinfo", b"software: other\r\n", "WARC-Record-ID: <urn:uuid:1>"),
        record("response", http + b"hello", "WARC-Record-ID: <urn:uuid:2>", "WARC-Target-URI: http://a.b/"),
        record("response", http + b"world", "WARC-Record-ID: <urn:uuid:3>", "WARC-Payload-Digest: sha1:" + hashlib.sha1(b"world").hexdigest()),
        record("revisit", http, "WARC-Record-ID: <urn:uuid:4>", "WARC-Refers-To: <urn:uuid:2>", "WARC-Payload-Digest: sha256:00"),
        record("metadata", b"", "WARC-Record-ID: <urn:uuid:5>"),
        record("response", b"HTTP/1.1 200 OK\r\nodd line\r\nContent-Length: 2\r\n\r\nok", "WARC-Record-ID: <urn:page:7>"),
    ]
    got = list(warc.records(io.BytesIO(b"".join(members))))
    assert [r["kind"] for r in got] == ["warcinfo", "response", "response", "revisit", "metadata", "response"]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    spark.createDataFrame([("a.warc.gz", 6, 1)], "file string, records long, bytes long").write.parquet(f"file://{tmp_path}/files")
    rows = warc.read(spark, f"file://{tmp_path}").collect()
    assert [(r.page_id, r.payload_bytes, r.record_type, r.payload and bytes(r.payload)) for r in rows] == [(None, 5, "response", b"hello"), (None, 5, "response", b"world"), (None, None, "revisit", None), (7, 2, "response", b"ok")]
    assert rows[2].payload_digest is None and len(rows[0].payload_digest) == 40
    bad = record("response", http + b"world", "WARC-Payload-Digest: sha1:" + "0" * 40)
    with pytest.raises(ValueError, match="digest"):
        list(warc.records(io.BytesIO(bad)))


def test_stores_are_known_by_either_name(tmp_path):
    assert base.file_store(f"file://{tmp_path}")[1] == str(tmp_path)
    try:
        named = base.file_store("s3a://bucket/folder")[1]
    except (OSError, NotImplementedError, ImportError):  # Arrow without that store, or no network to ask for its region
        return
    assert named == "bucket/folder"


def test_hashes_that_collide_are_told_apart(spark, monkeypatch):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (None, [0.0, 2.0], 0), (3, [-0.0, 1.0], 0), (4, [1.0, 0.0], 1), (5, None, 0), (6, [float("nan"), 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("uid", F.lit("x"))
    plain = sorted(map(str, embedding_dedup.find_groups(df).collect()))
    real = embedding_dedup._value_hash
    monkeypatch.setattr(embedding_dedup, "_value_hash", lambda seed: F.lit(7).cast("long") if seed == 0 else real(seed))
    assert sorted(map(str, embedding_dedup.find_groups(df).collect())) == plain
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.find_groups(df).collect()}
    assert got == {(1, 1, 1, True), (2, 2, 2, True), (None, 2, 2, False), (3, 2, 2, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True)}


def test_blocks_of_a_cell_lose_no_link(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    base_rows = rng.normal(size=(40, 8))
    v = np.concatenate([base_rows + rng.normal(size=(40, 8)) * 0.12 for _ in range(6)]).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), i % 2) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.arange(240)[:, None] % 2 == np.arange(240)[None, :] % 2)
    np.fill_diagonal(near, False)
    for cell, block in ((4096, 4096), (16, 9), (200, 30)):
        got = {r.vec_id: r.n_links for r in embedding_dedup.find_groups(df, cell=cell, block=block).collect()}
        assert got == dict(enumerate(near.sum(1).tolist()))


def test_written_archives_hold_a_member_per_record(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a" * 2000), (2, "u", "a" * 2000), (3, None, None)], "page_id long, url string, html string").coalesce(1)
    warc.write(pages, f"file://{tmp_path}/w")
    (file,) = [f for f in (tmp_path / "w").iterdir() if f.name.endswith(".warc.gz")]
    assert file.read_bytes()[:2] == b"\x1f\x8b" and gzip.decompress(file.read_bytes()).count(b"WARC/1.1\r\n") == 3
    assert [r["kind"] for r in warc.records(io.BytesIO(file.read_bytes()))] == ["revisit", "response", "response"]
