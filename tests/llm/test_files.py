import hashlib
import io
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from ravelin.llm import packing, token_output, warc
from ravelin.llm.tokens import Encoder, encoder

from .conftest import AWKWARD

BYTES, WORDS = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PAGES = "page_id long, url string, html string, digest string, n string, _keep string"


def library(path, text):
    return encoder(path)._whole(text) if text else b""


@pytest.mark.parametrize("path", [BYTES, WORDS])
@pytest.mark.parametrize("text", [*AWKWARD, "a  b   c\n\n d \t", " lead", "trail  ", "don't STOP.Now, “quoted”", "<|endoftext|> x", "a\x1cb\x1f", "a\xa0 b\xa0\xa0 c　 d", "İstanbul ΣΑΣ ß", "é x", "x   y"])
def test_parts_give_the_ids_of_the_whole_text(path, text):
    assert encoder(path).encode(text) == library(path, text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abZé.,!' \n\t 　\x1d1-"), max_size=40))
def test_parts_give_the_ids_of_any_text(text):
    for path in (BYTES, WORDS):
        assert encoder(path).encode(text) == library(path, text)


def test_the_cache_is_bounded(monkeypatch):
    monkeypatch.setattr("ravelin.llm.tokens.GENERATION", 10)
    e = Encoder(WORDS)
    for i in range(200):
        e.encode(f"word{i} again")
    assert len(e) + len(e._old) <= 22


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 256), min_size=1, max_size=120), st.integers(1, 12))
def test_differencing_partitions_all_items(sizes, k):
    sets = packing.difference(sizes, k)
    assert len(sets) == k and sorted(i for s in sets for i in s) == list(range(len(sizes)))
    windows = packing.pack_batch(sizes, 256)
    assert sorted(i for s in windows for i in s) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in s) <= 256 for s in windows)


def test_differencing_balances_better_than_dealing():
    sizes = np.random.default_rng(2).integers(1, 257, 600).tolist()
    sums = [sum(sizes[i] for i in s) for s in packing.difference(sizes, 20)]
    assert max(sums) - min(sums) <= 8


def test_pieces_cover_documents_and_fill_windows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ids = {r.doc_id: library(BYTES, r.text) + bytes(4) for r in df.collect()}
    pieces = packing.pack(df, BYTES).collect()
    whole, windows = {i: b"" for i in ids}, {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start * 4 == len(whole[p.doc_id]) and p.length * 4 == len(p.ids) and p.doc_tokens * 4 == len(ids[p.doc_id])
        whole[p.doc_id] += bytes(p.ids)
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert whole == ids
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(map(len, ids.values())) / 4 / (1024 * len(windows)) > 0.97


def test_packing_awkward_rows(awkward, empty):
    pieces = packing.pack(awkward, BYTES).collect()
    assert sum(p.length for p in pieces) == sum(len(library(BYTES, r.text)) // 4 + 1 for r in awkward.collect())
    assert packing.pack(empty, BYTES).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=400), st.integers(1, 64))
def test_coding_gives_tokens_back(tokens, lanes):
    t = np.array(tokens, np.uint32)
    coder = token_output.Coder(token_output.quantise(np.bincount(t)))
    assert (coder.decode(len(t), *[x.astype(np.uint64) for x in coder.encode(t, lanes)]) == t).all()


def test_frequencies_sum_up_and_keep_rare_symbols():
    counts = np.array([10**12, 1, 0, 5, 10**6] + [1] * 40_000)
    freq = token_output.quantise(counts)
    assert freq.sum() == 1 << token_output.SCALE and ((freq > 0) == (counts > 0)).all()


def test_a_damaged_block_is_told():
    coder = token_output.Coder(token_output.quantise(np.ones(100)))
    block = bytearray(token_output.write_block(coder, [1, None], [30, 20], np.arange(50, dtype=np.uint32)))
    ids, lengths, tokens = token_output.read_block(coder, bytes(block))
    assert ids == [1, None] and lengths.tolist() == [30, 20] and tokens.tolist() == list(range(50))
    block[12 + 12 + 2 * 17 + 30] ^= 1
    with pytest.raises(ValueError):
        token_output.read_block(coder, bytes(block))


def test_token_files_give_documents_back_in_order(awkward, empty):
    got = token_output.round_trip(awkward, WORDS, block_tokens=1000, lanes=16).orderBy("start").collect()
    want = sorted(((r.doc_id is not None, r.doc_id or 0, library(WORDS, r.text) + array("I", [2]).tobytes()) for r in awkward.collect()), key=lambda x: (x[0], x[1], zlib.crc32(x[2]), len(x[2])))
    assert [(r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in got] == want
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    assert token_output.round_trip(empty, WORDS).count() == 0


def test_archives_give_pages_back_with_revisits(spark):
    big, other = "é" * 700, "x" * 200_000
    data = [(1, "http://a/1", big), (5, None, big), (3, "http://a/ü?q=1\r\nX", big), (2, "http://b", "short"), (4, "http://b", "short"), (6, "u", None), (7, "u", ""), (8, "u", other), (9, "u", other), (9, "u", other), (None, "u", other), (None, "u", "null id")]
    pages = spark.createDataFrame([(*r, "d", "n", "k") for r in data], PAGES)
    got = warc.round_trip(pages, file_bytes=2000).collect()
    assert len(got) == len(data)
    keep = {big: 5, other: 9}
    want = []
    for i, _, html in data:
        raw = (html or "").encode()
        to = keep.get(html)
        revisit = to is not None and i != to
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", to if revisit else None, None if revisit else raw))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got), key=str) == sorted(want, key=str)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_a_damaged_archive_is_told():
    payload = b"<html>" + bytes(range(256)) * 900
    digest = hashlib.sha1(payload).digest()
    data = b"".join(warc.member(i, "u", payload, digest, False, None, "2024-01-01T00:00:00Z") for i in range(3))
    found = list(warc.records(io.BytesIO(data)))
    assert [r["payload"] == payload for r in found] == [True] * 3
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.records(io.BytesIO(data[:-20])))
    bad = warc.member(1, "u", payload, hashlib.sha1(b"other").digest(), False, None, "2024-01-01T00:00:00Z")
    with pytest.raises(ValueError, match="payload"):
        list(warc.records(io.BytesIO(bad)))
