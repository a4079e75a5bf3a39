"""Texts encoded in batches give the library's ids; packing and token files hold bounded batches."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from ravelin.llm import packing, token_output
from ravelin.llm.tokens import Encoder, encoder

from .conftest import AWKWARD

BYTES, WORDS = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = [
    *AWKWARD, "a  b   c\n\n d \t", " lead", "  lead", "trail  ", "don't STOP.Now, “quoted” it's 'tis x's. o'.b ''s", "<|endoftext|> x", "a\x1cb\x1f", "\x1eb", "a\xa0 b\xa0\xa0 c　 d", "İstanbul ΣΑΣ ß", "é x", "x   y",
    "a.b.c,d!e", "one.\nTwo\n\nthree \nfour\n five", "x1y22z 3,4 5.6.7.8", "x².y µm ªº", "á.b.́c", "日.本,語 a日.", "WÖRD!!! ÀÉ.ß", "\n", " ", "a\n", ".\n.", "no-space" * 40, "in...to ,x", "a\x0bb\x0c.c\r\nd", "tab\tbed\t.",
]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_a_batch_gives_the_ids_of_whole_texts(path):
    e = encoder(path)
    assert list(e.encode_all(pa.array(TEXTS, pa.string()))) == [e._whole(t) if t else b"" for t in TEXTS]
    assert [e.encode(t) for t in TEXTS] == [e._whole(t) if t else b"" for t in TEXTS]
    assert list(e.encode_all(pa.array([], pa.string()))) == []
    assert list(e.encode_all(pa.array(TEXTS, pa.string()).slice(3, 9))) == [e._whole(t) if t else b"" for t in TEXTS[3:12]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abZÉß.,!'’ \n\t\r 　\x1d\x1e1-²ª日"), max_size=30), max_size=6))
def test_a_batch_gives_the_ids_of_any_texts(texts):
    for path in (BYTES, WORDS):
        e = encoder(path)
        assert list(e.encode_all(pa.array(texts, pa.string()))) == [e._whole(t) if t else b"" for t in texts]


def test_groups_are_bounded_and_the_cache_too(monkeypatch):
    monkeypatch.setattr("ravelin.llm.tokens.SPLIT_BYTES", 64)
    monkeypatch.setattr("ravelin.llm.tokens.GENERATION", 10)
    for path in (BYTES, WORDS):
        e, texts = Encoder(path), [f"word{i} again. Line\nnext " * (i % 5) + "x" * (i % 7) for i in range(120)]
        assert list(e.encode_all(pa.array(texts))) == [e._whole(t) if t else b"" for t in texts]
        assert len(e) + len(e._old) <= 22 and len(e._runs) <= 10


def test_packing_holds_few_bytes_of_long_texts(docs, monkeypatch):
    from .conftest import rows

    monkeypatch.setattr(packing, "BATCH_BYTES", 1)
    table = docs(rows("a b c", None, "word " * 3000, "")).coalesce(1)
    pieces = packing.pack(table, BYTES, batch=3).collect()
    assert sum(p.length for p in pieces) == sum(len(encoder(BYTES).encode(t)) // 4 + 1 for t in ("a b c", None, "word " * 3000, ""))


def test_more_symbols_than_the_table_can_name_are_refused():
    with pytest.raises(ValueError, match="symbols"):
        token_output.quantise(np.ones((1 << token_output.SCALE) + 1))
