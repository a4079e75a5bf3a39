"""Language identification: the scorer against a plain one, held-out accuracy, rejection and awkward rows."""

import unicodedata
import zlib

import numpy as np
import pytest
from ravelin.llm import language

SF = "/root/testdata/sf0.01"


def plain_buckets(text, buckets):
    """Runs of one to four letters within words whose ends are marked, each hashed by itself."""
    words = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text).split()
    out = []
    for word in words:
        marked = [0, *map(ord, word), 0]
        for n in range(1, language.LONGEST + 1):
            for i in range(len(marked) - n + 1):
                run = marked[i : i + n]
                if any(run) and not (n == 1 and not run[0]):
                    h = 0
                    for c in run:
                        h = (h * 0x9E3779B1 + c + 1) & 0xFFFFFFFFFF
                    out.append((((h ^ h >> 15) * 0x85EBCA6B + n) % 2**64 >> 13) % buckets)
    return sorted(out)


@pytest.mark.parametrize("text", ["a", "ab", "abc d", "Ärger über 12 Öfen!", "日本語 テキスト", "😀 é", " x\ty ", "a" * 30, "1 2 3", "", "word1word"])
def test_runs_are_those_of_the_words(text):
    c = language.codes(text.lower())
    got = sorted(int(x) for part in language.runs(c, 4096) for x in part)
    assert got == plain_buckets(text.lower(), 4096)


def test_stretches_change_no_mean(monkeypatch):
    rng = np.random.default_rng(2)
    text = " ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 9))) for _ in range(400))
    table = rng.normal(size=(4096, 3))
    whole = language.mean_rows(text, table)
    want = table[plain_buckets(text, 4096)].mean(0)
    assert np.allclose(whole, want)
    monkeypatch.setattr(language, "SPAN", 64)
    parts = language.mean_rows(text, table)
    assert np.allclose(parts, want)


def test_held_out_documents_are_told(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(rows) == docs.count()
    assert (rows.held_out == rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = rows[rows.held_out]
    assert (held.lang == held.lang_pred).mean() >= 0.98
    assert rows.score.between(0, 1).all() and set(rows.lang_pred) <= {*rows.lang, "und"}
    again = language.identify(docs).toPandas().sort_values("doc_id")
    first = rows.sort_values("doc_id")
    assert (again.lang_pred.to_numpy() == first.lang_pred.to_numpy()).all() and np.allclose(again.score, first.score)


def test_nothing_is_learned_from_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text", "source").toPandas()
    held = docs.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)
    spoilt = docs.copy()
    spoilt.loc[held, "lang"] = "zz"
    spoilt["source"] = "same"
    schema = "doc_id long, lang string, text string, source string"
    one, two = (language.identify(spark.createDataFrame(d, schema)).toPandas().sort_values("doc_id") for d in (docs, spoilt))
    assert (one.lang_pred.to_numpy() == two.lang_pred.to_numpy()).all() and (one.score.to_numpy() == two.score.to_numpy()).all()


def test_foreign_texts_are_rejected(spark):
    rng = np.random.default_rng(5)
    make = lambda letters, i: (i, " ".join("".join(rng.choice(list(letters), 5)) for _ in range(40)))
    data = [(*make("abcdef" if i % 2 else "ghijkl", i), "one" if i % 2 else "two") for i in range(400)]
    mixed = [(*make("acegikbdfhjl", 1000 + i), None) for i in range(50)]
    docs = spark.createDataFrame(data + mixed, "doc_id long, text string, lang string")
    rows = language.identify(docs, reject=True, precision=1.0).toPandas().set_index("doc_id")
    assert all(rows.lang_pred[i] == ("one" if i % 2 else "two") for i in range(400) if rows.accepted[i])
    assert rows.accepted[rows.index < 1000].mean() > 0.95
    assert rows.score[rows.index >= 1000].mean() < rows.score[rows.index < 1000].mean()


def test_cut_is_the_least_that_holds():
    c = np.array([0.9, 0.8, 0.8, 0.7, 0.6])
    assert language.fit_cut(c, np.array([1, 1, 1, 0, 0], bool), 1.0) == 0.8
    assert language.fit_cut(c, np.array([1, 0, 1, 1, 1], bool), 0.8) == 0.6
    assert language.fit_cut(c, np.zeros(5, bool), 0.5) == float("inf")
    z = np.array([[4.0, 0.0]] * 100)
    y = np.array([0] * 75 + [1] * 25)
    assert abs(language.softmax(z / language.fit_temperature(z, y))[0, 0] - 0.75) < 0.01


def test_awkward_rows(spark, docs, awkward, empty):
    rows = language.identify(awkward).collect()
    assert len(rows) == awkward.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (0, 1, 2))  # null, empty and blank
    assert {r.lang_pred for r in rows} == {"und", "en"}
    assert language.identify(empty).count() == 0
    unlabelled = docs([(i, "some text", None, "s", 1, *"xyzkf") for i in range(9)])
    assert {(r.lang_pred, r.score) for r in language.identify(unlabelled).collect()} == {("und", 0.0)}
    assert len(language.identify(awkward).columns) == 5
