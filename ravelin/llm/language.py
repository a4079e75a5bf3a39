"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text, in lower case, is the bag of its runs of one to four letters within
words, a word's ends marked. Each run's hash names a bucket with an embedding;
the mean of a text's embeddings goes through a linear layer and a softmax. Both
are trained by stochastic gradient descent in numpy on a bounded sample, of
which each text gives evenly drawn runs. A temperature fitted on other labelled
texts turns the softmax into a confidence, and the confidence above which such
texts were right as often as asked is where a prediction is accepted.

As all after the embeddings is linear, a bucket's embedding times the layer is
one row of a table, and a text's score is the mean of its runs' rows.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.base import stage
from ravelin.llm.tokens import groups

#: Letters of the longest run; embeddings, their components, and most numbers in the table of all buckets and languages.
LONGEST, BUCKETS, DIM, TABLE = 4, 1 << 16, 16, 1 << 24
#: Labelled texts that are fitted on and that confidence is fitted on, at most, on average; runs that each of the first gives.
FITTED, TUNED, DRAWN = 8192, 4096, 512
EPOCHS, BATCH, RATE = 6, 64, 0.5
#: Share of accepted predictions that shall be right.
PRECISION = 0.99
UNKNOWN = "und"
#: Letters that are looked at together.
SPAN = 1 << 19


@cache
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(sys.maxunicode + 1)])


def codes(text: str) -> np.ndarray:
    """Code points of a text in lower case, each stretch without letters as one 0, one at either end."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[points]
    points = np.where(letter, points, 0)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first mark after a letter
    return np.concatenate([[0], points[keep], [0]]).astype(np.uint32) if len(points) and letter[-1] else np.concatenate([[0], points[keep]]).astype(np.uint32)


def runs(c: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Buckets of the runs of each length in `codes` that start in its first SPAN: letters only, but for a mark at either end."""
    out, h, inner = [], np.zeros(len(c), np.uint64), np.ones(len(c), bool)
    letter = c > 0
    for length in range(1, LONGEST + 1):
        n = min(len(c) - length + 1, SPAN)
        if n < 1:
            break
        h = (h[:n] * np.uint64(0x9E3779B1) + c[length - 1 : length - 1 + n] + np.uint64(1)) & np.uint64(0xFFFFFFFFFF)
        if length > 2:
            inner = inner[:n] & letter[length - 2 : length - 2 + n]
        good = letter[:n] if length == 1 else letter[:n] | letter[1 : n + 1] if length == 2 else inner
        mixed = (h[good] ^ (h[good] >> np.uint64(15))) * np.uint64(0x85EBCA6B) + np.uint64(length)
        out.append(((mixed >> np.uint64(13)) % np.uint64(buckets)).astype(np.int64))
    return out


def texts_of(column: pa.Array) -> Iterator[str]:
    """Texts of an array in lower case, null as empty, in runs of bounded size."""
    for part in groups(pc.fill_null(column, "")):
        yield from pc.utf8_lower(part).to_pylist()


def _spans(c: np.ndarray) -> Iterator[np.ndarray]:
    """Stretches of `codes`, each with what the runs that start in its first SPAN need."""
    for at in range(0, len(c), SPAN):
        yield c[at : at + SPAN + LONGEST - 1]


def mean_rows(text: str | None, table: np.ndarray) -> np.ndarray | None:
    """Mean of the table's rows of all runs of a text; None if it has no letter."""
    if not text:
        return None
    total, n = np.zeros(table.shape[1]), 0
    for c in _spans(codes(text)):
        for found in runs(c, len(table)):
            total += np.ones(len(found)) @ table.take(found, axis=0, mode="clip")  # faster than a sum over rows
            n += len(found)
    return total / n if n else None


def drawn(text: str | None, buckets: int, most: int = DRAWN) -> np.ndarray:
    """At most `most` of the buckets of a text's runs, evenly over the text and the lengths."""
    if not text:
        return np.empty(0, np.int32)
    found = np.concatenate([np.concatenate(runs(c, buckets) or [np.empty(0, np.int64)]) for c in _spans(codes(text))])
    return (found if len(found) <= most else found[np.linspace(0, len(found) - 1, most).astype(np.int64)]).astype(np.int32)


def train(examples: list[np.ndarray], y: np.ndarray, classes: int, buckets: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """(table, bias) of a softmax over mean embeddings, by gradient descent over shuffled batches."""
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1 / DIM, 1 / DIM, (buckets, DIM)).astype(np.float32)
    w, b = np.zeros((DIM, classes), np.float32), np.zeros(classes, np.float32)
    steps = EPOCHS * -(-len(examples) // BATCH)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(examples))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            parts = [examples[i] for i in some]
            sizes = np.array([len(p) for p in parts])
            here, place = np.unique(np.concatenate(parts), return_inverse=True)
            rows = np.repeat(np.arange(len(some)), sizes)
            share = np.bincount(rows * len(here) + place, (1 / sizes)[rows], len(some) * len(here)).reshape(len(some), -1).astype(np.float32)
            mean = share @ e[here]
            p = softmax(mean @ w + b)
            p[np.arange(len(some)), y[some]] -= 1
            rate = RATE * (1 - step / steps)
            back = p @ w.T
            w -= rate * (mean.T @ p).astype(np.float32)
            b -= (rate / len(some) * p.sum(0)).astype(np.float32)
            e[here] -= rate * (share.T @ back).astype(np.float32)
            step += 1
    return e.astype(np.float64) @ w, b.astype(np.float64)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


def fit_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """What logits are divided by so that the labels are likeliest, between 1/16 and 16."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(softmax(z / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    low, high = -np.log(16.0), np.log(16.0)
    for _ in range(60):
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit_cut(confidence: np.ndarray, right: np.ndarray, precision: float) -> float:
    """The least confidence from which on at least `precision` of predictions are right; above all if there is none."""
    order = np.argsort(-confidence, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    last = np.append(confidence[order][1:] != confidence[order][:-1], True)
    good = np.flatnonzero((share >= precision) & last)
    return float(confidence[order][good[-1]]) if len(good) else float("inf")


class Model:
    """Languages, the table of buckets, bias, temperature and the confidence from which on a prediction is accepted."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, cut: float = 0.0):
        self.langs, self.table, self.bias, self.temperature, self.cut = langs, table, bias, temperature, cut

    def logits(self, text: str | None) -> np.ndarray | None:
        mean = mean_rows(text, self.table)
        return None if mean is None else mean + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, confidence, accepted); `und`, 0 and False for a text without letters or a model without languages."""
        z = self.logits(text) if self.langs else None
        if z is None:
            return UNKNOWN, 0.0, False
        p = softmax(z / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] >= self.cut)


def _example(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            got = [drawn(t, buckets) for t in texts_of(rb.column("text"))]
            yield pa.RecordBatch.from_arrays([rb.column("lang"), rb.column("mix"), pa.array(got, pa.list_(pa.int32()))], names=["lang", "mix", "runs"])

    return run


def _logits(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            got = [model.value.logits(t) for t in texts_of(rb.column("text"))]
            yield pa.RecordBatch.from_arrays([rb.column("lang"), rb.column("mix"), pa.array([None if z is None else z.tolist() for z in got], pa.list_(pa.float64()))], names=["lang", "mix", "z"])

    return run


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            got = [model.value.predict(t) for t in texts_of(rb.column("text"))]
            lang, score, accepted = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([rb.column("doc_id"), rb.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return run


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _share(mix: Column) -> Column:
    """A digest as a number from 0 to 1."""
    return F.conv(F.substring(mix, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def _sampled(rows: DataFrame, most: int, name: str) -> DataFrame:
    """Rows (lang, text, mix) of each language alike, `most` in all on average, by digest; staged."""
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()}
    left, share = most, {}
    for i, lang in enumerate(sorted(sizes, key=lambda x: (sizes[x], x))):  # what a rare language leaves goes to others
        share[lang] = min(1.0, left / (len(sizes) - i) / sizes[lang])
        left -= share[lang] * sizes[lang]
    rates = rows.sparkSession.createDataFrame(list(share.items()) or [("", 0.0)], "lang string, rate double")
    return stage(rows.join(F.broadcast(rates), "lang").where(_share(F.col("mix")) < F.col("rate")).select("lang", "text", "mix"), name)


def fit(docs: DataFrame, fitted: int = FITTED, tuned: int = TUNED, precision: float = PRECISION, salt: str = "") -> Model:
    """A model of the languages of `docs` (doc_id, lang, text), from rows whose lang is not null.

    Rows of fold 1, crc32(doc_id) mod 5, fit the confidence, all others the
    model. Of each use the rows are drawn by a digest of id and text, each
    language alike, `fitted` and `tuned` of them on average; that is also the
    most languages that are learned. Where fewer buckets keep the table within
    TABLE numbers, there are fewer.
    """
    spark = docs.sparkSession
    mix = F.md5(F.concat_ws("|", F.lit(salt), F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary"))).cast("binary"))
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text").withColumn("tune", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))).withColumn("mix", mix)
    sample = _sampled(known.where("NOT tune"), fitted, "language-sample")
    langs = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    if not langs:
        return Model([], np.zeros((1, 0)), np.zeros(0))
    buckets = max(1024, min(BUCKETS, TABLE // len(langs)))
    rows = sample.mapInArrow(_example(buckets), "lang string, mix string, runs array<int>").where("size(runs) > 0").toArrow().to_pylist()  # `fitted` rows on average
    rows.sort(key=lambda r: (r["mix"], r["lang"]))
    place = {lang: i for i, lang in enumerate(langs)}
    if not rows:
        return Model(langs, np.zeros((buckets, len(langs))), np.zeros(len(langs)))
    model = Model(langs, *train([np.array(r["runs"], np.int64) for r in rows], np.array([place[r["lang"]] for r in rows]), len(langs), buckets))
    others = _sampled(known.where("tune"), tuned, "language-tuning")
    got = others.mapInArrow(_logits(spark.sparkContext.broadcast(model)), "lang string, mix string, z array<double>").where("z IS NOT NULL").toArrow().to_pylist()
    got = sorted((r for r in got if r["lang"] in place), key=lambda r: (r["mix"], r["lang"]))
    z, y = np.array([r["z"] for r in got]).reshape(len(got), len(langs)), np.array([place[r["lang"]] for r in got], np.int64)
    model.temperature = fit_temperature(z, y)
    p = softmax(z / model.temperature) if len(got) else z
    model.cut = fit_cut(p.max(1), p.argmax(1) == y, precision) if len(got) else 0.0
    return model


def identify(docs: DataFrame, fitted: int = FITTED, tuned: int = TUNED, precision: float = PRECISION, reject: bool = False) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, accepted.

    Learns as `fit` does from rows whose crc32(doc_id) mod 5 is not 0; the
    others are held out. `lang_pred` is `und`, with score 0, for a text that is
    null or has no letter, and everywhere if no language can be learned. With
    `reject` it is also `und` where the confidence is below the fitted bound;
    otherwise `accepted` tells. A null id is neither held out nor learned from.
    Repeated rows are
    predicted alike, ties go to the language first in order of code points,
    long texts are read whole, in stretches of bounded size; columns beyond
    doc_id, text and lang are not read, and an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("lang")).withColumn("held_out", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows.where(fold(F.col("doc_id")) != 0).drop("held_out"), fitted, tuned, precision))
    out = rows.select("doc_id", "held_out", "text").mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
    return out.withColumn("lang_pred", F.when(F.col("accepted"), F.col("lang_pred")).otherwise(UNKNOWN)) if reject else out
