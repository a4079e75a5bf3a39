"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

Two models, toxic and ordinary, predict each letter of a word from up to four
before it. Each class has its own counts at the highest order; below it both
share one interpolated Kneser-Ney backoff whose continuation counts are taken
over all documents, so a rare expression is smoothed by the whole corpus and a
context that a class never saw cancels out. A text's log-likelihood ratios,
normalised by length over the text, its windows and its words, become a score
by a logistic function fitted on labelled documents that the models did not
see.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.base import keep_rows, keyed, settled, stage
from ravelin.llm.tokens import groups

ORDER, DISCOUNT, WINDOW, CUT = 5, 0.75, 32, 0.3
#: Most toxic words that are averaged, and the ratio above which a word is marked.
WORST, MARKED = 4, 2.0
#: Labelled documents that the toxic model, the ordinary one and the logistic function are fitted on at most.
TOXIC, ORDINARY, CALIBRATION = 2000, 8000, 4096
_BEGIN, _END = "\x02", "\x03"
_CACHE, _LONGEST = 100_000, 48
_words = re.compile(r"\w+").findall
#: What parts words in texts up to U+00FF, as the pattern above does; other texts are split by it.
_BETWEEN = r"[^0-9A-Za-z_\x{aa}\x{b2}\x{b3}\x{b5}\x{b9}\x{ba}\x{bc}-\x{be}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+"
_FOREIGN = r"[^\x00-\xff]"


def split_words(texts: pa.Array) -> Iterator[tuple[list[str], list[np.ndarray]]]:
    """For runs of texts of bounded size: their distinct words, and each text's words as places in that list.

    Lower case, in order; null and empty texts have no words.
    """
    for part in groups(pc.fill_null(texts, "")):
        odd = pc.match_substring_regex(part, _FOREIGN)
        lists = pc.split_pattern_regex(pc.utf8_lower(pc.if_else(odd, "", part)), _BETWEEN)
        coded = lists.flatten().dictionary_encode()
        known, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices)
        bounds = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        blank = known.index("") if "" in known else -1
        texts_words = [w[w != blank] for w in np.split(at, bounds[1:-1])]
        if pc.any(odd).as_py():
            place = {w: i for i, w in enumerate(known)}
            for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
                texts_words[i] = np.array([place.setdefault(w, len(place)) for w in _words(part[i].as_py().lower())], np.int64)
            known = list(place)
        yield known, texts_words


def letter_runs(word: str) -> list[str]:
    """For every letter and the word's end: it and up to four letters before it."""
    marked = _BEGIN + word + _END
    return [marked[max(0, i - ORDER + 1) : i + 1] for i in range(1, len(marked))]


def _types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[str] = set()
    words: set[str] = set()
    for rb in batches:
        for known, _ in split_words(rb.column(0)):
            for word in known:
                if word and word not in words:
                    seen.update(letter_runs(word))
                    if len(seen) > _CACHE:
                        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], names=["run"])
                        seen.clear()
            words.update(w for w in known if len(w) <= _LONGEST)
            if len(words) > _CACHE:
                words.clear()
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], names=["run"])


def shared_backoff(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(g, p): interpolated Kneser-Ney probability of the last letter of `g` after its others.

    Over the distinct sequences of all documents; `g` has one to four letters.
    """
    types = stage(docs.select(text_col).mapInArrow(_types, "run string").distinct(), "letter-runs")
    ends = types.select(F.explode(F.transform(F.sequence(F.lit(2), F.length("run")), lambda m: F.right("run", m))).alias("x")).distinct()
    counts = stage(ends.groupBy(F.expr("substring(x, 2)").alias("g")).agg(F.count("*").alias("n")), "continuations")
    before = counts.groupBy(F.expr("left(g, length(g) - 1)").alias("h")).agg(F.sum("n").alias("s"), F.count("*").alias("u"))
    rows = stage(counts.withColumn("h", F.expr("left(g, length(g) - 1)")).join(before, "h"), "contexts")
    level = rows.where("length(g) = 1").select("g", ((F.col("n") + 0.5) / (F.col("s") + 0.5 * F.col("u"))).alias("p"))
    out = level
    for length in range(2, ORDER):
        lower = level.select(F.col("g").alias("low"), F.col("p").alias("low_p"))
        here = rows.where(F.length("g") == length).withColumn("low", F.expr("substring(g, 2)")).join(lower, "low")
        share = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("u") * F.col("low_p")
        level = stage(here.select("g", (share / F.col("s")).alias("p")), "backoff")
        out = out.unionByName(level)
    return out


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = (Counter(), Counter())
    for rb in batches:
        for toxic, text in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
            for word, n in Counter(_words((text or "").lower())).items():
                for run in letter_runs(word):
                    counts[toxic][run] += n
    rows = [(run, counts[1][run], counts[0][run]) for run in counts[0].keys() | counts[1].keys()]
    if rows:
        run, toxic, plain = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(run, pa.string()), pa.array(toxic, pa.int64()), pa.array(plain, pa.int64())], names=["run", "toxic", "plain"])


class WordRatios(dict):
    """Maps a word to its toxic minus ordinary log-likelihood."""

    def __init__(self, seen: dict[str, float], unseen: dict[str, float]):
        super().__init__()
        self._seen, self._unseen = seen, unseen

    @classmethod
    def fit(cls, rows: list[tuple[str, int, int, float]]) -> WordRatios:
        """From (letters, toxic count, ordinary count, shared backoff probability)."""
        runs = [r[0] for r in rows]
        back = np.array([r[3] for r in rows], float)
        contexts = {h: i for i, h in enumerate(dict.fromkeys(r[:-1] for r in runs))}
        at = np.array([contexts[r[:-1]] for r in runs], np.int64)
        logs, lost = [], []
        for k in (1, 2):
            count = np.array([r[k] for r in rows], float)
            total = np.bincount(at, count, len(contexts))
            kinds = np.bincount(at, count > 0, len(contexts))
            left = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            own = np.where(total[at] > 0, np.maximum(count - DISCOUNT, 0) / np.maximum(total[at], 1), 0.0)
            logs.append(np.log(own + left[at] * back))
            lost.append(np.log(left))
        return cls(dict(zip(runs, (logs[0] - logs[1]).tolist(), strict=True)), dict(zip(contexts, (lost[0] - lost[1]).tolist(), strict=True)))

    def __missing__(self, word: str) -> float:
        ratio = 0.0
        for run in letter_runs(word):
            known = self._seen.get(run)
            ratio += self._unseen.get(run[:-1], 0.0) if known is None else known
        if len(word) <= _LONGEST:
            if len(self) >= _CACHE:
                self.clear()
            self[word] = ratio
        return ratio

    def __reduce__(self):
        return type(self), (self._seen, self._unseen)


def figures(r: np.ndarray, words: np.ndarray) -> tuple[float, ...]:
    """Length-normalised ratios of a text, and the logarithm of its length.

    `r` are its words' ratios in order and `words` numbers that tell the words
    apart. Per word of the whole text; per word of its most toxic window; of
    its most toxic words, each counted once; and what words exceed MARKED by,
    over the square root of the number of words, as such a sum spreads over a
    text by chance. Texts without words give zeros.
    """
    if not len(r):
        return (0.0,) * 5
    sums = np.concatenate([[0.0], np.cumsum(r)])
    wide = min(WINDOW, len(r))
    best: dict[int, float] = {}
    for i in np.argsort(-r, kind="stable").tolist():
        best.setdefault(int(words[i]), float(r[i]))
        if len(best) == WORST:
            break
    return float(r.mean()), float((sums[wide:] - sums[:-wide]).max()) / wide, sum(best.values()) / WORST, float(np.maximum(r - MARKED, 0).sum()) / len(r) ** 0.5, float(np.log(len(r)))


def all_figures(ratios: WordRatios, texts: pa.Array) -> Iterator[np.ndarray]:
    """Figures of the texts of an array, in order, a row for each, in runs of bounded size."""
    for known, texts_words in split_words(texts):
        r = np.array(list(map(ratios.__getitem__, known)), float)
        yield np.array([figures(r[w], w) for w in texts_words])


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a penalised logistic regression, the intercept last and free."""
    x = np.hstack([x, np.ones((len(x), 1))])
    keep = np.diag([penalty] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _scorer(model, weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = model.value
        mean, scale, w = weights
        for rb in batches:
            at = 0
            for x in all_figures(ratios, rb.column(1)):
                z = ((x - mean) / scale * w[:-1]).sum(1) + w[-1]
                keys = [c.slice(at, len(x)) for i, c in enumerate(rb.columns) if i != 1]
                at += len(x)
                yield pa.RecordBatch.from_arrays([*keys, pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", *rb.schema.names[2:], "score"])

    return run


def _figures(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            at = 0
            for x in all_figures(model.value, rb.column(1)):
                yield pa.RecordBatch.from_arrays([rb.column(0).slice(at, len(x)).cast(pa.int64()), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["toxic", "x"])
                at += len(x)

    return run


def _fold(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def score(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC, ordinary_docs: int = ORDINARY, calibration: int = CALIBRATION, cut: float = CUT, row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, and `row_col` (a long) if it is named.

    Labels count from documents whose crc32(doc_id) mod 4 is not 2: folds 0 and
    1 fit the models, on at most `toxic_docs` and `ordinary_docs` documents in
    order of a digest of the id, fold 3 the logistic function, on at most
    `calibration`.
    A document labelled twice is toxic if one label says so; null labels and
    labels of unknown documents are left out. Without documents of both
    classes every score is the rate of toxic labels. Texts without words,
    empty or null, get the score of a text whose figures are 0; very long ones
    are read whole. Of different texts that share a labelled id one is fitted
    on, that of the smallest digest. A null id is never held out. Repeated rows
    score alike, ties do not occur, columns beyond doc_id, text and `row_col`
    are not read, whatever they are called, and an empty table gives no rows.
    """
    spark = docs.sparkSession
    row = [row_col] if row_col else []
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *row)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = stage(known.where(_fold(F.col("_id")) != 2).withColumn("_mix", F.md5(F.col("_id").cast("string").cast("binary"))), "labels")
    # Labels of documents that are here; a bounded number of them goes on.
    here = keep_rows(known.withColumn("doc_id", F.col("_id")), stage(texts.select(F.col("doc_id").alias("_id")).distinct(), "label-ids"), "left_semi")
    here = stage(here.drop("doc_id"), "labels-here")
    first = lambda rows, n: rows.orderBy("_mix").limit(n)
    fit = here.where(_fold(F.col("_id")) != 3)
    chosen = first(fit.where("toxic >= 1"), toxic_docs).unionByName(first(fit.where("toxic < 1"), ordinary_docs)).withColumn("use", F.lit("fit"))
    chosen = stage(chosen.unionByName(first(here.where(_fold(F.col("_id")) == 3), calibration).withColumn("use", F.lit("tune"))), "chosen-labels")
    # At most toxic_docs + ordinary_docs + calibration rows.
    # Of texts that share a labelled id the one of the smallest digest counts.
    found = texts.join(F.broadcast(chosen.select("_id", "toxic", "use")), F.col("doc_id") == F.col("_id")).select("doc_id", "use", F.greatest(F.lit(0), F.least(F.lit(1), "toxic")).alias("toxic"), "text")
    one = F.min_by(F.struct("use", "toxic", "text"), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")))
    sample = stage(found.groupBy("doc_id").agg(one.alias("_one")).select("_one.*"), "labelled-texts")
    sizes = {(r["use"], r["toxic"]): r["n"] for r in sample.groupBy("use", "toxic").agg(F.count("*").alias("n")).collect()}
    toxic, plain = (sum(n for (_, t), n in sizes.items() if t == k) for k in (1, 0))
    held_out = F.coalesce(_fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")
    if any(("fit", k) not in sizes for k in (0, 1)) or any(("tune", k) not in sizes for k in (0, 1)):
        rate = toxic / max(1, toxic + plain)
        return texts.select("doc_id", held_out, F.lit(float(rate)).alias("score"), F.lit(int(rate >= cut)).alias("predicted"), *row)
    counts = sample.where("use = 'fit'").select("toxic", "text").mapInArrow(_class_counts, "run string, toxic long, plain long")
    counts = counts.groupBy("run").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain")).withColumn("g", F.expr("substring(run, 2)"))
    rows = counts.join(shared_backoff(texts), "g").select("run", "toxic", "plain", "p")
    got = rows.toArrow().to_pydict()  # every sequence of at most toxic_docs + ordinary_docs texts
    model = spark.sparkContext.broadcast(WordRatios.fit(list(zip(got["run"], got["toxic"], got["plain"], got["p"], strict=True))))
    tune = sample.where("use = 'tune'").select("toxic", "text").mapInArrow(_figures(model), "toxic long, x array<double>").collect()
    x, y = np.array([r["x"] for r in tune]), np.array([r["toxic"] for r in tune], float)
    order = np.lexsort([*x.T, y])  # sums in one order, whatever order the rows came in
    x, y = x[order], y[order]
    mean, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
    weights = logistic((x - mean) / scale, y)
    scored = texts.mapInArrow(_scorer(model, (mean, scale, weights)), ", ".join(["doc_id long", *[f"{c} long" for c in row], "score double"]))
    return scored.select("doc_id", held_out, "score", (F.col("score") >= cut).cast("int").alias("predicted"), *row)


def filter_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, each by its own text, whatever rows share its id."""
    rows, key = keyed(docs, "toxicity-rows")
    gone = settled(lambda: score(rows, labels, row_col=key, **options).where("predicted = 1").select(F.col(key).alias("_id")), "toxic")
    return keep_rows(rows, gone, "left_anti", key).drop(key)
