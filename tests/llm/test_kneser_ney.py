"""Scores against Kneser-Ney models, figures and logistic regression written out in plain Python."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from ravelin.llm import toxicity

from .conftest import AWKWARD
from .test_text import fold


def runs(word):
    """(context, letter) of every letter and of the word's end, with up to four letters of context."""
    w = "<" + word + ">"
    return [(w[max(0, i - 4) : i], w[i]) for i in range(1, len(w))]


def words(text):
    return [w.replace("<", "").replace(">", "") for w in re.findall(r"\w+", (text or "").lower())]


class Model:
    def __init__(self, texts, toxic, plain):
        # Continuations: distinct sequences of all documents, and their endings.
        longest = {h + c for t in texts for w in set(words(t)) for h, c in runs(w)}
        endings = {s[-m:] for s in longest for m in range(2, len(s) + 1)}
        self.n = Counter(s[1:] for s in endings)
        self.s, self.u = Counter(), Counter()
        for g, n in self.n.items():
            self.s[g[:-1]] += n
            self.u[g[:-1]] += 1
        self.own = []
        for group in (toxic, plain):
            table = defaultdict(Counter)
            for t in group:
                for w in words(t):
                    for h, c in runs(w):
                        table[h][c] += 1
            self.own.append(table)
        self.known = {(h, c) for table in self.own for h, cs in table.items() for c in cs}

    def back(self, h, c):
        """Interpolated probability of `c` after up to three letters."""
        n, s, u = self.n[h + c], self.s[h], self.u[h]
        if not h:
            return (n + 0.5) / (s + 0.5 * u)
        return (max(n - 0.75, 0) + 0.75 * u * self.back(h[1:], c)) / s

    def ratio(self, word):
        total = 0.0
        for h, c in runs(word):
            logs = []
            for table in self.own:
                count, all_, kinds = table[h][c], sum(table[h].values()), sum(1 for v in table[h].values() if v)
                left = 0.75 * kinds / all_ if all_ else 1.0
                if (h, c) in self.known:
                    logs.append(math.log((max(count - 0.75, 0) / all_ if all_ else 0.0) + left * self.back(h[1:], c)))
                else:  # what both classes lack cancels out but for their discounts
                    logs.append(math.log(left) if any(h == k for k, _ in self.known) else 0.0)
            total += logs[0] - logs[1]
        return total

    def figures(self, text):
        ws = words(text)
        if not ws:
            return [0.0] * 5
        r = [self.ratio(w) for w in ws]
        wide = min(32, len(r))
        best = sorted({w: x for w, x in zip(ws, r, strict=True)}.values(), reverse=True)[:4]
        return [sum(r) / len(r), max(sum(r[i : i + wide]) for i in range(len(r) - wide + 1)) / wide, sum(best) / 4, sum(max(x - 2, 0) for x in r) / math.sqrt(len(r)), math.log(len(r))]


def test_scores_are_those_of_plain_python(spark):
    rng = np.random.default_rng(5)
    plain = ["".join(rng.choice(list("aeioustrné"), rng.integers(2, 7))) for _ in range(80)]
    rude, data, labels = ["vexgrub", "vexmold", "zornik"], [], []
    for i in range(160):
        ws = list(rng.choice(plain, rng.integers(3, 60))) + (list(rng.choice(rude, 3)) if i % 4 == 0 else [])
        data.append((i, (", ".join(ws) if i % 3 else " ".join(ws).upper()) + (" 日本 x²y_z" if i % 10 == 0 else "")))
        labels.append((i, int(i % 4 == 0)))
    data += [(900, None), (901, ""), (902, "?!")]
    docs, marks = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, marks).collect()}
    of = {k: [t for (i, t), (_, y) in zip(data, labels, strict=False) if fold(i) < 2 and y == k] for k in (0, 1)}
    model = Model([t for _, t in data], of[1], of[0])
    tune = [(model.figures(t), y) for (i, t), (_, y) in zip(data, labels, strict=False) if fold(i) == 3]
    x, y = np.array([f for f, _ in tune]), np.array([y for _, y in tune], float)
    mean, scale = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
    z = (x - mean) / scale
    w, b = np.zeros(5), 0.0
    for _ in range(400):  # plain Newton steps on the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30)))
        full = np.hstack([z, np.ones((len(z), 1))])
        keep = np.diag([1.0] * 5 + [1e-6])
        step = np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + keep, full.T @ (y - p) - keep @ np.append(w, b))
        step /= max(1.0, np.abs(step).max() / 5)
        w, b = w + step[:5], b + step[5]
    for i, t in data:
        want = 1 / (1 + math.exp(-max(-30.0, min(30.0, float((np.array(model.figures(t)) - mean) / scale @ w + b)))))
        assert got[i].score == pytest.approx(want, abs=1e-9), i
        assert got[i].predicted == int(got[i].score >= 0.3) and got[i].held_out == (fold(i) == 2)


def test_words_are_split_as_the_pattern_does():
    texts = [*AWKWARD, "a_b c-d É.ß x²³¹¼ ªº µ·÷×", "ſ İ ΣΑΣ x", "\x1fa\x00b c", "don't 12.5%"]
    got = []
    for known, each in toxicity.split_words(pa.array(texts, pa.string())):
        got += [[known[i] for i in w] for w in each]
    assert got == [re.findall(r"\w+", (t or "").lower()) for t in texts]


def test_different_texts_of_a_labelled_id_give_one_result(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("aeiou"), 4))
    data = [(i, " ".join([word() for _ in range(20)] + (["vexgrub"] * 3 if i % 3 == 0 else []))) for i in range(120)]
    data += [(i, f"other text {i} {word()}") for i in range(0, 120, 2)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    out = [sorted((r.doc_id, round(r.score, 12)) for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), labels).collect()) for rows, n in ((data, 2), (data[::-1], 7))]
    assert out[0] == out[1]
