import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from ravelin.llm import pii, toxicity
from ravelin.llm.queries import op4_pii

from .conftest import AWKWARD

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in twice) % 10 == 0


def base_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), n, kind, m.end()))
    return sorted(out)


TEXTS = [
    "a@b.c_d@e.f x@y.z.w. mail: foo@bar.com,foo@@bar.com a@b@c.d",
    "1.2.3.4.5 300.1.1.1 001.002.003.004 1.2.3 0000000255.1.2.3 9999999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 378282246310005, 4 1 1 1",
    "+1 (743) 555-3824. +49 30 1234 +1+22334455667 +12.",
    "é😀 +33 1 23 45 67 89 12 😀a@b.co 日1.2.3.4",
    "reach joe (at) site (dot) com, ssn 123-45-6789, call 415-555-2671 now",
    "1" * 30_000,
    "12 " * 5_000,
    "a" * 50_000 + "@",
    "1." * 20_000,
    *AWKWARD,
]


def test_base_spans_match_the_patterns(docs):
    from .conftest import rows

    data = [*rows(*TEXTS), (None, "x@y.zz", "en", "s", 1, *"xyzkf")]
    got = {r.doc_id: [(s.start, s.order, s.kind, s.end) for s in r.spans if s.base] for r in pii.find(docs(data)).collect()}
    assert got == {r[0]: base_spans(r[1]) for r in data}


def test_added_spans_touch_no_base_span_and_the_query_counts_base_spans(spark, empty):
    path = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    for r in op4_pii(spark, path).collect():
        want = Counter(s[2] for s in base_spans(texts[r.doc_id]))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(want[k] for k in pii.BASE_KINDS)
    assert pii.find(empty).count() == 0


def test_estimates_trust_labelers_that_agree():
    rng = np.random.default_rng(0)
    counts = Counter()
    for _ in range(5000):
        truth = rng.random() < 0.4
        vote = lambda right, t=truth: 1 if (rng.random() < right) == t else -1
        counts[vote(0.95), vote(0.9), vote(0.85), vote(0.5), 0] += 1
    prior, reliability = pii.estimate([("card", v, n) for v, n in counts.items()])
    weight = [r[1] - r[-1] for r in reliability]
    assert weight[0] > weight[2] > 1 > abs(weight[3])
    assert abs(1 / (1 + np.exp(-prior["card"])) - 0.4) < 0.1


def test_the_span_classifier_learns_from_soft_labels():
    rows = [((0, 0, s, 0, 0, near), 0.9 if near == 2 else 0.2, 50) for s in range(4) for near in (1, 2)]
    intercept, weights = pii.train(rows, rounds=2000)
    z = lambda values: intercept + sum(w[v] for w, v in zip(weights, values, strict=True))
    assert z((0, 0, 1, 0, 0, 2)) > 1 and z((0, 0, 1, 0, 0, 1)) < -0.5


def fold(i):
    return zlib.crc32(str(i).encode()) % 4


@pytest.fixture
def corpus(spark):
    rng = np.random.default_rng(7)
    plain = ["".join(rng.choice(list("aeioustrn"), rng.integers(2, 7))) for _ in range(400)]
    rude = ["vexgrub", "vexmold", "vexslug", "vexworm"]
    docs, labels = [], []
    for i in range(1200):
        toxic = i % 6 == 0
        words = list(rng.choice(plain, rng.integers(20, 200)))
        if toxic:
            for w in rng.choice(rude, 4):
                words.insert(int(rng.integers(len(words))), w)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs += [(5000, None), (5001, ""), (None, "vexworm " * 3)]
    labels += [(None, 1, 1), (9999, 0, 1), (3, 1, None)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_apart(corpus):
    docs, labels = corpus
    got = toxicity.score(docs, labels).collect()
    assert len(got) == 1203 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 1200 and r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(1200) if fold(i) == 2}
    wrong = [r.doc_id for r in held if r.predicted != (r.doc_id % 6 == 0)]
    assert len(wrong) <= 0.02 * len(held)
    kept = toxicity.filter_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def test_held_out_labels_are_not_learnt(corpus, spark):
    docs, labels = corpus
    pdf = labels.toPandas()
    at = pdf.doc_id.map(lambda i: not pd.isna(i) and fold(int(i)) == 2)
    pdf.loc[at, "toxic"] = 1 - pdf.loc[at, "toxic"]
    flipped = spark.createDataFrame([tuple(None if pd.isna(v) else int(v) for v in r) for r in pdf.itertuples(index=False)], labels.schema)
    assert sorted(map(str, toxicity.score(docs, labels).collect())) == sorted(map(str, toxicity.score(docs, flipped).collect()))


def test_scores_without_both_classes_are_the_rate(corpus, spark):
    docs, labels = corpus
    got = toxicity.score(docs, labels.where("toxic = 0")).select("score", "predicted").distinct().collect()
    assert [tuple(r) for r in got] == [(0.0, 0)]
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_backoff_is_a_distribution(spark):
    docs = spark.createDataFrame([("the cat sat on the mat",), ("a cat and a rat",)], "text string")
    p = {r.g: r.p for r in toxicity.shared_backoff(docs).collect()}
    assert sum(v for g, v in p.items() if len(g) == 1) == pytest.approx(1)
    letters = [g for g in p if len(g) == 1]
    for h in ("a", "at", "ca"):
        lower = lambda g: p.get(g, None)
        seen = [p[h + c] for c in letters if h + c in p]
        unseen = [c for c in letters if h + c not in p]
        assert sum(seen) <= 1 + 1e-9 and (not unseen or sum(seen) < 1) and lower("t") > 0
