"""The letter models are fitted on every sequence of the fitted documents."""

import numpy as np
from ravelin.llm import toxicity

from .test_text import fold


def test_no_sequence_is_cut(spark, monkeypatch):
    rng = np.random.default_rng(1)
    letters = rng.integers(0x4E00, 0x9F00, (240, 560, 6))
    data = [(i, " ".join("".join(map(chr, w)) for w in text)) for i, text in enumerate(letters.tolist())]
    want = {run for i, text in data if fold(i) < 2 for word in text.split() for run in toxicity.letter_runs(word)}
    assert len(want) > 400_000
    got, fit = [], toxicity.WordRatios.fit

    def spy(rows):
        got.extend(r[0] for r in rows)
        return fit(rows)

    monkeypatch.setattr(toxicity.WordRatios, "fit", spy)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in data], "doc_id long, toxic int")
    assert toxicity.score(docs, labels).count() == len(data)
    assert len(got) == len(want) and set(got) == want
