"""Stages decide row by row: null and repeated ids against brute force."""

from collections import Counter, defaultdict

import numpy as np
from ravelin.llm import exact_dedup, mixing, simhash, toxicity

from .test_dedup import SPACE, brute_print, classes


def table(docs, texts, sources=("a", "b")):
    """A third of the rows has no id, a third shares one id, the others repeat few; `lang` numbers the rows."""
    ids = [None if i % 3 == 0 else 7 if i % 3 == 1 else i // 6 for i in range(len(texts))]
    return docs([(k, t, str(i), sources[i % len(sources)], len(t or ""), *"xyzkf") for i, (k, t) in enumerate(zip(ids, texts, strict=True))]), ids


def one_of_each(out, groups, ids):
    """Each group keeps one row, which has its smallest id, null last."""
    kept = Counter(groups[int(r.lang)] for r in out)
    assert kept == dict.fromkeys(groups.values(), 1)
    members = defaultdict(list)
    for i, g in groups.items():
        members[g].append((ids[i] is None, ids[i] or 0))
    assert all((r.doc_id is None, r.doc_id or 0) == min(members[groups[int(r.lang)]]) for r in out)


def test_exact_copies(docs):
    texts = [f"text  {i % 17}" if i % 2 else f"text {i % 17}" for i in range(90)]
    df, ids = table(docs, texts)
    one_of_each(exact_dedup.dedup(df).collect(), {i: SPACE.sub(" ", t) for i, t in enumerate(texts)}, ids)


def test_near_copies(docs):
    rng = np.random.default_rng(4)
    words, texts = [f"w{i}" for i in range(60)], []
    for _ in range(30):
        base = list(rng.choice(words, 80))
        texts += [" ".join(base), " ".join([*base[:-1], "changed"]), " ".join(rng.choice(words, 80))]
    texts = [texts[i] for i in rng.permutation(90)]
    df, ids = table(docs, texts)
    prints = [brute_print(t) for t in texts]
    groups = classes(range(90), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert len(set(groups.values())) < 90
    one_of_each(simhash.dedup(df, shard=8).collect(), groups, ids)


def test_mixing(docs):
    df, ids = table(docs, ["w " * (i * i % 11) for i in range(120)], ("a", "a", "b", "c"))
    plan, out = mixing.plan(df).collect(), mixing.mix(df).collect()
    assert any(r.copies == 0 and r.doc_id is None for r in plan)
    want = Counter()
    for r in plan:
        want[r.doc_id, r.source, r["size"]] += r.copies
    assert Counter((r.doc_id, r.source, len(r.text.split())) for r in out) == +want
    # Every row is taken the whole part of its rate, or once more.
    rate = {r.source: r.target / r.source_size for r in plan}
    times = Counter(r.lang for r in out)
    assert all(abs(times[r.lang] - rate[r.source]) < 1 for r in df.collect())


def test_toxic_rows(spark):
    rng = np.random.default_rng(7)
    plain = ["".join(rng.choice(list("aeioustrn"), rng.integers(2, 7))) for _ in range(200)]
    rude, data, labels = ["vexgrub", "vexmold", "vexslug"], [], []
    for i in range(400):
        words = list(rng.choice(plain, 40)) + (list(rng.choice(rude, 4)) if i % 4 == 0 else [])
        data.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    odd = [data[i][1] for i in range(12)]
    # The same texts with ids of their own, with none, and with one id.
    data += [(k, t) for i, t in enumerate(odd) for k in (1000 + i, None, 2000)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    bad = {odd[r.doc_id - 1000] for r in toxicity.score(docs, labels).where("doc_id BETWEEN 1000 AND 1999 AND predicted = 1").collect()}
    assert 0 < len(bad) < len(odd)
    kept = Counter((r.doc_id, r.text) for r in toxicity.filter_toxic(docs, labels).collect() if r.doc_id is None or r.doc_id >= 1000)
    assert kept == Counter(r for r in data[400:] if r[1] not in bad)
