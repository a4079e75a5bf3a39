"""Spans of personal data against a brute-force version of candidates, votes, features and decision."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from ravelin.llm import pii

from .conftest import rows
from .test_text import BASE, TEXTS, base_spans, luhn

HEX = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


def texts(n=300):
    """Prose with planted secrets, numbers and things that only look like them."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("aeioustrn"), rng.integers(2, 8)))
    digest = lambda size=40: "".join(rng.choice(list("0123456789abcdef"), size))
    digits = lambda size: "".join(rng.choice(list("0123456789"), size))
    plants = [
        lambda: f'token = "{digest()}"', lambda: f"password: {word()}{digest(20)}", lambda: f"commit {digest()}", lambda: f"sha256 {digest(64)}", lambda: f"account {digits(16)}", lambda: f"ssn {digits(3)}-{digits(2)}-{digits(4)}",
        lambda: f"call {digits(3)}-{digits(3)}-{digits(4)}", lambda: f"mail {word()} (at) {word()} (dot) com", lambda: f"{word()}@{word()}.org", lambda: f"+49 30 {digits(7)}", lambda: f"ip 10.{int(rng.integers(300))}.3.4", lambda: f"konto DE{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}",
        lambda: f"page {digits(13)}", lambda: f"uuid 550e8400-e29b-41d4-a716-{digits(12)}", lambda: "",
    ]
    return [" ".join([*(word() for _ in range(rng.integers(1, 12))), plants[i % len(plants)](), *(word() for _ in range(rng.integers(0, 6)))]) for i in range(n)]


def mod97(text):
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def candidates(text):
    text = text or ""
    base = [(k, 0, a, b) for a, _, k, b in base_spans(text)]
    wide = [(k, 1, m.start(), m.end()) for k, p in pii._WIDER.items() for m in re.finditer(p, text)]
    free = [w for w in wide if not any(a < w[3] and w[2] < b for _, _, a, b in base)]
    return base + free


def votes(text, kind, a, b, ends):
    """Five votes. Contexts end at the neighbouring matches of the same pattern."""
    span, digits = text[a:b], re.sub("[^0-9]", "", text[a:b])
    before, after = text[max(a - 24, ends[0]) : a], text[b : min(b + 24, ends[1])]
    has = lambda p, s: re.search(p, s) is not None
    form = {
        "email": lambda: has(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*(?:@|\x20?[(\[{]at[)\]}]).*[.)\]}]\x20?[A-Za-z]{2,}$", span),
        "ip": lambda: not has(r"(^|\.)0[0-9]|^0\.", span),
        "card": lambda: has(r"^[0-9]{12,19}$|^[0-9]{4}([ -][0-9]{4}){3}$|^[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}$", span),
        "phone": lambda: has(r"^[^()]*(\([0-9]+\)[^()]*)?$", span),
        "id": lambda: span[:3] not in ("000", "666") and span[0] != "9",
        "iban": lambda: mod97(span) == 1,
        "account": lambda: len(span) in (12, 14, 15, 16, 18),
        "secret": lambda: (len(span) in (32, 40, 64) and has(r"^([0-9a-f]+|[0-9A-F]+)$", span)) or (len(span) >= 24 and "-" not in span and any(c.islower() for c in span) and any(c.isupper() for c in span)),
    }[kind]()
    listed = {
        "email": lambda: re.search("[A-Za-z0-9-]+$", span) and re.search("[A-Za-z0-9-]+$", span)[0].lower() in pii._TOP_DOMAINS,
        "card": lambda: digits.startswith(tuple(pii._CARD_ISSUERS)),
        "phone": lambda: (span[0] == "+" and digits.startswith(tuple(pii._CALLING_CODES))) or has(r"^\(?[2-9]", span),
        "iban": lambda: span[:2] in pii._IBAN_COUNTRIES,
        "account": lambda: digits.startswith(tuple(pii._CARD_ISSUERS)),
        "secret": lambda: span.startswith(tuple(pii._SECRET_STARTS)),
    }.get(kind, lambda: False)()
    against = has(pii._HASHES if kind == "secret" else pii._AGAINST, before)
    near = -1 if against else int(has(pii._FOR[kind], before if kind == "secret" else before + " " + after))
    beside = has(r"\w$", before) or has(r"^\w", after)
    given = has(r"[=:]\s{0,2}[\"'`]?$|[\"'`]$", before)
    joined = -1 if beside else 0 if kind == "secret" and not given else 1
    dull = len(set(span)) < 9 if kind == "secret" else has(r"([0-9])\1{5}|012345|123456", digits)
    letters, number = has("[A-Za-z]", span), has("[0-9]", span)
    side = lambda c: 0 if not c or c.isspace() else 2 if c.isalnum() else 1
    mix = 0 if not letters else 1 if not number else 2
    return (1 if form else -1, int(bool(listed)), near, joined, -int(dull)), (pii.KINDS.index(kind), min(3, (b - a) // 8), side(before[-1:]), side(after[:1]), mix)


def brute(data):
    """Spans of each text as (start, kind order, kind, end)."""
    spans = []
    for n, text in enumerate(data):
        text = text or ""
        matches = {(k, w): [(m.start(), m.end()) for m in re.finditer(p, text)] for w, t in enumerate((BASE, pii._WIDER)) for k, p in t.items()}
        for kind, wide, a, b in candidates(text):
            same = matches[kind, wide]
            ends = max([e for _, e in same if e <= a], default=0), min([s for s, _ in same if s >= b], default=len(text))
            v, (k, size, left, right, mix) = votes(text, kind, a, b, ends)
            spans.append((n, kind, wide, a, b, v, (k, wide, size, left, right, mix)))
    out = defaultdict(list)
    for kind in pii.KINDS:
        mine = [s for s in spans if s[1] == kind]
        counts = Counter(s[5] for s in mine)
        prior, tables = pii.estimate([(kind, v, n) for v, n in sorted(counts.items())])
        q = {v: 1 / (1 + math.exp(-prior[kind] - sum(t[x] for t, x in zip(tables, v, strict=True)))) for v in counts}
        forms = defaultdict(list)
        for s in mine:
            forms[s[6]].append(q[s[5]])
        intercept, weights = pii.train([(f, sum(p) / len(p), len(p)) for f, p in sorted(forms.items())])
        for n, _, wide, a, b, _, f in mine:
            p = 1 / (1 + math.exp(-intercept - sum(w[x] for w, x in zip(weights, f, strict=True))))
            if not wide or p >= 0.5:
                out[n].append((a, pii.KINDS.index(kind), kind, b))
    return {n: sorted(out[n]) for n in range(len(data))}


@pytest.mark.parametrize("data", [texts(), [*(t for t in TEXTS if len(t or "") < 10_000), *texts(60)]], ids=["prose", "awkward"])
def test_spans_are_those_of_brute_force(docs, data):
    got = {r.doc_id: [(s.start, s.order, s.kind, s.end) for s in r.spans] for r in pii.find(docs(rows(*data))).collect()}
    want = brute(data)
    assert got == want
    assert sum(s[2] == "secret" for spans in want.values() for s in spans) > 0


def test_secrets_are_found_and_digests_are_left(docs):
    data = texts(600)
    found = {r.doc_id: {s.kind for s in r.spans} for r in pii.find(docs(rows(*data))).collect()}
    planted = [i for i, t in enumerate(data) if "token = " in t]
    assert sum("secret" in found[i] for i in planted) >= 0.9 * len(planted)
    assert not any("secret" in found[i] for i, t in enumerate(data) if "commit " in t or "uuid " in t or "sha256 " in t)
    numbers = [i for i, t in enumerate(data) if "account " in t]
    assert sum(bool({"account", "card"} & found[i]) for i in numbers) >= 0.9 * len(numbers)


def test_planted_documents_are_found_and_others_left_alone(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    table = spark.read.parquet(path)
    whole = {r.doc_id: r.text or "" for r in table.select("doc_id", "text").collect()}
    found = {r.doc_id: r.spans for r in pii.find(table).collect()}
    planted = {i for i, t in whole.items() if re.search(r'(?i)token = "[0-9a-f]{40}"|[0-9]{16}|@mail', t)}
    assert len(planted) > 10 and sum(bool(found[i]) for i in planted) >= 0.9 * len(planted)
    bare = {i for i, t in whole.items() if not re.search("[0-9@]", t)}
    assert not any(found[i] for i in bare)


def test_iban_remainder_and_starts(spark):
    from pyspark.sql import functions as F

    good = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR1420041010050500013M02606"]
    df = spark.createDataFrame([(g,) for g in [*good, "DE88 3704 0044 0532 0130 00"]], "t string")
    assert [r.m for r in df.select(pii._mod97(F.col("t")).alias("m")).collect()] == [mod97(t) for t in [*good, "DE88 3704 0044 0532 0130 00"]]
    assert [mod97(t) for t in good] == [1, 1, 1] and luhn("4111111111111111")
