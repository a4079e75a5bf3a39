r"""Personal data by weak supervision, in DataFrame functions alone.

Patterns propose spans. Labelers of three kinds vote on each: regular
expressions on the span's form, gazetteers of its parts, and words and
characters around it. Votes are +1, 0 (abstains) or -1. Expectation
maximisation over the counts of vote patterns estimates, kind by kind and
without any labels, how reliable each labeler is, and its posteriors train a
logistic classifier of spans over their form and the characters beside them.
The base patterns' spans always stay; the classifier decides on the spans of
the wider patterns: addresses spelt out, numbers as they are dialled at home,
identity and bank account numbers, long numbers and secrets.

Counts of vote and feature patterns are at most VOTE_PATTERNS and
FEATURE_PATTERNS rows by construction, whatever the size of the corpus; only
they reach the driver. A pattern is looked for only in texts that hold a
character or a digit that it needs. Patterns are written so that Java matches
them without recursion or repeated scans: repeats are possessive, and a start
inside a run that has failed once is not tried again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.llm.base import stage

#: Base kinds in the order in which spans at one place are listed, then the added kinds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "id", "iban", "account", "secret")
_LOCAL = "A-Za-z0-9._%+-"
_PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_KEY = "A-Za-z0-9_+-"
#: Wider patterns. A secret is a long run that holds letters and digits.
_WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\.)\x20?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+().\x20-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "id": r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9.-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3}+(?![A-Za-z0-9]))?+(?![A-Za-z0-9])",
    "account": rf"(?<![{_KEY}.])[0-9]{{12,19}}+(?![{_KEY}]|\.[0-9])",
    "secret": rf"(?<![{_KEY}])(?=[A-Za-z_+-]*+[0-9])(?=[0-9_+-]*+[A-Za-z])[{_KEY}]{{20,}}+={{0,2}}+",
}
#: What a text must hold for a pattern to match; other patterns need a digit.
_NEEDS = {("email", 0): "@", ("phone", 0): "+", ("email", 1): "at"}
#: Characters of context on each side.
CONTEXT = 24

# Gazetteers and context words in English, German, French and Spanish.
_TOP_DOMAINS = (
    "com org net edu gov mil int info biz name io dev app ai me tv cc eu de at ch li fr be lu mc es pt it nl uk ie dk se no fi is pl cz sk hu ro bg gr tr ru ua us ca mx gt sv hn ni cr pa cu do pr co ve ec pe bo cl ar uy py br au nz jp kr cn tw hk sg in za ma dz tn eg ke ng"
).split()
_CARD_ISSUERS = "4 51 52 53 54 55 22 23 24 25 26 27 34 37 36 38 300 301 302 303 304 305 35 50 56 57 58 6011 644 645 646 647 648 649 65 60 62 63 67 81".split()
_CALLING_CODES = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 211 212 213 216 218 220 221 225 233 234 237 243 249 251 254 255 256 260 263 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 380 381 385 386 387 389 420 421 423 500 501 502 503 504 505 506 507 509 591 593 595 598 852 853 855 880 886 960 961 962 963 964 965 966 967 968 971 972 973 974 975 976 977 992 993 994 995 996 998"
).split()
_IBAN_COUNTRIES = "AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split()
_SECRET_STARTS = "sk_ pk_ rk_ ghp_ gho_ ghs_ github_pat_ glpat- xoxb- xoxp- AKIA ASIA AIza ya29 eyJ hf_ npm_ pypi- SG shpat_ dop_v1_".split()
_FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|kontakt|schreib\w*|courriel|écri\w*|correo|escrib\w*)\b",
    "ip": r"(?i)\b(?:ip|host|server|client|login|address|adresse|serveur|servidor|direcci[oó]n)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|karte|carte|tarjeta|pay\w*|zahl\w*)\b",
    "phone": r"(?i)\b(?:tel|phone|call|mobile|fax|telefon|anruf\w*|t[eé]l[eé]phone|appel\w*|tel[eé]fono|llam\w*)\b",
    "id": r"(?i)\b(?:ssn|social|security|passport|ausweis|num[eé]ro|identit\w*|identidad|dni|id)\b",
    "iban": r"(?i)\b(?:iban|bank|konto|compte|cuenta|account|transfer|überweis\w*|virement)\b",
    "account": r"(?i)\b(?:account|card|konto\w*|karte\w*|compte|carte|cuenta|tarjeta|bank\w*|customer|kunde\w*|client\w*)\b",
    "secret": r"(?i)(?:token|secret|passw\w*|passphrase|api[_-]?key|access[_-]?key|private[_-]?key|auth\w*|bearer|credential\w*|pwd)",
}
_AGAINST = r"(?i)\b(?:version|ver|isbn|issn|page|seite|página|order|invoice|rechnung|facture|factura|total|ref|build|chapter|section)\W*$"
_HASHES = r"(?i)(?:commit|sha-?[0-9]*|md5|checksum|digest|revision|hash|etag|uuid|guid|version|build)\W*$"

VOTE_PATTERNS = len(KINDS) * 3**5
FEATURE_SIZES = {"kind": len(KINDS), "wide": 2, "size": 4, "left": 3, "right": 3, "mix": 3}
FEATURE_PATTERNS = math.prod(FEATURE_SIZES.values())


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _mod97(text: Column) -> Column:
    """Remainder of an IBAN, its first four characters put last and letters read as 10 to 35."""
    plain = F.regexp_replace(text, r"\x20", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.left(plain, F.lit(4)))

    def add(left: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 58, left * 10 + code - 48).otherwise(left * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add)


def _holds(kind: Column, text: Column, wide: Column) -> Column:
    """Whether a match of a base pattern passes the kind's check; wider matches have none."""
    byte = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"
    n = F.length(_digits(text))
    return (
        F.when(wide == 1, F.lit(True))
        .when(kind == "ip", text.rlike(rf"^{byte}(?:\.{byte}){{3}}$"))
        .when(kind == "card", F.when(n.between(12, 19), _luhn(_digits(text))).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(True)
    )


def _matches(text: Column, digit: Column, kind: str, wide: int, pattern: str) -> Column:
    """Matches as (kind, wide, i, gap, before, after, text); the last has no text, only what follows.

    The pieces between matches give the places: a start is the sum of the gaps
    up to it and of the matches before it.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.struct(F.length(p).alias("gap"), F.right(p, F.lit(CONTEXT)).alias("before"), F.left(p, F.lit(CONTEXT)).alias("after")))
    both = F.arrays_zip(gaps.alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("t"))
    rows = F.transform(both, lambda z, i: F.struct(F.lit(kind).alias("kind"), F.lit(wide).alias("wide"), i.alias("i"), z["g"]["gap"].alias("gap"), z["g"]["before"].alias("before"), z["g"]["after"].alias("after"), z["t"].alias("text")))
    needs = _NEEDS.get((kind, wide))
    may = text.contains(needs) if needs else digit
    return F.when(may & text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<kind:string,wide:int,i:int,gap:int,before:string,after:string,text:string>>"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, kind, wide, start, end, text, before, after); one row of nulls for a text without any."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).withColumn("row", F.monotonically_increasing_id()).withColumn("_digit", F.col("_t").rlike("[0-9]"))
    found = F.concat(*[_matches(F.col("_t"), F.col("_digit"), k, wide, p) for wide, table in enumerate((_PATTERNS, _WIDER)) for k, p in table.items()])
    flat = stage(base.select("row", "doc_id", F.explode_outer(found).alias("m")).select("row", "doc_id", "m.*"), "pii-matches").repartition("row")
    one = Window.partitionBy("row", "kind", "wide").orderBy("i")
    placed = flat.withColumn("start", F.sum("gap").over(one) + F.coalesce(F.sum(F.length("text")).over(one.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("after", F.lead("after").over(one))
    placed = placed.withColumn("end", F.col("start") + F.length("text"))
    good = F.col("text").isNotNull() & F.coalesce(_holds(F.col("kind"), F.col("text"), F.col("wide")), F.lit(False))
    # A base span that holds; wider ones only where they touch none.
    own = good & (F.col("wide") == 0)
    line = Window.partitionBy("row").orderBy(F.col("start").asc_nulls_first(), F.col("wide"), F.col("kind"), F.col("i"))
    before = F.max(F.when(own, F.col("end"))).over(line.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(own, F.col("start"))).over(line.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(before, F.lit(-1)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    keep = own | (good & (F.col("wide") == 1) & free)
    first = F.row_number().over(line) == 1
    marked = placed.withColumn("_keep", F.coalesce(keep, F.lit(False))).withColumn("_first", first).where("_keep OR _first")
    blank = lambda c: F.when(F.col("_keep"), F.col(c)).alias(c)
    return marked.select("row", "doc_id", *[blank(c) for c in ("kind", "wide", "start", "end", "text", "before", "after")])


def _by_kind(table: dict[str, Column], otherwise: Column) -> Column:
    out = None
    for kind, value in table.items():
        out = (F.when if out is None else out.when)(F.col("kind") == kind, value)
    return out.otherwise(otherwise)


def _starts(text: Column, starts: list[str]) -> Column:
    """Whether `text` begins with an entry of a gazetteer; entries are looked up by their length."""
    known: dict[int, list[str]] = {}
    for start in starts:
        known.setdefault(len(start), []).append(start)
    out = F.lit(False)
    for size, entries in known.items():
        out = out | F.left(text, F.lit(size)).isin(entries)
    return out


def _votes() -> dict[str, Column]:
    """The labelers' votes on a candidate."""
    kind, text, before, after = F.col("kind"), F.col("text"), F.col("before"), F.coalesce("after", F.lit(""))
    digits, letter = _digits(text), r"[\p{L}\p{N}_]"
    form = _by_kind(
        {
            "email": text.rlike(r"^[A-Za-z0-9](?:[A-Za-z0-9._%+-]*+)(?:@|\x20?[(\[{]at[)\]}]).*[.)\]}]\x20?[A-Za-z]{2,}+$"),
            "ip": ~text.rlike(r"(?:^|\.)0[0-9]|^0\."),
            "card": text.rlike(r"^[0-9]{12,19}$|^[0-9]{4}(?:[\x20-][0-9]{4}){3}$|^[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}$"),
            "phone": text.rlike(r"^[^()]*+(?:\([0-9]+\)[^()]*+)?$"),
            "id": ~text.rlike("^(?:000|666|9)"),
            "iban": F.when(kind == "iban", _mod97(text) == 1),
            "account": F.length(text).isin(12, 14, 15, 16, 18),
        },
        text.rlike(r"^(?:[0-9a-f]{32}|[0-9A-F]{32}|[0-9a-f]{40}|[0-9A-F]{40}|[0-9a-f]{64}|[0-9A-F]{64})$|^(?=[^a-z]*+[a-z])(?=[^A-Z]*+[A-Z])[^-]{24,}+$"),
    )
    listed = _by_kind(
        {
            "email": F.lower(F.regexp_extract(text, r"([A-Za-z0-9-]+)$", 1)).isin(_TOP_DOMAINS),
            "card": _starts(digits, _CARD_ISSUERS),
            "phone": (text.startswith("+") & _starts(digits, _CALLING_CODES)) | text.rlike(r"^\(?[2-9]"),
            "iban": F.left(text, F.lit(2)).isin(_IBAN_COUNTRIES),
            "account": _starts(digits, _CARD_ISSUERS),
            "secret": _starts(text, _SECRET_STARTS),
        },
        F.lit(False),
    )
    around = F.concat(before, F.lit(" "), after)
    for_it = _by_kind({k: (before if k == "secret" else around).rlike(p) for k, p in _FOR.items()}, F.lit(False))
    against = F.when(kind == "secret", before.rlike(_HASHES)).otherwise(before.rlike(_AGAINST))
    near = F.when(against, -1).when(for_it, 1).otherwise(0)
    beside = before.rlike(letter + "$") | after.rlike("^" + letter)
    given = before.rlike(r"[=:]\s{0,2}[\"'`]?$|[\"'`]$")
    joined = F.when(beside, -1).when((kind == "secret") & ~given, 0).otherwise(1)
    dull = F.when(kind == "secret", F.size(F.array_distinct(F.split(text, ""))) < 9).otherwise(digits.rlike(r"([0-9])\1{5}|012345|123456"))
    made_up = F.when(F.coalesce(dull, F.lit(False)), -1).otherwise(0)
    return {
        "form": F.when(F.coalesce(form, F.lit(False)), 1).otherwise(-1),
        "listed": F.when(F.coalesce(listed, F.lit(False)), 1).otherwise(0),
        "near": near,
        "joined": joined,
        "made_up": made_up,
    }


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 25) -> tuple[dict[str, float], list[dict[int, float]]]:
    """EM over (kind, votes, count): log prior odds per kind, log vote odds per labeler.

    Starts from the majority of votes; estimates are smoothed by one vote.
    """
    def odds(post: list[float]) -> tuple[dict[str, float], list[dict[int, float]]]:
        prior: dict[str, float] = {}
        for kind in KINDS:
            mine = [(q * n, n) for (k, _, n), q in zip(patterns, post, strict=True) if k == kind]
            yes, all_ = sum(a for a, _ in mine) + 1, sum(b for _, b in mine) + 2
            prior[kind] = math.log(yes / (all_ - yes))
        reliability = []
        for at in range(len(patterns[0][1]) if patterns else 0):
            table = {}
            for vote in (-1, 0, 1):
                yes = sum(q * n for (_, v, n), q in zip(patterns, post, strict=True) if v[at] == vote) + 1
                no = sum((1 - q) * n for (_, v, n), q in zip(patterns, post, strict=True) if v[at] == vote) + 1
                table[vote] = math.log(yes / no)
            total_yes = sum(q * n for (_, _, n), q in zip(patterns, post, strict=True)) + 3
            total_no = sum((1 - q) * n for (_, _, n), q in zip(patterns, post, strict=True)) + 3
            reliability.append({vote: o - math.log(total_yes / total_no) for vote, o in table.items()})
        return prior, reliability

    post = [min(0.9, max(0.1, 0.5 + 0.2 * sum(v))) for _, v, _ in patterns]
    found = odds(post)
    for _ in range(rounds):
        prior, reliability = found
        post = [1 / (1 + math.exp(-max(-30.0, min(30.0, prior[k] + sum(r[x] for r, x in zip(reliability, v, strict=True)))))) for k, v, _ in patterns]
        found = odds(post)
    return found


def train(rows: list[tuple[tuple[int, ...], float, int]], rounds: int = 200) -> tuple[float, list[list[float]]]:
    """Logistic classifier over (feature values, mean posterior, count): intercept and a weight per value."""
    sizes = list(FEATURE_SIZES.values())
    intercept, weights = 0.0, [[0.0] * n for n in sizes]
    total = sum(n for _, _, n in rows) or 1
    for _ in range(rounds):
        slope, slopes = 0.0, [[0.0] * n for n in sizes]
        for values, q, n in rows:
            z = intercept + sum(w[v] for w, v in zip(weights, values, strict=True))
            e = (q - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) * n / total
            slope += e
            for g, v in zip(slopes, values, strict=True):
                g[v] += e
        intercept += slope
        for w, g in zip(weights, slopes, strict=True):
            for v in range(len(w)):
                w[v] += g[v] - 1e-3 * w[v]
    return intercept, weights


def _features() -> dict[str, Column]:
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    size = F.least(F.lit(3), F.floor(F.length("text") / 8)).cast("int")
    side = lambda c: F.when(c.rlike(r"[\p{L}\p{N}]"), 2).when(c.rlike(r"\s"), 0).otherwise(F.when(c == "", 0).otherwise(1))
    mix = F.when(~F.col("text").rlike("[A-Za-z]"), 0).when(~F.col("text").rlike("[0-9]"), 1).otherwise(2)
    return {"kind": kind, "wide": F.col("wide"), "size": size, "left": side(F.right("before", F.lit(1))), "right": side(F.left(F.coalesce("after", F.lit("")), F.lit(1))), "mix": mix}


def _lookup(values: list[list[float]], at: Column) -> Column:
    """Value `at` in the row of the span's kind."""
    flat = [float(v) for row in values for v in row]
    return F.element_at(F.array(*map(F.lit, flat)), F.col("f_kind") * len(values[0]) + at + 1)


def find(docs: DataFrame, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, spans.

    `spans` lists (start, order, kind, end, base, probability) by start, then
    kind; places count code points and `end` is exclusive. Base spans are all
    there, with the classifier's probability; other spans, which touch no base
    span, from `cut` on. Spans of different kinds may overlap; at one start
    they follow in the order of KINDS. A null or empty text has no spans; a
    very long one is scanned whole, in one pass for each pattern that it may
    hold. A null id is returned as null, repeated rows and ids each have their
    own spans, other columns, whatever they are called, are not read, and an
    empty table gives no rows.
    """
    votes = _votes()
    spans = candidates(docs, id_col, text_col)
    voted = spans.select("*", *[F.when(F.col("kind").isNotNull(), c).alias(n) for n, c in votes.items()])
    features = _features()
    seen = stage(voted.select("row", "doc_id", "kind", "wide", "start", "end", *votes, *[F.when(F.col("kind").isNotNull(), c).alias(f"f_{n}") for n, c in features.items()]), "pii-candidates")
    real = seen.where("kind IS NOT NULL")
    patterns = [(r["kind"], tuple(r[n] for n in votes), r["n"]) for r in real.groupBy("kind", *votes).agg(F.count("*").alias("n")).orderBy("kind", *votes).collect()]  # at most VOTE_PATTERNS
    fitted = [estimate([p for p in patterns if p[0] == kind]) for kind in KINDS]
    logit = _lookup([[prior[kind]] for kind, (prior, _) in zip(KINDS, fitted, strict=True)], F.lit(0))
    for at, name in enumerate(votes):
        logit = logit + _lookup([[tables[at][v] for v in (-1, 0, 1)] if tables else [0.0] * 3 for _, tables in fitted], F.col(name) + 1)
    groups = [f"f_{n}" for n in features]
    learnt = real.withColumn("q", 1 / (1 + F.exp(-logit))).groupBy(*groups).agg(F.avg("q").alias("q"), F.count("*").alias("n")).orderBy(*groups)
    soft = [(tuple(r[g] for g in groups), r["q"], r["n"]) for r in learnt.collect()]  # at most FEATURE_PATTERNS
    trained = [train([row for row in soft if row[0][0] == at]) for at in range(len(KINDS))]
    z = _lookup([[intercept] for intercept, _ in trained], F.lit(0))
    for at, name in enumerate(groups):
        z = z + _lookup([weights[at] for _, weights in trained], F.col(name))
    scored = seen.withColumn("probability", 1 / (1 + F.exp(-z)))
    stays = F.col("kind").isNotNull() & ((F.col("wide") == 0) | (F.col("probability") >= cut))
    span = F.struct("start", F.col("f_kind").alias("order"), "kind", "end", (F.col("wide") == 0).alias("base"), "probability")
    return scored.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.when(stays, span))).alias("spans")).drop("row")


def digest(spans: Column) -> Column:
    """`kind:start:end` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
