"""Sequence comparison by wavefronts over batches of pairs, and pruning of alike rows in rounds.

A table of cells depends on its upper and left neighbours, so the cells of an
anti-diagonal are computed together, and those of many pairs of like length
with them: a step is a handful of array operations, whatever the number of
pairs. Pairs are made distinct before they are aligned, and batches of pairs
spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.plans.staging import attach, shuffle_width, stage

#: Cells that a batch of pairs may have in all, and most pairs of a batch.
CELLS, PAIRS = 1 << 24, 512
#: Score and matches are one number: the score's units, shifted, plus matches.
_SHIFT = 24
_LOST = np.int64(-1) << 60
#: Diagonals between two looks at what a pair can still reach.
_LOOK = 32


def _codes(texts: Sequence[str], filler: int) -> np.ndarray:
    """Code points of the texts, a row each, filled to one width."""
    out = np.full((len(texts), max(map(len, texts), default=0)), filler, np.int64)
    for row, text in zip(out, texts, strict=True):
        row[: len(text)] = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return out


def _batches(a: Sequence[str], b: Sequence[str], per_cell: int = 1) -> Iterator[np.ndarray]:
    """Places of pairs of like lengths, as many as CELLS allows."""
    n, m = (np.array([len(x) for x in t], np.int64) for t in (a, b))
    order = np.lexsort((m, n))
    at = 0
    while at < len(order):
        to = at + 1
        widest = m[order[at]]
        while to < len(order) and to - at < PAIRS:
            wide = max(widest, m[order[to]])
            if (to + 1 - at) * (n[order[to]] + 1) * (wide + 1) * per_cell > CELLS:
                break
            widest, to = wide, to + 1
        yield order[at:to]
        at = to


def _same(x: np.ndarray, y: np.ndarray, k: int, low: int, high: int) -> np.ndarray:
    """Whether the letters of the cells (i, k - i), i from `low` to `high`, agree."""
    return x[:, low - 1 : high] == y[:, k - high - 1 : k - low][:, ::-1]


def linear_alignments(a: Sequence[str], b: Sequence[str], match: int = 2, mismatch: int = -1, gap: int = -2) -> list[tuple[int, int, int, list[int]]]:
    """(score, matches, aligned, map) of each pair: map holds b's position for each of a's, from 1, or 0.

    Ties prefer the diagonal, then a gap in `b`, then one in `a`.
    """
    out: list = [None] * len(a)
    for some in _batches(a, b):
        s, t = [a[i] for i in some], [b[i] for i in some]
        x, y = _codes(s, -1), _codes(t, -2)
        size, n, m = len(some), x.shape[1], y.shape[1]
        steps = np.zeros((size, n + 1, m + 1), np.uint8)
        ends = np.array([[len(p), len(q)] for p, q in zip(s, t, strict=True)])
        score = np.zeros(size, np.int64)
        before, last = np.zeros((size, n + 2), np.int64), np.zeros((size, n + 2), np.int64)
        for k in range(n + m + 1):
            now = np.full((size, n + 2), _LOST)
            if k <= m:
                now[:, 0] = gap * k
            if k <= n:
                now[:, k] = gap * k
            low, high = max(1, k - m), min(n, k - 1)
            if low <= high:
                across = before[:, low - 1 : high] + np.where(_same(x, y, k, low, high), match, mismatch)
                up, left = last[:, low - 1 : high] + gap, last[:, low : high + 1] + gap
                best = np.maximum(np.maximum(across, up), left)
                now[:, low : high + 1] = best
                i = np.arange(low, high + 1)
                steps[:, i, k - i] = np.where(best == across, 0, np.where(best == up, 1, 2))
            done = np.flatnonzero(ends.sum(1) == k)
            score[done] = now[done, ends[done, 0]]
            before, last = last, now
        i, j = ends[:, 0].copy(), ends[:, 1].copy()
        matches, aligned, places = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros((size, n + 1), np.int64)
        open_ = np.flatnonzero((i > 0) & (j > 0))
        while len(open_):
            step = steps[open_, i[open_], j[open_]]
            met = open_[step == 0]
            i[met] -= 1
            j[met] -= 1
            matches[met] += x[met, i[met]] == y[met, j[met]]
            aligned[met] += 1
            places[met, i[met]] = j[met] + 1
            i[open_[step == 1]] -= 1
            j[open_[step == 2]] -= 1
            open_ = open_[(i[open_] > 0) & (j[open_] > 0)]
        for p, where in enumerate(some):
            out[where] = int(score[p]), int(matches[p]), int(aligned[p]), places[p, : len(s[p])].tolist()
    return out


def linear_alignment(a: str, b: str, **costs: int) -> tuple[int, int, int, list[int]]:
    """As `linear_alignments`, of one pair."""
    return linear_alignments([a], [b], **costs)[0]


def _matches(x: np.ndarray, y: np.ndarray, ends: np.ndarray, costs: Sequence[int]) -> np.ndarray:
    """As `affine_matches`, of pairs that are columns of letters, with whole costs: the pairs of a cell lie together, in numbers as short as their scores allow."""
    (n, size), m = x.shape, y.shape[0]
    shift = max(1, min(n, m).bit_length())
    hit, miss, open_gap, longer = (c << shift for c in costs)
    hit += 1
    short = min(n, m)
    most, least = max(hit, miss, 0) * short, -min(miss, 0) * short - 2 * min(open_gap, 0) - min(longer, 0) * (n + m)
    lost = -most - 2 * least - 1
    kind = next(k for k in (np.int16, np.int32, np.int64) if most - lost + 2 * least < np.iinfo(k).max)
    hit, miss, open_gap, longer, lost = (kind(c) for c in (hit, miss, open_gap, longer, lost))
    out = np.zeros(size, np.int64)
    total = ends.sum(1)
    d0, r0, v0, d1, r1, v1, d, r, v = (np.full((n + 1, size), lost, kind) for _ in range(9))
    u, w = np.empty((n + 1, size), kind), np.empty((n + 1, size), kind)
    d1[0] = 0
    for k in range(1, n + m + 1):
        low, high = max(0, k - m), min(n, k)
        inner, end = max(1, k - m), min(n, k - 1)
        for state, start, stop in ((d, inner, end + 1), (v, max(1, low), high + 1), (r, low, end + 1)):
            state[: max(start, 0)] = lost
            state[max(stop, 0) :] = lost
        if inner <= end:
            at, some = slice(inner - 1, end), slice(inner, end + 1)
            np.multiply(x[at] == y[k - end - 1 : k - inner][::-1], hit - miss, out=u[some], casting="unsafe")
            if miss:
                u[some] += miss
            np.maximum(d0[at], r0[at], out=w[some])
            np.maximum(w[some], v0[at], out=w[some])
            np.add(u[some], w[some], out=d[some])
        for state, before, turned, at, some in ((v, v1, r1, slice(max(1, low) - 1, high), slice(max(1, low), high + 1)), (r, r1, v1, slice(low, end + 1), slice(low, end + 1))):
            np.maximum(d1[at], turned[at], out=u[some])
            u[some] += open_gap
            np.add(before[at], longer, out=w[some])
            np.maximum(u[some], w[some], out=state[some])
        done = np.flatnonzero(total == k)
        if len(done):
            at = ends[done, 0]
            out[done] = np.maximum(np.maximum(d[at, done], r[at, done]), v[at, done]) & ((1 << shift) - 1)
        d0, r0, v0, d1, r1, v1, d, r, v = d1, r1, v1, d, r, v, d0, r0, v0
    return out


def affine_matches(a: Sequence[str], b: Sequence[str], need: Sequence[float] | None = None, match: float = 1.0, mismatch: float = 0.0, begin: float = -1.0, extend: float = -0.5, unit: float = 0.5) -> np.ndarray:
    """Matches of a best global alignment with affine gaps of each pair, of best ones that with most matches.

    With `need`, a pair that cannot have as many matches any more is given up
    and gets -1: every alignment passes one of two neighbouring diagonals, and
    from a cell on it gains at most what is left of the shorter side. Costs are
    multiples of `unit`.
    """
    costs = np.array([match, mismatch, begin, extend]) / unit
    if (costs != np.round(costs)).any():
        raise ValueError(f"costs are no multiples of {unit}")
    hit, miss, open_gap, longer = (int(c) << _SHIFT for c in costs)
    hit += 1
    out = np.zeros(len(a), np.int64)
    if need is None:
        for some in _batches(a, b):
            s, t = [a[i] for i in some], [b[i] for i in some]
            ends = np.array([[len(p), len(q)] for p, q in zip(s, t, strict=True)])
            out[some] = _matches(_codes(s, -1).T, _codes(t, -2).T, ends, [int(c) for c in costs])
        return out
    for some in _batches(a, b):
        s, t = [a[i] for i in some], [b[i] for i in some]
        x, y = _codes(s, -1), _codes(t, -2)
        ends = np.array([[len(p), len(q)] for p, q in zip(s, t, strict=True)])
        wanted = np.array([need[i] for i in some], float)
        alive = np.arange(len(some))
        n, m = x.shape[1], y.shape[1]
        lost = lambda: np.full((len(alive), n + 1), _LOST)  # noqa: B023, E731
        d0, r0, v0, d1, r1, v1 = (lost() for _ in range(6))
        d1[:, 0] = 0
        for row in np.flatnonzero(ends.sum(1) == 0):
            out[some[row]] = 0
        for k in range(1, n + m + 1):
            d, r, v = lost(), lost(), lost()
            low, high = max(0, k - m), min(n, k)
            inner, end = max(1, k - m), min(n, k - 1)
            if inner <= end:
                best = np.maximum(np.maximum(d0[:, inner - 1 : end], r0[:, inner - 1 : end]), v0[:, inner - 1 : end])
                d[:, inner : end + 1] = best + np.where(_same(x, y, k, inner, end), hit, miss)
            # Right moves come from the same row, down moves from the one above.
            up = slice(max(1, low) - 1, high)
            if max(1, low) <= high:
                v[:, max(1, low) : high + 1] = np.maximum(np.maximum(d1[:, up], r1[:, up]) + open_gap, v1[:, up] + longer)
            side = slice(low, min(n, k - 1) + 1)
            r[:, side] = np.maximum(np.maximum(d1[:, side], v1[:, side]) + open_gap, r1[:, side] + longer)
            done = np.flatnonzero(ends[alive].sum(1) == k)
            if len(done):
                at = ends[alive[done], 0]
                top = np.maximum(np.maximum(d[done, at], r[done, at]), v[done, at])
                out[some[alive[done]]] = top & ((1 << _SHIFT) - 1)
            d0, r0, v0, d1, r1, v1 = d1, r1, v1, d, r, v
            keep = ends[alive].sum(1) > k
            if k % _LOOK == 0:
                hope = np.full(len(alive), -1, np.int64)
                for back, states in ((0, (d1, r1, v1)), (1, (d0, r0, v0))):
                    i = np.arange(max(0, k - back - m), min(n, k - back) + 1)
                    rest = np.minimum(ends[alive, :1] - i, ends[alive, 1:] - (k - back - i))
                    for state in states:
                        here = state[:, i]
                        hope = np.maximum(hope, np.where((here > _LOST >> 1) & (rest >= 0), (here & ((1 << _SHIFT) - 1)) + rest, -1).max(1))
                over = keep & (hope < wanted[alive])
                out[some[alive[over]]] = -1
                keep &= ~over
            if not keep.all() and (k % _LOOK == 0 or not keep.any()):
                alive, x, y, d0, r0, v0, d1, r1, v1 = alive[keep], x[keep], y[keep], d0[keep], r0[keep], v0[keep], d1[keep], r1[keep], v1[keep]
                if not len(alive):
                    break
    out[(out >= 0) & (out < np.asarray(need, float))] = -1
    return out


def affine_identities(a: Sequence[str], b: Sequence[str], **costs: float) -> np.ndarray:
    """Percent of matches over the longer string of each pair; 0 where one is empty."""
    longest = np.array([max(len(p), len(q)) for p, q in zip(a, b, strict=True)], float)
    empty = np.array([not p or not q for p, q in zip(a, b, strict=True)], bool)
    return np.where(empty, 0.0, 100.0 * affine_matches(a, b, **costs) / np.where(empty, 1, longest))


def affine_identity(a: str, b: str, **costs: float) -> float:
    """As `affine_identities`, of one pair."""
    return float(affine_identities([a], [b], **costs)[0])


def alike(a: Sequence[str], b: Sequence[str], threshold: float) -> np.ndarray:
    """Whether the identity of each pair exceeds `threshold` percent.

    Matches are at most the letters that both strings have, each as often as
    the poorer has it; only pairs that may pass by that are aligned.
    """
    longest = np.array([max(len(p), len(q), 1) for p, q in zip(a, b, strict=True)], float)
    # As the comparison with the threshold is strict, the least whole number beyond it.
    need = np.floor(threshold * longest / 100.0)
    need += np.where(100.0 * need / longest > threshold, 0, 1)
    x, y = letters(a), letters(b)
    may = (np.minimum(x, y).sum(1) >= need) & np.array([bool(p) and bool(q) for p, q in zip(a, b, strict=True)], bool)
    out = np.zeros(len(a), bool)
    at = np.flatnonzero(may)
    if len(at):
        out[at] = affine_matches([a[i] for i in at], [b[i] for i in at], need[at]) >= 0
    return out


def letters(texts: Sequence[str]) -> np.ndarray:
    """How often each text has letters of 32 kinds; several letters may share a kind, which only loosens bounds."""
    codes = _codes(texts, -1)
    out = np.zeros((len(texts), 33), np.int64)
    np.add.at(out, (np.arange(len(texts))[:, None], np.where(codes < 0, 32, codes % 32)), 1)
    return out[:, :32]


def block_identity(a: str, b: str) -> float:
    """Share of the longer string in matching blocks; not an optimal alignment."""
    if not a or not b:
        return 0.0
    return sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) / max(len(a), len(b))


def align_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (a, b) with score, matches, aligned and identity percentages; null with null."""
    distinct = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, y = pdf["a"].tolist(), pdf["b"].tolist()
            score, matches, aligned, _ = zip(*linear_alignments(x, y), strict=True) if x else ((), (), (), ())
            yield pd.DataFrame({"a": x, "b": y, "score": score, "matches": matches, "aligned": aligned, "identity": affine_identities(x, y), "block_identity": [block_identity(p, q) for p, q in zip(x, y, strict=True)]})

    return distinct.mapInPandas(run, "a string, b string, score long, matches long, aligned long, identity double, block_identity double")


def best_match(scored: DataFrame, key: str, candidate: str, identity: str, least: float, lead: float) -> DataFrame:
    """Best candidate per key and whether it is accepted: good enough, and ahead of the second by `lead`."""
    w = Window.partitionBy(key).orderBy(F.col(identity).desc(), candidate)
    second = F.coalesce(F.lead(identity).over(w), F.lit(0.0))
    ranked = scored.withColumn("_rank", F.row_number().over(w)).withColumn("margin", F.col(identity) - second).where("_rank = 1")
    low, close = F.col(identity) < least, F.col("margin") < lead
    reason = F.concat_ws(",", F.when(low, F.lit("low_identity")), F.when(close, F.lit("ambiguous")))
    return ranked.select(key, candidate, identity, "margin", F.when(reason == "", "accepted").otherwise(reason).alias("status"))


#: Chains of either side of a case that meet in one task, and bound ones of them at a time.
BOUND, FREE, ROWS = 2048, 8192, 512
#: Candidates of a chain, those that may have most matches, that are aligned before others are looked at again.
TRIES = (16, 128)


def common_letters(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Letters, a row for each of `a`, that it and each of `b` have in common in one order; no alignment has more matches.

    Exact where `b`'s have up to 64 letters; of longer ones, pieces count each on
    its own, which may only be more. A row of the usual table is one word a
    string, so a letter costs four operations for all of `b`.
    """
    out = np.zeros((len(a), len(b)), np.int32)
    codes = _codes(b, -1)
    for start in range(0, codes.shape[1], 64):
        piece = codes[:, start : start + 64]
        kind = np.uint32 if piece.shape[1] <= 32 else np.uint64
        places = np.arange(piece.shape[1], dtype=kind)
        has = {chr(c): ((piece == c).astype(kind) << places).sum(1, dtype=kind) for c in np.unique(piece[piece >= 0])}
        free, met, moved = (np.empty(len(b), kind) for _ in range(3))
        for row, text in zip(out, a, strict=True):
            free.fill(~kind(0))
            for letter in text:
                if letter in has:
                    np.bitwise_and(free, has[letter], out=met)
                    np.add(free, met, out=moved)
                    np.subtract(free, met, out=free)
                    np.bitwise_or(free, moved, out=free)
            np.invert(free, out=free)
            row += np.bitwise_count(free)
    return out


def best_two(a: Sequence[str], b: Sequence[str], twice: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in `b`, matches, next identity) of the likest of `b` for each of `a`: most identical, best covered, first.

    Strings are not empty. Where `twice` is set, a string counts as two. The
    next identity is NaN where there is no other. Only pairs that may have as
    many matches as the next best need are aligned, likeliest first.
    """
    n, m = (np.array([len(x) for x in t]) for t in (a, b))
    longest = np.maximum(n[:, None], m[None, :])
    hope = common_letters(a, b) / longest
    found = np.full(hope.shape, -1, np.int32)
    x, y = _codes(a, -1), _codes(b, -2)
    costs = [2, 0, -2, -1]
    rows = np.arange(len(a))
    if max(x.max(), y.max()) < 128:
        x, y = x.astype(np.int8), y.astype(np.int8)

    def measured() -> np.ndarray:
        return np.where(found >= 0, found / longest, -1.0)

    def second(identity: np.ndarray, best: np.ndarray) -> np.ndarray:
        top = identity[rows, best]
        others = identity.copy()
        others[rows, best] = -1.0
        return np.where(twice[best], top, others.max(1))

    for tries in (*TRIES, len(b)):
        identity = measured()
        left = np.where((found < 0) & (hope >= second(identity, identity.argmax(1))[:, None]), hope, -1.0)
        if tries < len(b):
            some = np.argpartition(-left, tries - 1, axis=1)[:, :tries]
            i, j = np.repeat(rows, tries), some.ravel()
        else:
            i, j = np.nonzero(left >= 0)
        go = left[i, j] >= 0
        i, j = i[go], j[go]
        order = np.lexsort((m[j], n[i]))
        i, j = i[order], j[order]
        at = 0
        while at < len(i):
            wide = m[j[at : at + PAIRS]].max()
            to = at + max(1, min(PAIRS, int(CELLS // ((n[i[at : at + PAIRS]].max() + 1) * (wide + 1)))))
            p, q = i[at:to], j[at:to]
            ends = np.stack([n[p], m[q]], 1)
            found[p, q] = _matches(np.ascontiguousarray(x[p, : ends[:, 0].max()].T), np.ascontiguousarray(y[q, : ends[:, 1].max()].T), ends, costs)
            at = to
    identity = measured()
    same = identity == identity.max(1)[:, None]
    for worth in (found, found / m[None, :]):
        same &= np.where(same, worth, -1) == np.where(same, worth, -1).max(1)[:, None]
    best = same.argmax(1)
    after = second(identity, best)
    return best, found[rows, best], np.where(after < 0, np.nan, after)


def _likest(bound: pa.Table, free: pa.Table) -> pa.Table:
    if len(bound) and len(free):
        # Of equal candidates the first by place, then name, counts.
        free = free.take(pc.sort_indices(free, sort_keys=[("place", "ascending"), ("other", "ascending")], null_placement="at_start"))
        texts, twice = free.column("t").to_pylist(), free.column("twice").to_numpy()
    parts = []
    for at in range(0, len(bound) if len(free) else 0, ROWS):
        some = bound.slice(at, ROWS)
        best, m, after = best_two(some.column("s").to_pylist(), texts, twice)
        took = free.take(pa.array(best))
        parts.append(pa.table({"case": some.column("case"), "s": some.column("s"), "m": pa.array(m, pa.int64()), "t_length": pa.array([len(texts[i]) for i in best], pa.int64()), "other_place": took.column("place"), "other": took.column("other"), "next": pa.array(after, from_pandas=True)}))
    if parts:
        return pa.concat_tables(parts)
    kinds = {"case": bound.schema.field("case").type, "s": pa.string(), "m": pa.int64(), "t_length": pa.int64(), "other_place": free.schema.field("place").type, "other": free.schema.field("other").type, "next": pa.float64()}
    return pa.table({c: pa.array([], k) for c, k in kinds.items()})


def _likest_in_blocks(bound: DataFrame, free: DataFrame) -> DataFrame:
    """(case, s, m, t_length, other_place, other, next) for each of `bound` (case, s) and each block of `free` (case, t, place, other, twice)."""
    blocks = lambda df, size, out: df.groupBy("case").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias(out))
    sizes = stage(blocks(bound, BOUND, "kb").join(blocks(free, FREE, "kf"), "case"), "chain-blocks")
    tasks = max(shuffle_width(bound.sparkSession), sizes.agg(F.coalesce(F.sum(F.col("kb") * F.col("kf")), F.lit(0))).first()[0])

    def dealt(df: DataFrame, text: str, own: str, copies: str) -> DataFrame:
        block = {f"{own}_": F.pmod(F.xxhash64(text), F.col(own)).cast("int"), f"{copies}_": F.explode(F.sequence(F.lit(0), F.col(copies) - 1))}
        # The blocks are few and dear, so they are dealt to a given number of tasks, not by their bytes.
        return attach(df, sizes, ["case"], "inner").select(*df.columns, block["kb_"].alias("i"), block["kf_"].alias("j")).repartition(tasks, "case", "i", "j")

    kinds = {**dict(bound.dtypes), **dict(free.dtypes)}
    schema = f"case {kinds['case']}, s string, m long, t_length long, other_place {kinds['place']}, other {kinds['other']}, next double"
    sides = [df.groupBy("case", "i", "j") for df in (dealt(bound, "s", "kb", "kf"), dealt(free, "t", "kf", "kb"))]
    return sides[0].cogroup(sides[1]).applyInArrow(_likest, schema)


def match_chains(bound: DataFrame, free: DataFrame, case: str, chain: str, place: str, sequence: str, identity: float = 0.9, coverage: float = 0.8, lead: float = 0.05) -> DataFrame:
    """Each chain of `bound` with the chain of `free`, in the same case, that it is likeliest to be.

    (case, chain, best, identity, coverage_bound, coverage_free, second, matched,
    status, reason, fallback): matches of an alignment over the longer length,
    over either length, the identity of the next best, the best chain if it is
    accepted, and what speaks against it otherwise: `missing_sequence`,
    `low_identity`, `low_coverage_bound`, `low_coverage_free`, `ambiguous` if
    the next best is nearer than `lead`, `no_candidates`. Of equal candidates
    the first by `place` counts. The fallback, which no sequence supports, is
    the chain of the same name, or else of the same place where both sides have
    as many chains, or else the only one. A chain is compared with the chains of
    its case only. Distinct sequences of a case meet in blocks, each pair of
    blocks a task, which tell the best and the next of each, so there is no
    table of pairs; in a block, pairs that cannot be among the two by the letters
    that they have in common in one order are not aligned. The work is quadratic
    in the distinct sequences of a case, the rows moved nearly linear.
    """
    key = [F.col(case).alias("case"), F.col(chain).alias("chain"), F.col(place).alias("place"), F.nullif(F.col(sequence), F.lit("")).alias("s")]
    left, right = stage(bound.select(*key), "bound-chains"), stage(free.select(*key), "free-chains")
    # Of equal sequences of a case only the first chain can be the best, and only the next can be its second.
    number = F.row_number().over(Window.partitionBy("case", "s").orderBy("place", "chain"))
    two = right.where("case IS NOT NULL AND s IS NOT NULL").withColumn("_r", number).where("_r <= 2")
    options = two.groupBy("case", F.col("s").alias("t")).agg(F.min(F.when(F.col("_r") == 1, F.struct("place", "chain"))).alias("f"), (F.count(F.lit(1)) > 1).alias("twice"))
    options = stage(options.select("case", "t", F.col("f.place").alias("place"), F.col("f.chain").alias("other"), "twice"), "free-sequences")
    asked = stage(left.where("case IS NOT NULL AND s IS NOT NULL").select("case", "s").distinct(), "bound-sequences")
    likest = stage(_likest_in_blocks(asked, options), "likest-chains")
    share = lambda n: F.col("m") / n.cast("double")
    n, m = F.length("s"), F.col("t_length")
    empty = F.lit(None).cast("double")
    v = lambda i, cb, cf: F.struct(i.alias("identity"), cb.alias("coverage_bound"), cf.alias("coverage_free"))
    entry = lambda after, value, where, other: F.struct(F.lit(after).alias("after"), value.alias("v"), where.alias("other_place"), other.alias("other"))
    found = left.join(likest, ["case", "s"]).where("chain IS NOT NULL")
    first = entry(0, v(share(F.greatest(n, m)), share(n), share(m)), F.col("other_place"), F.col("other"))
    kinds = dict(right.dtypes)
    after = F.when(F.col("next").isNotNull(), entry(1, v(F.col("next"), empty, empty), F.lit(None).cast(kinds["place"]), F.lit(None).cast(kinds["chain"])))
    found = found.select("case", "chain", F.explode(F.filter(F.array(first, after), lambda e: e.isNotNull())).alias("e"))
    # Without a sequence on either side there is nothing to tell candidates by but their places.
    named = F.struct(F.col("place").alias("other_place"), F.col("chain").alias("other"))
    plain = right.groupBy("case").agg(F.min(named).alias("_any"), F.min(F.when(F.col("s").isNull(), named)).alias("_bare"))
    blind = left.join(plain, "case").withColumn("_p", F.when(F.col("s").isNull(), F.col("_any")).otherwise(F.col("_bare"))).where("_p IS NOT NULL AND chain IS NOT NULL")
    blind = blind.select("case", "chain", entry(0, v(empty, empty, empty), F.col("_p.other_place"), F.col("_p.other")).alias("e"))
    scored = found.unionByName(blind).select("case", "chain", "e.*")
    worth = F.struct(*[F.coalesce(F.col(f"v.{c}"), F.lit(-1.0)) for c in ("identity", "coverage_bound", "coverage_free")])
    ranked = F.row_number().over(Window.partitionBy("case", "chain").orderBy(worth.desc(), "after", "other_place", "other"))
    top = scored.withColumn("_r", ranked).groupBy("case", "chain").agg(F.max(F.when(F.col("_r") == 1, F.struct("other", "v"))).alias("a"), F.max(F.when(F.col("_r") == 2, F.col("v.identity"))).alias("second"))
    counts = lambda df, out: df.groupBy("case").agg(F.count(F.lit(1)).alias(out))
    at = lambda df: df.withColumn("_at", F.row_number().over(Window.partitionBy("case").orderBy("place", "chain")))
    placed = at(left).join(counts(left, "_b"), "case").join(counts(right, "_f"), "case", "left")
    same = right.select("case", "chain", F.col("chain").alias("_same"))
    there = at(right).select("case", "_at", F.col("chain").alias("_there"))
    only = right.groupBy("case").agg(F.when(F.count(F.lit(1)) == 1, F.min("chain")).alias("_only"))
    rows = placed.join(same, ["case", "chain"], "left").join(there, ["case", "_at"], "left").join(only, "case", "left").join(top, ["case", "chain"], "left")
    fallback = F.coalesce("_same", F.when(F.col("_b") == F.col("_f"), F.col("_there")), "_only")
    i, cb, cf = (F.col(f"a.v.{c}") for c in ("identity", "coverage_bound", "coverage_free"))
    low = lambda c, least: F.coalesce(c < least, F.lit(True))
    against = F.concat_ws(",", F.when(i.isNull(), "missing_sequence").otherwise(F.when(i < identity, "low_identity")), F.when(low(cb, coverage), "low_coverage_bound"), F.when(low(cf, coverage), "low_coverage_free"), F.when(F.coalesce(i - F.col("second") < lead, F.lit(False)), "ambiguous"))
    reason = F.when(F.col("a").isNull(), "no_candidates").when(against == "", "accepted").otherwise(against)
    out = rows.select("case", "chain", F.col("a.other").alias("best"), i.alias("identity"), cb.alias("coverage_bound"), cf.alias("coverage_free"), "second", reason.alias("reason"), fallback.alias("fallback"))
    good = F.col("reason") == "accepted"
    return out.withColumn("matched", F.when(good, F.col("best"))).withColumn("status", F.when(good, "sure").otherwise("unsure"))


#: Sequences of a block of which all pairs are looked at in one task.
BLOCK = 2048


def _alike_in_blocks(threshold: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        block = table.column("block").to_numpy()
        texts = np.array(table.column("s").to_pylist(), object)
        rows, cols = texts[block == i], texts[block == j]
        size, counts = ([f(list(t)) for t in (rows, cols)] for f in (lambda t: np.array([len(x) for x in t]), letters))
        found_a, found_b = [], []
        for at in range(len(rows)):
            longest = np.maximum(size[0][at], size[1])
            may = 100.0 * np.minimum(counts[0][at], counts[1]).sum(1) > threshold * longest
            if i == j:
                may[: at + 1] = False
            hits = np.flatnonzero(may)
            found_a.append(np.full(len(hits), at))
            found_b.append(hits)
        a, b = (np.concatenate(x) if x else np.empty(0, int) for x in (found_a, found_b))
        keep = alike(list(rows[a]), list(cols[b]), threshold) if len(a) else np.empty(0, bool)
        return pa.table({"x": pa.array(rows[a[keep]].tolist(), pa.string()), "y": pa.array(cols[b[keep]].tolist(), pa.string())})

    return run


def alike_pairs(sequences: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(g, x, y): both orders of distinct sequences `s` of a group `g` whose identity exceeds `threshold` percent, and each with itself.

    Lengths of alike sequences differ by less than the threshold's share, so
    sequences are dealt to ranges of length in that ratio, and only equal and
    neighbouring ranges meet; ranges of many sequences are parted into blocks,
    and each pair of blocks is a task. Within it counts of letters bound the
    matches before anything is aligned. No pair is lost. The work within a
    range is quadratic in its distinct sequences, as a low threshold asks.
    """
    some = sequences.where("g IS NOT NULL AND s <> ''").select("g", "s").distinct()
    ratio = min(max(100.0 / threshold, 1.0001), 1e6) if threshold > 0 else 1e6
    ranged = stage(some.withColumn("r", F.floor(F.log(F.length("s").cast("double")) / F.log(F.lit(ratio)) + 1e-9).cast("long")), "sequence-ranges")
    sizes = stage(ranged.groupBy("g", "r").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("k")), "range-sizes")
    number = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    ahead = sizes.select("g", F.col("r").alias("r2"), number.alias("j"))
    # What a block of a range meets: later blocks of it, and all of the next two ranges, lest rounding part neighbours.
    behind = ahead.select("g", F.explode(F.array(*[F.col("r2") - d for d in (0, 1, 2)])).alias("r"), "r2", "j")
    met = sizes.select("g", "r", number.alias("i")).join(behind, ["g", "r"]).where("r2 > r OR j >= i")
    place = lambda r, i: F.concat_ws(":", r, i)
    met = stage(met.select("g", place(F.col("r"), F.col("i")).alias("i"), place(F.col("r2"), F.col("j")).alias("j")), "block-pairs")
    own = attach(ranged, sizes, ["g", "r"], "inner").withColumn("block", place(F.col("r"), F.pmod(F.xxhash64("s"), F.col("k")).cast("int"))).select("g", "s", "block")
    one = met.select("g", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    found = own.join(one, ["g", "block"]).groupBy("g", "i", "j").applyInArrow(_named(_alike_in_blocks(threshold), sequences), f"g {dict(sequences.dtypes)['g']}, x string, y string")
    found = stage(found, "alike")
    itself = some.where(F.lit(100.0) > threshold).select("g", F.col("s").alias("x"), F.col("s").alias("y"))
    return found.unionByName(found.select("g", F.col("y").alias("x"), F.col("x").alias("y"))).unionByName(itself)


def _named(compare, sequences: DataFrame):
    """`compare`, with the group of its rows in front."""
    kind = sequences.select("g").limit(0).toArrow().schema.field("g").type

    def run(key: tuple, table: pa.Table) -> pa.Table:
        out = compare(key, table)
        return out.add_column(0, "g", pa.array([key[0].as_py()] * len(out), kind))

    return run


def first_independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes (id) that a greedy choice keeps: in order, each that has no edge from one kept before.

    `edges` (u, v) lead from the earlier to the later node. In a round all
    undecided nodes without an undecided earlier neighbour are kept, and their
    later neighbours go; that is the greedy choice, and rounds are as many as
    the longest chain of decisions, few where the order is unrelated to the
    edges.
    """
    kept, left = [], stage(edges.select("u", "v").distinct(), "conflicts")
    undecided = stage(nodes.select("id").join(left.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "id", "left_semi"), "undecided")
    free = nodes.select("id").join(undecided, "id", "left_anti")
    while not undecided.isEmpty():
        first = stage(undecided.join(left.select(F.col("v").alias("id")).distinct(), "id", "left_anti"), "kept")
        kept.append(first)
        gone = stage(left.join(first, left["u"] == first["id"], "left_semi").select(F.col("v").alias("id")).distinct(), "gone")
        undecided = stage(undecided.join(first, "id", "left_anti").join(gone, "id", "left_anti"), "undecided")
        left = stage(left.join(undecided, left["u"] == undecided["id"], "left_semi").join(undecided.select(F.col("id").alias("w")), F.col("v") == F.col("w"), "left_semi"), "conflicts")
    for part in kept:
        free = free.unionByName(part)
    return free


def prune_redundant(df: DataFrame, group: str, order: str, a: str, b: str, sequence_a: str, sequence_b: str, threshold: float) -> DataFrame:
    """Greedy pruning of each group in `order`: a row goes if both its ends exceed `threshold` percent identity with a kept row's, either way round.

    Distinct sequences are compared in blocks, rows that conflict are found by
    equi joins, and the greedy choice is made in rounds over all groups at
    once, so that no group meets in one task. Null and empty sequences are like
    none, so their rows are kept. Rows that tie in `order` come in order of
    their other columns; rows that agree in all are pruned but for one if they
    are like themselves. Rows with a null group are a group of their own.
    """
    names = list(dict.fromkeys([group, order, a, b, sequence_a, sequence_b]))
    number = F.struct(*[F.col(f"`{c}`") for c in [order, *[c for c in names if c != order]]])
    g = F.when(F.col(group).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(group).cast("string")))
    rows = stage(df.select(number.alias("rank"), g.alias("g"), F.col(sequence_a).alias("p"), F.col(sequence_b).alias("q"), F.monotonically_increasing_id().alias("id")), "prune-rows")
    like = stage(alike_pairs(rows.select("g", F.explode(F.array("p", "q")).alias("s")), threshold), "alike-both")
    # Rows of the same two sequences, in either order, are decided with the first of them.
    pair = [F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi")]
    sound = rows.where("p <> '' AND q <> ''")
    heads = stage(sound.groupBy("g", *pair).agg(F.min(F.struct("rank", "id")).alias("h")).select("g", "lo", "hi", F.col("h.rank").alias("rank"), F.col("h.id").alias("id")), "prune-heads")
    ends = heads.select("g", F.col("id").alias("u"), F.col("rank").alias("u_rank"), "lo", "hi")
    ends = ends.unionByName(ends.select("g", "u", "u_rank", F.col("hi").alias("lo"), F.col("lo").alias("hi")))
    half = heads.join(like.select("g", F.col("x").alias("lo"), F.col("y").alias("o1")), ["g", "lo"]).select("g", F.col("id").alias("v"), F.col("rank").alias("v_rank"), "hi", "o1")
    near = half.join(ends.select("g", F.col("lo").alias("o1"), F.col("hi").alias("o2"), "u", "u_rank"), ["g", "o1"]).where(F.struct("u_rank", "u") < F.struct("v_rank", "v"))
    edges = near.join(like.select("g", F.col("x").alias("hi"), F.col("y").alias("o2")), ["g", "hi", "o2"], "left_semi").select("u", "v").distinct()
    kept = first_independent(heads, edges)
    # Where a sequence is like itself, only heads may stay; otherwise every row is like none.
    own = kept if threshold < 100 else rows.select("id")
    alone = rows.where("coalesce(p, '') = '' OR coalesce(q, '') = ''").select("id")
    return rows.join(own.unionByName(alone).distinct(), "id", "left_semi").select(*[F.col("rank")[c].alias(c) for c in (group, order, a, b)])
