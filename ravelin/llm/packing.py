"""Packing tokens into windows by Karmarkar-Karp multiway differencing.

A document's tokens are cut into whole windows and a rest; the rest is cut
into pieces of at most a quarter of a window. Each batch of rests is divided
among windows: every piece begins as a partial partition of its own, and the
two partitions of widest spread are merged, largest sums against smallest,
until one is left. If a window exceeds its capacity, the batch is divided anew
among one window more. Batches are of bounded size, in documents and in tokens,
and are packed where their rows are read; nothing is shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.tokens import encoder

WINDOW, END_ID = 1024, 0
#: Documents whose rests are packed together, fewer where they hold so many bytes of ids.
BATCH, BATCH_BYTES = 512, 1 << 26
#: Pieces are never of just the right sizes: a division begins with one window more for so many.
PER_SPARE = 96


def cut_lengths(total: int, window: int = WINDOW) -> list[int]:
    """Whole windows, then the rest in near-equal pieces of at most window/4."""
    whole, rest = divmod(total, window)
    parts = -(-rest // (window // 4))
    small = [rest * (i + 1) // parts - rest * i // parts for i in range(parts)]
    return [window] * whole + small


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Multiway Karmarkar-Karp: the items of each of k sets, as indexes.

    A partial partition keeps its sums in falling order and leaves out sets
    that are still empty. Ties are broken by order of creation.
    """
    if not sizes:
        return [[] for _ in range(k)]
    items: list[object] = list(range(len(sizes)))  # a set: an item or a pair of sets
    heap = [(-s, i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, sums_a, sets_a = heapq.heappop(heap)
        _, _, sums_b, sets_b = heapq.heappop(heap)
        both = len(sums_a) + len(sums_b) - k  # sets that must be shared
        if both > 0:
            meet = slice(len(sums_b) - both, None)
            sums_a, sets_a = sums_a.copy(), sets_a.copy()
            a_at = slice(len(sums_a) - both, None)
            shared = sums_a[a_at] + sums_b[meet][::-1]
            base = len(items)
            items.extend(zip(sets_a[a_at].tolist(), sets_b[meet][::-1].tolist(), strict=True))
            sums_a[a_at], sets_a[a_at] = shared, np.arange(base, base + both)
            sums_b, sets_b = sums_b[: len(sums_b) - both], sets_b[: len(sets_b) - both]
        sums, sets = np.concatenate([sums_a, sums_b]), np.concatenate([sets_a, sets_b])
        order = np.argsort(-sums, kind="stable")
        sums, sets = sums[order], sets[order]
        spread = sums[0] - (sums[-1] if len(sums) == k else 0)
        heapq.heappush(heap, (-int(spread), made, sums, sets))
        made += 1
    out: list[list[int]] = []
    for top in heap[0][3].tolist():
        mine, stack = [], [top]
        while stack:
            at = items[stack.pop()]
            if isinstance(at, tuple):
                stack.extend(at)
            else:
                mine.append(at)
        out.append(sorted(mine))
    return out + [[] for _ in range(k - len(out))]


def pack_batch(sizes: list[int], window: int = WINDOW) -> list[list[int]]:
    """Windows that hold the items; one more as long as one is too full."""
    k = max(1, -(-sum(sizes) // window))
    k += k // PER_SPARE
    while True:
        sets = difference(sizes, k)
        if all(sum(sizes[i] for i in s) <= window for s in sets):
            return [s for s in sets if s]
        k += 1


_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _packer(path: str, window: int, end_id: int, batch: int):
    quad = np.uint32(end_id).astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = encoder(path)
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            rows, rests = [], []
            for doc, data in held:
                total, start = len(data) // 4, 0
                for length in cut_lengths(total, window):
                    piece = [doc, start, length, data[4 * start : 4 * (start + length)], total, None, 0]
                    rows.append(piece)
                    if length == window:
                        piece[5] = sequence
                        sequence += 1
                    else:
                        rests.append(piece)
                    start += length
            for members in pack_batch([p[2] for p in rests], window) if rests else []:
                at = 0
                for i in members:
                    rests[i][5], rests[i][6] = sequence, at
                    at += rests[i][2]
                sequence += 1
            held.clear()
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for rb in batches:
            for doc, ids in zip(rb.column(0).to_pylist(), words.encode_all(rb.column(1)), strict=True):
                held.append((doc, ids + quad))
                size += len(ids)
                if len(held) >= batch or size >= BATCH_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()
        words.forget()

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, batch: int = BATCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    `ids` holds the piece's tokens as little-endian unsigned 32-bit integers.
    Each document ends in `end_id`, so an empty or null text is one token long.
    Batches are runs of `batch` rows of an input partition, or fewer where
    texts are very long, so nothing is shuffled; the last batch of a partition
    is smaller. Rows that repeat an id are documents of their own, ties do not
    occur, null ids stay null, an empty table gives no rows, and other columns,
    whatever they are called, are not read. Memory: one batch's tokens, or the
    longest text's.
    """
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_packer(tokenizer, window, end_id, batch), _SCHEMA)
