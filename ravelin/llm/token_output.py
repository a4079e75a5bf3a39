"""Token files coded by a static range asymmetric numeral system.

One frequency table, counted over all documents, serves all files. A file
holds a run of documents in ascending order of id as independent blocks. In a
block, token i belongs to lane i mod `lanes`; the lanes' 64-bit states share one
stream of 32-bit words, so a block is decoded many tokens at a time. The
lanes' states at a block's start are its checkpoint and a CRC-32 of its tokens
its checksum: any block is decoded alone, in any task, and is verified.

Layout of a block, little-endian: magic "RNSB", tokens u32, lanes u32, words
u32, documents u32, crc32 u32; tokens of each document u64; doc ids i64 and
their null flags u8; states u64; words u32. `frequencies` beside the files has
(symbol, frequency).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.llm.base import attach, drop_path, file_store, new_path, shuffle_width, stage, staged
from ravelin.llm.tokens import encoder

END_ID = 2
#: Frequencies sum to 2**SCALE; states stay at or above LOW.
SCALE, LOW = 20, np.uint64(1 << 31)
#: A block ends with the document that brings it to this many tokens.
BLOCK_TOKENS, LANES = 1 << 17, 1024
#: Bytes of ids that a task holds before it passes them on.
BATCH_BYTES = 1 << 22
_HEAD = struct.Struct("<4s5I")
_U32 = np.uint64(32)


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies of all symbols, at least 1 where counted, that sum to 2**SCALE."""
    if np.count_nonzero(counts) > 1 << SCALE:
        raise ValueError(f"more than {1 << SCALE} symbols are used, each of which needs a frequency of its own")
    counts = counts.astype(np.float64)
    freq = np.where(counts > 0, np.maximum(1, np.floor(counts / max(counts.sum(), 1) * (1 << SCALE))), 0).astype(np.int64)
    if not freq.any():
        return freq
    spare = (1 << SCALE) - int(freq.sum())
    if spare > 0:
        freq[int(freq.argmax())] += spare
    while spare < 0:  # rare symbols were raised to 1: take it from the frequent ones
        take = np.minimum(freq - 1, np.maximum(freq * -spare // max(1, int(freq.sum())), freq == freq.max()))
        take = np.where(freq > 1, take, 0)
        over = np.cumsum(take) - take
        take = np.clip(np.minimum(take, -spare - over), 0, None)
        freq -= take
        spare += int(take.sum())
    return freq


class Coder:
    """Codes arrays of tokens under one frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self._symbol: np.ndarray | None = None

    def encode(self, tokens: np.ndarray, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
        """(states, words): the lanes' first states for decoding, and the words in order of reading."""
        lanes = max(1, min(lanes, len(tokens)))
        x = np.full(lanes, LOW, np.uint64)
        out = []
        for at in reversed(range(0, len(tokens), lanes)):
            step = tokens[at : at + lanes]
            f, s = self.freq[step], self.start[step]
            y = x[: len(step)]
            full = y >= (f << np.uint64(63 - SCALE))
            out.append(y[full].astype(np.uint32))
            y = np.where(full, y >> _U32, y)
            q, r = np.divmod(y, f)
            x[: len(step)] = (q << np.uint64(SCALE)) + r + s
        return x, np.concatenate(out[::-1]) if out else np.empty(0, np.uint32)

    def decode(self, n: int, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        x, tokens, read = states.copy(), np.empty(n, np.uint32), 0
        low = np.uint64((1 << SCALE) - 1)
        for at in range(0, n, len(x)):
            y = x[: min(len(x), n - at)]
            slot = y & low
            got = self._symbol[slot]
            tokens[at : at + len(y)] = got
            y = self.freq[got] * (y >> np.uint64(SCALE)) + slot - self.start[got]
            need = np.flatnonzero(y < LOW)
            y[need] = (y[need] << _U32) | words[read : read + len(need)]
            read += len(need)
            x[: len(y)] = y
        if read != len(words) or (x != LOW).any():
            raise ValueError("a token block does not end at the states that its coding began with")
        return tokens


def write_block(coder: Coder, ids: list[int | None], lengths: list[int], tokens: np.ndarray, lanes: int = LANES) -> bytes:
    states, words = coder.encode(tokens, lanes)
    head = _HEAD.pack(b"RNSB", len(tokens), len(states), len(words), len(ids), zlib.crc32(tokens.astype("<u4").tobytes()))
    known = np.array([0 if i is None else i for i in ids], "<i8")
    nulls = np.array([i is None for i in ids], np.uint8)
    return b"".join([head, np.array(lengths, "<u8").tobytes(), known.tobytes(), nulls.tobytes(), states.astype("<u8").tobytes(), words.astype("<u4").tobytes()])


def read_block(coder: Coder, data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, tokens of each, all tokens); raises if the checksum disagrees."""
    magic, n, lanes, n_words, docs, crc = _HEAD.unpack_from(data)
    if magic != b"RNSB":
        raise ValueError("not a token block")
    at, parts = _HEAD.size, []
    for kind, count in (("<u8", docs), ("<i8", docs), ("u1", docs), ("<u8", lanes), ("<u4", n_words)):
        parts.append(np.frombuffer(data, kind, count, at))
        at += parts[-1].nbytes
    lengths, known, nulls, states, words = parts
    tokens = coder.decode(n, states.astype(np.uint64), words.astype(np.uint64))
    if zlib.crc32(tokens.astype("<u4").tobytes()) != crc:
        raise ValueError("a token block does not match its checksum")
    return [None if z else i for i, z in zip(known.tolist(), nulls.tolist(), strict=True)], lengths.astype(np.int64), tokens


_CODED = "tally boolean, doc_id long, n_tokens long, crc long, ids binary"


def _tokenise(path: str, end_id: int, kind: str):
    names = [c.split()[0] for c in _CODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_all
        end = np.array([end_id], "<u4").tobytes()
        counts = np.zeros(1, np.int64)

        def rows(ids: pa.Array, coded: list[bytes]) -> pa.RecordBatch:
            nonlocal counts
            flat = np.frombuffer(b"".join(coded), "<u4").astype(kind)
            more = np.bincount(flat)
            if len(more) > len(counts):
                counts, more = more, counts
            counts[: len(more)] += more
            sizes = [len(c) // 4 for c in coded]
            bounds = np.cumsum([0, *sizes]) * flat.itemsize
            narrow = flat.tobytes()
            cut = [narrow[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), False)), ids, pa.array(sizes, pa.int64()), pa.array([zlib.crc32(c) for c in coded], pa.int64()), pa.array(cut, pa.binary())], names=names)

        for rb in batches:
            held, at, size = [], 0, 0
            for c in encode(rb.column(1)):
                held.append(c + end)
                size += len(c)
                if size >= BATCH_BYTES:
                    yield rows(rb.column(0).slice(at, len(held)), held)
                    at, held, size = at + len(held), [], 0
            if held:
                yield rows(rb.column(0).slice(at, len(held)), held)
        used = np.flatnonzero(counts)  # how often this task met each symbol, as rows of their own
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), True)), pa.array(used, pa.int64()), pa.array(counts[used], pa.int64()), pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.binary())], names=names)

    return run


def _table(freq_rows) -> np.ndarray:
    """Dense frequencies of (symbol, frequency) rows, as many as the vocabulary has symbols."""
    freq = np.zeros(max((r["symbol"] for r in freq_rows), default=0) + 1, np.int64)
    for r in freq_rows:
        freq[r["symbol"]] = r["frequency"]
    return freq


_BLOCKS = "part long, block long, file string, at long, bytes long, docs long, tokens long, tokens_before long"


def _writer(folder: str, freq, block_tokens: int, lanes: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = file_store(folder)
        coder, part, width = Coder(freq.value), context.partitionId(), np.dtype(kind).itemsize
        # The attempt is in the name: a repeated task never touches another's file.
        file = f"part-{part:06d}-{context.taskAttemptId()}.rans"
        out, at, before, block = None, 0, 0, 0
        ids: list = []
        held: list[bytes] = []
        rows: list[tuple] = []
        tokens = 0

        def flush() -> None:
            nonlocal out, at, before, block, tokens
            out = out or store.open_output_stream(f"{root}/{file}")
            data = write_block(coder, ids, [len(h) // width for h in held], np.frombuffer(b"".join(held), kind), lanes)
            out.write(data)
            rows.append((part, block, file, at, len(data), len(ids), tokens, before))
            at, before, block, tokens = at + len(data), before + tokens, block + 1, 0
            ids.clear()
            held.clear()

        for rb in batches:
            for doc, data in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                ids.append(doc)
                held.append(data)
                tokens += len(data) // width
                if tokens >= block_tokens:
                    flush()
        if ids:
            flush()
        if out:
            out.close()
        names = [c.split()[0] for c in _BLOCKS.split(", ")]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)

    return run


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, lanes: int = LANES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the token files of `docs` to `folder`, a path that executors share.

    Null texts count as empty and give the end id alone. Null ids come first,
    rows that repeat an id follow each other, and an empty table gives an empty
    index. `folder/blocks` is the index, written when all files are complete;
    files of tasks that were repeated are not in it. Memory: one block's
    tokens, or the longest document's.
    """
    spark = docs.sparkSession
    # Between the steps ids take as few bytes as the vocabulary allows.
    kind = "<u2" if max(encoder(tokenizer).vocabulary(), end_id + 1) <= 1 << 16 else "<u4"
    coded, path = staged(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(_tokenise(tokenizer, end_id, kind), _CODED), "token-ids")
    counts = coded.where("tally").groupBy(F.col("doc_id").alias("symbol")).agg(F.sum("n_tokens").alias("n")).collect()  # a row per symbol of the vocabulary
    dense = np.zeros(max((r["symbol"] for r in counts), default=0) + 1, np.int64)
    for r in counts:
        dense[r["symbol"]] = r["n"]
    freq = quantise(dense)
    used = np.flatnonzero(freq)
    spark.createDataFrame([(int(s), int(freq[s])) for s in used], "symbol long, frequency long").coalesce(1).write.parquet(f"{folder}/frequencies")
    shared = spark.sparkContext.broadcast(freq)
    keys = [F.col("doc_id").asc_nulls_first(), F.col("crc"), F.col("n_tokens")]
    ordered = coded.where("NOT tally").repartitionByRange(shuffle_width(spark), *keys).sortWithinPartitions(*keys).select("doc_id", "ids")
    ordered.mapInArrow(_writer(folder, shared, block_tokens, lanes, kind), _BLOCKS).write.parquet(f"{folder}/blocks")
    drop_path(spark, path)


def _reader(folder: str, freq):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_store(folder)
        coder = Coder(freq.value)
        for rb in batches:
            for row in rb.to_pylist():
                with store.open_input_file(f"{root}/{row['file']}") as f:
                    data = f.read_at(row["bytes"], row["at"])
                ids, lengths, tokens = read_block(coder, data)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                raw = tokens.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(starts + row["start"], pa.int64()), pa.array(lengths, pa.int64()), pa.array([raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return run


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)."""
    table = _table(spark.read.parquet(f"{folder}/frequencies").collect())
    shared = spark.sparkContext.broadcast(table)
    blocks = spark.read.parquet(f"{folder}/blocks")
    files = blocks.groupBy("part").agg(F.sum("tokens").alias("_all"))
    base = files.select("part", F.coalesce(F.sum("_all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    jobs = attach(blocks, stage(base, "token-bases"), ["part"], "inner").select("file", "at", "bytes", (F.col("_base") + F.col("tokens_before")).alias("start"))
    spread = stage(jobs, "token-jobs").repartition(shuffle_width(spark), "file", "at")
    return spread.mapInArrow(_reader(folder, shared), "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write `docs` to a new folder of the shared place and read the files back."""
    folder = new_path(docs.sparkSession, "tokens")
    write(docs, tokenizer, folder, **options)
    return read(docs.sparkSession, folder)
