"""Web archives: a writer with revisit records, and a sequential reader.

Every record is a gzip member of its own. The reader decompresses a member
piece by piece, takes the block by its content length, and verifies block and
payload digests as the bytes pass, so its memory does not grow with a file.
Of pages with equal payloads of `min_revisit` bytes or more, that with the
largest id is a response; the others are revisits that name it and carry its
HTTP header, whose content length is the payload's.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.base import attach, file_store, new_path, shuffle_width, stage

MIN_REVISIT = 1000
#: Bytes read from a file, and decompressed, at a time.
PIECE = 1 << 16
#: A file is closed, and the next begun, at this size.
FILE_BYTES = 1 << 30
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


def _base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _urn(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def _page(urn: str | None) -> int | None:
    """The page that a record of our own names; other identifiers name none."""
    named = re.fullmatch(r"<urn:page:(-?[0-9]+)>", urn or "")
    return int(named[1]) if named else None


def member(page: int | None, url: str | None, payload: bytes, digest: bytes, revisit: bool, refers_to: int | None, date: str) -> bytes:
    """One record as one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=';/?:@&=+$,#%[]!*()~')}")
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: {_base32(digest)}", f"WARC-Block-Digest: {_base32(hashlib.sha1(block).digest())}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(wbits=31)
    return packer.compress("\r\n".join(head).encode() + _END + block + _END) + packer.flush()


class _Bytes:
    """Takes bytes by delimiter or number from an iterator of pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self._pieces, self._held = pieces, b""

    def until(self, mark: bytes) -> bytes:
        while mark not in self._held:
            self._held += self._next()
        found, self._held = self._held.split(mark, 1)
        return found

    def take(self, n: int) -> Iterator[bytes]:
        while n > 0:
            piece, self._held = self._held[:n], self._held[n:]
            if not piece:
                self._held = self._next()
                continue
            n -= len(piece)
            yield piece

    def rest(self) -> bytes:
        return self._held + b"".join(self._pieces)

    def _next(self) -> bytes:
        for piece in self._pieces:
            if piece:
                return piece
        raise ValueError("a record ends before its content length")


def _fields(lines: bytes) -> dict[str, str]:
    """Header fields by lower-case name; lines without a colon are passed over."""
    pairs = (line.split(":", 1) for line in lines.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {name.strip().lower(): value.strip() for name, value in pairs}


def _verify(digest, told: str | None, what: str) -> None:
    """Compare with a SHA-1 in base 32 or in hexadecimal digits; other algorithms and absent digests are not checked."""
    kind, _, value = (told or "").partition(":")
    if kind.lower() == "sha1" and value.lower() not in (digest.hexdigest(), _base32(digest.digest())[5:].lower()):
        raise ValueError(f"a {what} does not match its digest")


def _hex(digest: str | None) -> str | None:
    """A SHA-1 as hexadecimal digits; other digests, or none, give none."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return value.lower() if re.fullmatch("[0-9A-Fa-f]{40}", value) else base64.b32decode(value.upper()).hex()


def _record(pieces: Iterator[bytes], with_payload: bool) -> dict:
    """One record of any kind. Responses and revisits hold an HTTP message; of others only the header counts."""
    source = _Bytes(pieces)
    head = _fields(source.until(_END))
    kind, length = head["warc-type"], int(head["content-length"])
    block, payload = hashlib.sha1(), hashlib.sha1()
    row = {"kind": kind, "head": head, "payload": None}
    if kind in ("response", "revisit"):
        http = source.until(_END)
        block.update(http + _END)
        length -= len(http) + len(_END)
        told = _fields(http).get("content-length", "")
        row["bytes"] = int(told) if told.isdigit() else None
    kept = [] if with_payload else None
    taken = 0
    for piece in source.take(length):
        block.update(piece)
        payload.update(piece)
        taken += len(piece)
        if kept is not None:
            kept.append(piece)
    if source.rest() != _END:
        raise ValueError("a record does not end at its content length")
    _verify(block, head.get("warc-block-digest"), "block")
    row["digest"] = head.get("warc-payload-digest")
    if kind == "response":
        if row["bytes"] not in (None, taken):
            raise ValueError("a payload does not match its digest")
        _verify(payload, row["digest"], "payload")
        row["bytes"], row["digest"] = taken, _base32(payload.digest())
        row["payload"] = b"".join(kept) if kept is not None else None
    return row


def records(stream, with_payload: bool = True) -> Iterator[dict]:
    """The records of an open archive, in order; raises where one is damaged."""
    pending = b""
    while pending := pending or stream.read(PIECE):
        inflate = zlib.decompressobj(wbits=31)

        def pieces() -> Iterator[bytes]:
            nonlocal pending
            while not inflate.eof:  # noqa: B023
                pending = pending or stream.read(PIECE)
                if not pending:
                    raise ValueError("an archive ends inside a record")
                out = inflate.decompress(pending, PIECE)  # noqa: B023
                pending = inflate.unused_data if inflate.eof else inflate.unconsumed_tail  # noqa: B023
                yield out

        yield _record(pieces(), with_payload)


_FILES = "file string, records long, bytes long"


def _writer(folder: str, date: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = file_store(folder)
        done: list[tuple[str, int, int]] = []
        out, name, count, size = None, "", 0, 0

        def close() -> None:
            nonlocal out
            out.close()
            done.append((name, count, size))
            out = None

        for rb in batches:
            for at in range(0, len(rb), 256):
                for row in rb.slice(at, 256).to_pylist():
                    if out is None:
                        # The attempt is in the name: a repeated task never touches another's file.
                        name = f"part-{context.partitionId():06d}-{len(done):04d}-{context.taskAttemptId()}.warc.gz"
                        out, count, size = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                    data = member(row["page_id"], row["url"], row["html"], bytes.fromhex(row["digest"]), row["revisit"], row["refers_to"], date)
                    out.write(data)
                    count, size = count + 1, size + len(data)
                    if size >= file_bytes:
                        close()
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["file", "records", "bytes"])

    return run


def write(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write a record for every row of `pages` to archives below `folder`, which executors share.

    A null payload is empty, a null url leaves its header out, a null id is
    written as such and comes after all others. Rows that repeat the id of a
    response are responses too. Very long payloads are written whole, one at a
    time; columns beyond the three named ones are not read. An empty table
    gives no archive and an empty index. `folder/files` is the index, written when all archives are complete;
    files of tasks that were repeated are not in it.
    """
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("html")).withColumn("digest", F.sha1("html")).withColumn("n", F.octet_length("html").cast("long")).withColumn("_equal", F.when(F.col("n") >= min_revisit, F.sha2("html", 256)))
    # SHA-1 alone can be made to collide; equal payloads share length and SHA-256 too.
    same = stage(rows.where(F.col("n") >= min_revisit).groupBy("digest", "n", "_equal").agg(F.max("page_id").alias("_keep"), F.count("*").alias("_many")).where("_many > 1").drop("_many"), "same-payload")
    revisit = F.col("_keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_keep"))
    ready = attach(rows, same, ["digest", "n", "_equal"]).select("page_id", "url", "html", "digest", revisit.alias("revisit"), F.when(revisit, F.col("_keep")).alias("refers_to"))
    spark = pages.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    ready.mapInArrow(_writer(folder, date, file_bytes), _FILES).write.parquet(f"{folder}/files")


def _reader(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_store(folder)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for rb in batches:
            for file in rb.column(0).to_pylist():
                held, size = [], 0
                with store.open_input_stream(f"{root}/{file}", compression=None) as stream:
                    for r in records(stream, with_payload):
                        if r["kind"] not in ("response", "revisit"):
                            continue
                        head = r["head"]
                        held.append((_page(head.get("warc-record-id")), r["bytes"], _hex(r["digest"]), r["kind"], _page(head.get("warc-refers-to")), head.get("warc-target-uri"), r["payload"]))
                        size += len(r["payload"] or b"")
                        if len(held) >= 1024 or size >= 1 << 24:
                            yield batch(held)
                            held, size = [], 0
                if held:
                    yield batch(held)

    return run


def read(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """One row per response or revisit record of the archives in the index.

    page_id, payload_bytes, payload_digest (hex SHA-1), record_type, refers_to,
    url, payload (null for revisits, or if not asked for). Records of other
    kinds are passed over. Archives of other writers are read too: identifiers
    that name no page give null ids, digests are verified where they are SHA-1,
    and a revisit that tells no length or digest has none.
    """
    files = spark.read.parquet(f"{folder}/files").select("file").repartition(shuffle_width(spark), "file")
    return files.mapInArrow(_reader(folder, with_payload), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def round_trip(pages: DataFrame, with_payload: bool = True, **options) -> DataFrame:
    """Write `pages` to a new folder of the shared place and read the archives back."""
    folder = new_path(pages.sparkSession, "warc")
    write(pages, folder, **options)
    return read(pages.sparkSession, folder, with_payload)
