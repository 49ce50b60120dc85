"""Web archives in Zstandard: a dictionary in front, one frame a record, and a reader that checks what it reads.

An archive ``*.warc.zst`` starts with a skippable frame that holds the dictionary (itself a
Zstandard frame), learnt from the first records of the task that writes it: ``SAMPLE`` bytes of
them at most, which only decides how small the archive gets. A task whose first records are too
few to learn from writes archives without one. Every record is one frame of its own, so it can be
decoded alone, given its place and the dictionary. A new archive begins after ``ARCHIVE`` bytes.

A payload of ``LEAST`` bytes or more that occurs again is kept once, as the ``response`` of the
largest page id; the others are ``revisit`` records, with the digest and length of the payload and
the id of the record that has it.

The reader takes the dictionary from the leading frame, decodes frame by frame in pieces of
bounded size, and checks of every record: the version line, the header lines and that the
mandatory ones are there once, that the block has as many bytes as its header says and is followed
by the end of the record and of the frame, the digests of block and payload, and the length in the
HTTP headers. With ``strict`` the first fault ends the job; else it is a row with ``fault`` set,
and the archive is read on at the next frame where that can be told.

Defined cases: null html is the empty payload; a null page id comes before all others and is
read back as null; of rows with the same id and payload, that with the largest url is the response
(null first), of fully equal rows any one, and the others revisit it; control characters and spaces of a url
are percent-encoded; an empty table writes no archive and reads as no rows; other columns are not
looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import new_path, small_batches, table

#: Fixed values of the file formats.
DICTIONARY_FRAME = 0x184D2A5D
FRAME = bytes.fromhex("28b52ffd")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

LEAST = 1000
SAMPLE = 1 << 20
DICTIONARY = 1 << 16
ARCHIVE = 1 << 28
DATE = "2024-01-01T00:00:00Z"
PIECE = 1 << 16
RECORD = "archive string, offset bigint, record_type string, record_id string, refers_to_id string, url string, payload_bytes bigint, payload_digest string, fault string"


class Fault(ValueError):
    """A record or frame that does not hold what it says."""


def _base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _sha1(data: bytes) -> bytes:
    return hashlib.sha1(data, usedforsecurity=False).digest()


def _lines(named: Iterable[tuple[str, object]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in named if v is not None).encode()


def record(kind: str, record_id: str, block: bytes, content_type: str, **more: object) -> bytes:
    """One record as bytes; ``more`` are further headers, with ``_`` for ``-``."""
    named = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE)]
    named += [(k.replace("_", "-"), v) for k, v in more.items()]
    named += [("WARC-Block-Digest", _base32(_sha1(block))), ("Content-Type", content_type), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + _lines(named) + b"\r\n" + block + b"\r\n\r\n"


def page_record(record_id: str, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit of the record that has it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    more = {"WARC_Target_URI": url and re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url), "WARC_Payload_Digest": _base32(bytes.fromhex(digest))}
    if refers_to:
        more |= {"WARC_Profile": PROFILE, "WARC_Refers_To": f"<{refers_to}>"}
    return record("revisit" if refers_to else "response", record_id, http + (b"" if refers_to else payload or b""), "application/http; msgtype=response", **more)


def dictionary(samples: list[bytes], size: int = DICTIONARY) -> zstandard.ZstdCompressionDict | None:
    """What the samples have in common, or None where they are too few to learn from."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8)
    except zstandard.ZstdError:
        return None


class Writer:
    """Writes the records of one task, keeping ``SAMPLE`` bytes of them at first and then one at a time."""

    def __init__(self, folder: str, archive: int = ARCHIVE, level: int = 6) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.archive, self.level = archive, level
        self.waiting: list[bytes] | None = []
        self.held = self.size = self.records = 0
        self.file, self.known, self.done = None, None, []

    def _open(self) -> None:
        self.name = f"pages-{uuid.uuid4().hex}.warc.zst"
        self.file = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None)  # not by the name's ending
        self.size = self.records = 0
        if self.known:
            packed = zstandard.ZstdCompressor(level=19).compress(self.known.as_bytes())
            self._put(DICTIONARY_FRAME.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed)
        info = b"software: vellum\r\nformat: WARC File Format 1.1\r\n"
        self._put(self.packer.compress(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", info, "application/warc-fields", WARC_Filename=self.name)))

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.size += len(data)

    def _begin(self) -> None:
        waiting, self.waiting = self.waiting, None
        self.known = dictionary(waiting)
        self.packer = zstandard.ZstdCompressor(level=self.level, dict_data=self.known, write_checksum=True, write_content_size=True)
        for data in waiting:
            self.add(data)

    def add(self, data: bytes) -> None:
        if self.waiting is not None:
            self.waiting.append(data)
            self.held += len(data)
            if self.held >= SAMPLE:
                self._begin()
            return
        if self.file is None:
            self._open()
        self._put(self.packer.compress(data))
        self.records += 1
        if self.size >= self.archive:
            self._shut()

    def _shut(self) -> None:
        self.file.close()
        self.done.append({"archive": self.name, "n_bytes": self.size, "n_records": self.records})
        self.file = None

    def close(self) -> list[dict]:
        """The archives written."""
        if self.waiting:
            self._begin()
        if self.file is not None:
            self._shut()
        return self.done


def frames(file: BinaryIO) -> Iterator[tuple[int, bytes | Fault]]:
    """Place and content of each frame after the dictionary; a broken frame is a fault, and reading goes on at the next."""
    held, at = file.read(PIECE), 0
    known = None
    if held[:4] == DICTIONARY_FRAME.to_bytes(4, "little"):
        size = int.from_bytes(held[4:8], "little")
        while len(held) < 8 + size and (more := file.read(PIECE)):
            held += more
        inside = held[8 : 8 + size]
        if len(inside) < size:
            yield 0, Fault("the dictionary is cut off")
            return
        try:
            known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(inside) if inside[:4] == FRAME else inside)
        except zstandard.ZstdError as fault:
            yield 0, Fault(f"the dictionary: {fault}")
            return
        held, at = held[8 + size :], 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    while held or (held := file.read(PIECE)):
        start, out, frame = at, [], reader.decompressobj()
        try:
            while not frame.eof:
                if not held and not (held := file.read(PIECE)):
                    raise Fault("the last frame is cut off")
                out.append(frame.decompress(held))
                left = frame.unused_data if frame.eof else b""
                at, held = at + len(held) - len(left), left
        except (zstandard.ZstdError, Fault) as fault:
            yield start, Fault(str(fault))
            while (k := held.find(FRAME, 1 if at == start else 0)) < 0:
                more = file.read(PIECE)
                at, held = at + len(held) - min(3, len(held)), held[-3:] + more
                if not more:
                    return
            at, held = at + k, held[k:]
            continue
        yield start, b"".join(out)


def _headers(data: bytes) -> tuple[str, dict[str, str], bytes]:
    """First line, header lines and the rest."""
    head, end, rest = data.partition(b"\r\n\r\n")
    if not end:
        raise Fault("the headers have no end")
    try:
        first, *lines = head.decode().split("\r\n")
    except UnicodeDecodeError as fault:
        raise Fault("the headers are not UTF-8") from fault
    named: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!-9;-~]+", name):
            raise Fault(f"not a header line: {line[:40]!r}")
        if name.lower() in named:
            raise Fault(f"{name} is there twice")
        named[name.lower()] = value.strip()
    return first, named, rest


def _length(value: str | None) -> int:
    if value is None or not re.fullmatch(r"\d{1,18}", value):
        raise Fault(f"not a length: {value!r}")
    return int(value)


def _agrees(named: dict[str, str], name: str, data: bytes) -> None:
    stated = named.get(name.lower())
    if stated is not None and stated != _base32(_sha1(data)):
        raise Fault(f"{name} is not that of the data")


def parsed(data: bytes) -> dict[str, object]:
    """Fields of one record, after all checks."""
    version, named, rest = _headers(data)
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise Fault(f"not a version: {version[:20]!r}")
    for name in MANDATORY:
        if not named.get(name.lower()):
            raise Fault(f"{name} is missing")
    size = _length(named["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise Fault(f"the block has {len(rest) - 4} bytes, not {size}, or has no end")
    block, kind = rest[:size], named["warc-type"]
    _agrees(named, "WARC-Block-Digest", block)
    out = {"record_type": kind, "url": named.get("warc-target-uri"), "record_id": named["warc-record-id"].strip("<>"), "refers_to_id": None}
    if kind not in ("response", "revisit"):
        return out
    status, http, payload = _headers(block)
    if not status.startswith("HTTP/"):
        raise Fault("the block is not an HTTP response")
    stated = _length(http.get("content-length"))
    digest = named.get("warc-payload-digest", "")
    if not re.fullmatch(r"sha1:[A-Z2-7]{32}", digest):
        raise Fault("the payload digest is missing")
    if kind == "response":
        if len(payload) != stated:
            raise Fault(f"the payload has {len(payload)} bytes, not {stated}")
        _agrees(named, "WARC-Payload-Digest", payload)
        out["payload"] = payload
    else:
        if payload or named.get("warc-profile") != PROFILE or not named.get("warc-refers-to"):
            raise Fault("not a revisit of an identical payload")
        out["refers_to_id"] = named["warc-refers-to"].strip("<>")
    return out | {"payload_bytes": stated, "payload_digest": base64.b32decode(digest[5:]).hex()}


def write(pages: DataFrame, folder: str, least: int = LEAST, archive: int = ARCHIVE, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record for each row; returns the archives: ``archive, n_bytes, n_records``."""
    some = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    some = some.withColumns({"size": F.octet_length("html").cast("bigint"), "digest": F.sha1("html")})
    counted = table(some.where(F.col("size") >= least).groupBy("digest", "size", "page_id", "url").agg(F.count("*").alias("n")), "payloads")
    kept = counted.groupBy("digest", "size").agg(F.sum("n").alias("copies"), F.max(F.struct("page_id", "url", "n")).alias("kept")).where("copies > 1")
    kept = table(kept.select("digest", "size", "kept"), "kept-payloads")

    def name(page: str, address: str) -> F.Column:
        parts = [F.coalesce(F.col(page).cast("string"), F.lit("")), F.substring(F.sha2(F.concat_ws("\n", "digest", F.coalesce(address, F.lit(""))), 256), 1, 20)]
        return F.concat_ws(":", F.lit("urn:x-page"), *parts)

    is_kept = F.col("kept.page_id").eqNullSafe(F.col("page_id")) & F.col("kept.url").eqNullSafe(F.col("url"))
    # a payload that many pages share meets one row here, so that a split of the pages' side is all that skew needs
    met = some.join(kept, ["digest", "size"], "left")
    once = met.where(F.col("kept").isNull() | (is_kept & (F.col("kept.n") == 1)))
    again = met.where(is_kept & (F.col("kept.n") > 1)).dropDuplicates(["digest", "size"])  # equal rows: one of them
    found = once.unionByName(again)
    responses = found.select("page_id", "url", "html", "digest", "size", F.when(F.col("kept").isNotNull(), name("page_id", "url")).alias("name"), F.lit(None).cast("string").alias("refers_to"))
    other = counted.join(kept, ["digest", "size"]).withColumn("n", F.col("n") - F.when(is_kept, 1).otherwise(0)).where("n > 0")
    other = other.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n")))).repartition("page_id", "url", "copy")
    revisits = other.select("page_id", "url", F.lit(None).cast("string").alias("html"), "digest", "size", F.lit(None).cast("string").alias("name"), name("kept.page_id", "kept.url").alias("refers_to"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, out = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            columns = (batch.column(c) for c in ("page_id", "url", "html", "digest", "size", "name", "refers_to"))
            for row in zip(*columns, strict=True):
                page, address, text, digest, size, named, refers_to = (x.as_py() for x in row)
                out = out or Writer(folder, archive)
                n += 1
                named = named or f"urn:x-page:{'' if page is None else page}:{part}-{n}"
                out.add(page_record(named, address, None if text is None else text.encode(), digest, size, refers_to))
        done = out.close() if out else []
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("archive", pa.string()), ("n_bytes", pa.int64()), ("n_records", pa.int64())]))

    with small_batches(pages.sparkSession, 500):
        return table(responses.unionByName(revisits).mapInArrow(work, "archive string, n_bytes bigint, n_records bigint"), "archives")


def read(spark: SparkSession, archives: DataFrame, folder: str, strict: bool = True, payloads: bool = False) -> DataFrame:
    """All records of the archives, a task an archive: see ``RECORD``; with ``payloads`` also the binary ``payload``.

    Without ``strict`` a fault of a record or frame is a row that has only ``archive, offset`` and ``fault``.
    """
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    out_type = RECORD + (", payload binary" if payloads else "")
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in out_type.split(", "))])

    def rows(name: str) -> Iterator[dict]:
        fs, root = pafs.FileSystem.from_uri(folder)
        with fs.open_input_stream(f"{root}/{name}", compression=None) as file:
            for offset, data in frames(file):
                found: dict[str, object] = {"archive": name, "offset": offset}
                try:
                    if isinstance(data, Fault):
                        raise data
                    found |= parsed(data)
                except Fault as fault:
                    if strict:
                        raise Fault(f"{name}, at {offset}: {fault}") from fault
                    found["fault"] = str(fault)
                yield found

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                some, size = [], 0
                for found in rows(name):
                    some.append(found)
                    size += 200 + (len(found.get("payload") or b"") if payloads else 0)
                    if size > 1 << 20:
                        yield pa.RecordBatch.from_pylist([{n: x.get(n) for n in schema.names} for x in some], schema=schema)
                        some, size = [], 0
                yield pa.RecordBatch.from_pylist([{n: x.get(n) for n in schema.names} for x in some], schema=schema)

    spread = archives.select("archive").repartition(max(1, spark.sparkContext.defaultParallelism * 4), "archive")
    return spread.mapInArrow(work, out_type)


def archived(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write all pages and read them back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``, ``refers_to`` being a page id."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    found = read(spark, write(pages, folder, **options), folder).where(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.nullif(F.split(F.col(c), ":")[2], F.lit("")).cast("bigint")
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to_id").alias("refers_to"))
