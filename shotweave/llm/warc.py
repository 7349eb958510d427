"""Zstandard WARC archives: one frame per record, a dictionary in the leading skippable frame (operator 5)."""

from __future__ import annotations

import base64
import hashlib
import math
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import small_batches

#: Fixed values of the formats: frame starts, and a skippable frame of no content, which Spark's text writer puts after each record.
FRAME, DICTIONARY, SKIPPABLE = 0xFD2FB528, 0x184D2A5D, range(0x184D2A50, 0x184D2A60)
EMPTY_FRAME = "P*M\x18\0\0\0\0"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

#: Payload bytes per archive on average, and the bounds of the dictionary and of the pages that it is trained on (a sample by hash).
ARCHIVE_BYTES = 64 << 20
DICT_BYTES, DICT_PAGES, DICT_PAGE_BYTES = 64 << 10, 500, 16 << 10
LEVEL = 3
#: A record's largest accepted decoded size.
RECORD_BYTES = 1 << 30


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary or string column."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _one_line(x: str) -> str:
    return x.replace("\r", "%0D").replace("\n", "%0A")


def format_record(page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A response record with its HTTP head and payload, or a revisit record with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = head if revisit else head + html
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_one_line(url)}")
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(pages: DataFrame, count: int) -> bytes:
    """Trained on the heads of at most ``DICT_PAGES`` pages; empty if they are too few."""
    sample = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(max(1, count // DICT_PAGES))) == 0).select(F.substring("html", 1, DICT_PAGE_BYTES).alias("x")).limit(DICT_PAGES)
    try:
        return zstandard.train_dictionary(DICT_BYTES, [r["x"].encode() for r in sample.collect() if r["x"]], level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, digest, n_bytes, refers_to) per distinct page id and payload; ``refers_to`` is null for responses.

    Of equal payloads of at least ``least_bytes`` bytes the largest page id is the response, all others revisit it.
    """
    narrow = materialize(pages.select("page_id", payload_digest(F.col("html")).alias("digest"), F.octet_length("html").cast("long").alias("n_bytes")))
    tops = narrow.where(F.col("n_bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "top")
    found = narrow.join(tops, "digest", "left")
    return found.groupBy("page_id", "digest").agg(F.first("n_bytes").alias("n_bytes"), F.max(F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))).alias("refers_to"))


def write_archives(pages: DataFrame, target: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes one WARC record per row to archives in the folder ``target``, on any store that Spark writes to.

    Needs ``page_id``, ``url`` and ``html``; other columns are ignored. Null html is an empty payload, a null url is left out, a null id is written as an
    empty one (and, in a group of equal payloads, revisits the largest id). Rows of one id and payload are written alike; an empty table writes no
    archive. An archive is a sequence of zstandard frames: the dictionary, then records in order of their ids, each followed by an empty
    skippable frame. Spark's text writer streams the frames to the file, so no archive is held in memory. Payloads are
    shuffled once, by id and digest, so equal payloads spread over all archives.
    """
    small_batches(pages.sparkSession)
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    decided = materialize(revisits(pages, least_bytes))
    count, size = decided.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    raw = train_dictionary(pages, count)
    n = max(1, math.ceil(size / ARCHIVE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]):
        zstd = zstandard.ZstdCompressor(level=LEVEL, **({"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}))
        first = [struct.pack("<II", DICTIONARY, len(raw)) + raw] if raw else []
        for batch in batches:
            frames, held = first, 0
            first = []
            html = batch.column("html").cast(pa.binary())
            for k, (page_id, url, digest, refers_to, revisit) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to", "revisit")), strict=True)):
                frames.append(zstd.compress(format_record(page_id, url, html[k].as_py(), digest, refers_to, revisit, date)))
                held += len(frames[-1])
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])
                    frames, held = [], 0
            if frames:
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])

    # both sides are dealt by all keys of the join, so that it needs no exchange of its own
    keys = ["_page", "no_id", "digest"]
    named = (F.coalesce("page_id", F.lit(-1)).alias("_page"), F.col("page_id").isNull().alias("no_id"))
    dealt = pages.select("page_id", "url", "html", *named, payload_digest(F.col("html")).alias("digest")).repartition(n, *keys)
    plan = decided.select(*named, "digest", "refers_to").repartition(n, *keys)
    rows = dealt.join(plan, keys)
    rows = rows.select("page_id", "url", "html", "digest", "refers_to", F.col("refers_to").isNotNull().alias("revisit")).sortWithinPartitions("page_id")
    rows.mapInArrow(run, "frame binary").select(F.col("frame").cast("string")).write.option("lineSep", EMPTY_FRAME).text(target)


def frame_size(data: memoryview, at: int) -> int:
    """Length of the zstandard frame that starts at ``at``, from its header and block headers; raises on a truncated or malformed one."""
    if len(data) < at + 5:
        raise ValueError("truncated frame header")
    flags = data[at + 4]
    p = at + 5 + (0 if flags & 0x20 else 1) + (0, 1, 2, 4)[flags & 3] + (1 if flags & 0x20 and not flags >> 6 else (0, 2, 4, 8)[flags >> 6])
    while True:
        if len(data) < p + 3:
            raise ValueError("truncated block header")
        block = int.from_bytes(data[p:p + 3], "little")
        kind = block >> 1 & 3
        if kind == 3:
            raise ValueError("reserved block type")
        p += 3 + (1 if kind == 1 else block >> 3)
        if block & 1:
            break
    p += 4 if flags & 4 else 0
    if p > len(data):
        raise ValueError("truncated frame")
    return p - at


def parse_record(record: bytes) -> dict:
    """The fields of a decoded record; raises if the version, a required header, a length or the payload's digest is wrong."""
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] != VERSION:
        raise ValueError("no WARC/1.1 header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon:
            raise ValueError("header line without a colon")
        fields[name.strip().lower()] = value.strip()
    if missing := [r for r in REQUIRED if r not in fields]:
        raise ValueError(f"missing {', '.join(missing)}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("block length differs from Content-Length")
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    size = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response":
        if size is not None and size != len(payload):
            raise ValueError("payload length differs from the HTTP head's")
        if digest and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError("payload digest differs")
        size = len(payload)
    elif kind == "revisit" and "warc-refers-to" not in fields:
        raise ValueError("revisit without WARC-Refers-To")
    page = lambda x: int(x) if (x := fields.get(x, "").removeprefix("<urn:page:").removesuffix(">")).lstrip("-").isdigit() else None
    return {"page_id": page("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "payload_bytes": size, "payload_digest": digest,
            "refers_to": page("warc-refers-to"), "payload": payload if kind == "response" else None}


def records(data: bytes) -> Iterator[dict]:
    """The records of an archive, one frame decoded at a time. What is wrong with a record, or ends the archive early, is in its ``error``."""
    view, at, zstd = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        try:
            magic = int.from_bytes(view[at:at + 4], "little")
            if magic in SKIPPABLE:
                size = int.from_bytes(view[at + 4:at + 8], "little")
                if at + 8 + size > len(view):
                    raise ValueError("truncated skippable frame")
                if magic == DICTIONARY and at == 0:
                    zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[8:8 + size])))
                at += 8 + size
                continue
            if magic != FRAME:
                raise ValueError("no frame start")
            size = frame_size(view, at)
        except ValueError as e:
            yield {"error": str(e)}
            return
        try:
            yield parse_record(zstd.decompress(view[at:at + size], max_output_size=RECORD_BYTES))
        except (ValueError, zstandard.ZstdError) as e:
            yield {"error": str(e)}
        at += size


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                  ("refers_to", pa.int64()), ("error", pa.string()), ("payload", pa.binary())])


def read_archives(spark: SparkSession, target: str, payloads: bool = True) -> DataFrame:
    """The records of all archives in the folder: page_id, url, record_type, payload_bytes, payload_digest, refers_to, error, and with ``payloads`` the payload
    (null for revisits).

    A record that breaks the format is a row with its ``error`` and no other value; if frames can no longer be told apart, the rest of that archive
    is one such row. A task holds one archive's compressed bytes and one decoded record at a time.
    """
    small_batches(spark)
    schema = _OUT if payloads else _OUT.remove(len(_OUT) - 1)
    ddl = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, error string" + ", payload binary" * payloads

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for r in records(content.as_py()):
                    held += len(r.get("payload") or b"") if payloads else 200
                    rows.append({k: r.get(k) for k in schema.names})
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spark.read.format("binaryFile").load(target).select("content").mapInArrow(run, ddl)
