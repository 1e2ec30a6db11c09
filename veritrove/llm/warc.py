"""WARC archives compressed with Zstandard: writing, and a reader that validates.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary; each record is a frame of its own. The reader loads the dictionary
from that frame, decodes one frame per record, and checks the version line, the
mandatory headers, Content-Length, the block's length, and the payload's digest
and length. Records whose payload equals an earlier one's are revisits.

Archives travel as binary columns, so Spark writes and reads them wherever its
tables are.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrove.plans.session import written

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: Bytes of records in an archive before the next one begins; pages and bytes that a dictionary is trained on at most.
ARCHIVE_BYTES = 4 << 20
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 2 << 20, 32 << 10
#: Payloads that occur more than once (28 bytes each), broadcast at most; parts of a payload's rows beyond that.
MOST_REPEATS, SALTS = 1 << 18, 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


class WarcError(ValueError):
    """The archive or a record in it is not as it should be."""


@dataclass
class Record:
    kind: str
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return "urn:page:" + ("" if page_id is None else str(page_id))


def record_of(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """An uncompressed WARC record; a revisit (refers_to given) has the HTTP headers as its block, without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    clean = "".join(c for c in (url or "") if c not in "\r\n")
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{record_id(page_id)}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": clean,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{record_id(refers_to)}>"}
    block = http if refers_to is not None else http + payload
    head["Content-Length"] = str(len(block))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> Record:
    """A record from its bytes, validated."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {}
    for line in lines[1:]:
        name, sep, value = line.partition(":")
        if not sep:
            raise WarcError(f"bad header line {line[:40]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"no {name}")
    if not headers["content-length"].isdigit():
        raise WarcError("bad content-length")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"block of {len(rest) - 4} bytes, content-length {n}")
    r = Record(headers["warc-type"], headers, rest[:n])
    if r.kind == "response" and "warc-payload-digest" in headers:
        if headers["warc-payload-digest"] != f"sha1:{digest(r.payload())}":
            raise WarcError("payload digest differs")
        if http_length(r) != len(r.payload()):
            raise WarcError("payload length differs")
    if r.kind == "revisit" and "warc-refers-to" not in headers:
        raise WarcError("revisit without warc-refers-to")
    return r


def http_length(r: Record) -> int:
    """Content-Length of the HTTP headers in a block."""
    for line in r.block.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return int(value)
    raise WarcError("no HTTP content-length")


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from samples; b'' where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archive(records: Iterable[bytes], dictionary: bytes = b"", level: int = 3) -> bytes:
    """The dictionary's skippable frame, then a frame for each record."""
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    c = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=True, write_checksum=True)
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary + b"".join(map(c.compress, records))


def read_archive(data: bytes) -> Iterator[Record]:
    """The records of an archive, one frame each, validated. Skippable frames between records are passed over."""
    at, d = 0, None
    view = memoryview(data)
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        n = struct.unpack_from("<I", data, 4)[0]
        if 8 + n > len(data):
            raise WarcError("dictionary frame cut short")
        body = bytes(view[8 : 8 + n])
        if body[:4] == struct.pack("<I", FRAME_MAGIC):
            body = zstandard.ZstdDecompressor().decompress(body)
        d = zstandard.ZstdCompressionDict(body) if body else None
        at = 8 + n
    while at < len(data):
        if at + 8 <= len(data) and struct.unpack_from("<I", data, at)[0] & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        one = zstandard.ZstdDecompressor(dict_data=d).decompressobj()
        parts, step = [], 1 << 14
        try:
            while not one.eof:
                if at >= len(data):
                    raise WarcError("record frame cut short")
                piece = view[at : at + step]
                parts.append(one.decompress(piece))
                at += len(piece) - len(one.unused_data)
        except zstandard.ZstdError as e:
            raise WarcError(f"bad frame: {e}") from e
        yield parse(b"".join(parts))


def with_references(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html ('' for null), refers_to (null for responses).

    Of equal payloads of at least so many bytes the smallest page_id's is the
    response. Rows that repeat it are responses too, and so are rows without a
    page_id. Only payloads that occur more than once are looked up: up to MOST_REPEATS of them are
    broadcast, and html stays where it is; more are joined by shuffling, a payload's rows in parts by page_id."""
    p = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("key", F.unhex(F.sha1("html")))
    first = p.where(F.octet_length("html") >= least_bytes).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = written(first.where("n > 1").select("key", "first"), "repeats")
    if first.count() <= MOST_REPEATS:
        j = p.join(F.broadcast(first), "key", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS))
        parts = first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        j = p.withColumn("salt", salt).join(parts, ["key", "salt"], "left")
    return j.select("page_id", "url", "html", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))


def write_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """archive (binary) rows that hold a record for each page. A row's archives are of about ARCHIVE_BYTES, or one record."""
    sample = [(r[0] or "").encode() for r in pages.select(F.substring("html", 1, SAMPLE_BYTES // SAMPLE_PAGES)).limit(SAMPLE_PAGES).collect()]
    dictionary = train_dictionary([x for x in sample if x])
    refs = with_references(pages, least_bytes)

    def run(batches):
        held: list[bytes] = []
        size = 0
        for b in batches:
            for page_id, url, html, ref in zip(*(b.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                held.append(record_of(page_id.as_py(), url.as_py(), html.as_py().encode(), ref.as_py()))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([write_archive(held, dictionary)], pa.large_binary()).cast(pa.binary())], names=["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([write_archive(held, dictionary)], pa.binary())], names=["archive"])

    return refs.mapInArrow(run, "archive binary")


def read_pages(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record in archive rows."""

    def page(name: str) -> int | None:
        text = name.strip("<>").removeprefix("urn:page:")
        return int(text) if text else None

    def run(batches):
        for b in batches:
            for a in b.column(0):
                rows = []
                for r in read_archive(a.as_py()):
                    ref = page(r.headers["warc-refers-to"]) if r.kind == "revisit" else None
                    rows.append((page(r.headers["warc-record-id"]), http_length(r), r.headers["warc-payload-digest"].removeprefix("sha1:"), r.kind, ref))
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.select("archive").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes all pages (page_id, url, html) to archives in the shared folder and reads them back.

    Null html is an empty payload; payloads may be of any length; extra columns
    are ignored; an empty table gives no archive."""
    return read_pages(written(write_pages(pages, least_bytes), "warc"))
