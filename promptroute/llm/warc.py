"""Web archives: WARC records, each a Zstandard frame of its own, behind a frame that holds their dictionary.

An archive begins with a skippable frame whose content is a Zstandard dictionary, trained on records of this
archive.  Every record is then compressed alone with that dictionary, so it can be read without the ones before it.
Of pages with equal payloads of ``SMALLEST`` bytes or more, the one with the smallest key is written as a response; the others
are revisits that name it and carry no payload.

Archives are made in tasks and written by Spark's text writer, one row a file, so a lost executor leaves no half archives and
any file system that Spark writes to will do.  That writer ends a row with a separator: here an empty skippable
frame, which readers of Zstandard pass over.

A null payload is an empty one.  A null key is read back as null; a page without a key is a revisit where an equal one has a key,
and pages that all lack one are responses.  Rows with the same smallest key and payload are all
responses.  A null URL has no field; blanks and control characters of others are percent-escaped.  An empty table
gives no records.  Archives of few records have no dictionary.  Other columns are not looked at.  One record is held
in memory whole, and so is one archive.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptroute.llm.frames import arrow_schema
from promptroute.session import materialise

RESPONSE, REVISIT = "response", "revisit"
#: Bytes from which equal payloads are written once.
SMALLEST = 100
#: Bytes of records from which an archive is closed.
ARCHIVE_BYTES = 32 << 20
#: Bytes of a dictionary; it is trained on evenly spaced records of its archive of about so many times that size,
#: of which each gives its first bytes.  Only the rate of compression depends on it.
DICTIONARY_BYTES, TRAINED_ON, SAMPLE_BYTES = 32 << 10, 64, 16 << 10
LEVEL = 5

# Fixed values of the formats.
_FRAME, _SKIPPED, _DICTIONARY = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An empty skippable frame as text.
_GAP = struct.pack("<II", _SKIPPED, 0).decode("ascii")
_ODD = re.compile(r"[\x00-\x20\x7f-\xa0  ]")


def record_id(key: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}:{digest}')}>"


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(key: str | None, url: str | None, payload: bytes, digest: str, first: str | None, revisit: bool, date: str) -> bytes:
    """The record of a page; ``first`` is the key of the page that a revisit names."""
    fields = [("WARC-Type", REVISIT if revisit else RESPONSE), ("WARC-Record-ID", record_id(key, digest)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _ODD.sub(lambda m: quote(m.group()), url)))
    if key is not None:
        fields.append(("Page-Key", quote(key)))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if revisit:
        fields += [("WARC-Profile", _IDENTICAL), ("WARC-Refers-To", record_id(first, digest)), ("Refers-To-Page-Key", quote(first))]
    fields.append(("Content-Type", "application/http; msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    return record(fields, http.encode() + (b"" if revisit else payload))


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary of the records, or none where they are too few or too small to train one."""
    total = sum(min(len(r), SAMPLE_BYTES) for r in records)
    step = max(1, total // (TRAINED_ON * DICTIONARY_BYTES))
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, [r[:SAMPLE_BYTES] for r in records[::step]], k=1024, d=8)
    except zstandard.ZstdError:
        return b""
    return trained.as_bytes()


def archive(records: list[bytes]) -> bytes:
    """The frames of an archive: its dictionary, and one for each record."""
    trained = dictionary(records)
    if not trained:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        return b"".join(map(compressor.compress, records))
    known = zstandard.ZstdCompressionDict(trained)
    known.precompute_compress(level=LEVEL)
    compressor = zstandard.ZstdCompressor(dict_data=known)
    return struct.pack("<II", _DICTIONARY, len(trained)) + trained + b"".join(map(compressor.compress, records))


def frames(content: bytes) -> Iterator[tuple[int, int, int]]:
    """First four bytes as a number, start and end of every frame."""
    at = 0
    while at < len(content):
        (magic,) = struct.unpack_from("<I", content, at)
        stop = at
        if magic & ~0xF == _SKIPPED:
            stop += 8 + struct.unpack_from("<I", content, at + 4)[0]
        elif magic == _FRAME:
            stop += zstandard.frame_header_size(content[at : at + 18])
            last = False
            while not last:
                head = int.from_bytes(content[stop : stop + 3], "little")
                # A block of one repeated byte has a size of its own but holds that byte only.
                last, stop = bool(head & 1), stop + 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
            stop += 4 * (content[at + 4] >> 2 & 1)
        else:
            raise ValueError(f"no frame at byte {at}")
        yield magic, at, stop
        at = stop


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of every record of an archive."""
    decompressor = zstandard.ZstdDecompressor()
    for magic, start, stop in frames(content):
        if magic == _DICTIONARY and start == 0:
            raw = content[8:stop]
            if raw[:4] == struct.pack("<I", _FRAME):
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        elif magic == _FRAME:
            raw = decompressor.decompressobj().decompress(content[start:stop])
            head, _, rest = raw.partition(b"\r\n\r\n")
            lines = [line.partition(":") for line in head.decode().split("\r\n")[1:]]
            fields = {name.strip().lower(): value.strip() for name, _, value in lines}
            yield fields, rest[: int(fields["content-length"])]


def with_types(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """``key``, ``url``, ``payload`` (bytes), ``digest``, and ``first``, the key that a revisit names, with ``revisit``."""
    rows = pages.select(
        F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary")).alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    # Written, so that its size is known: few equal pages need no shuffle of payloads, and beyond that a very common one
    # can be split in the join.
    firsts = materialise(
        rows.where(F.octet_length("payload") >= SMALLEST)
        .groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"),
        "firsts",
    )
    revisit = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    return rows.join(firsts, "digest", "left").withColumn("revisit", revisit)


def write_archives(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
    archive_bytes: int = ARCHIVE_BYTES, date: str | None = None,
) -> None:
    """Archives of all ``pages`` in the folder ``path``."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    kinds = arrow_schema("archive binary")
    info = record(
        [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date),
         ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n",
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [info], 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("key", "url", "payload", "digest", "first", "revisit"))):
                held.append(page_record(*(x.as_py() for x in row), date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], schema=kinds)
                    held, size = [info], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], schema=kinds)

    rows = with_types(pages, key, url, payload).select(
        F.col("key").cast("string").alias("key"), "url", "payload", "digest", F.col("first").cast("string").alias("first"), "revisit"
    )
    packed = rows.mapInArrow(pack, "archive binary")
    text = packed.select(F.col("archive").cast("string").alias("value"))
    text.write.option("lineSep", _GAP).option("maxRecordsPerFile", 1).text(path)


PAGES = "key string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, intact boolean"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for every response and revisit in the archives of the folder ``path``.

    Columns: ``key`` and ``refers_to`` as text, ``url``, ``record_type``, ``payload_bytes`` and ``payload_digest`` of the full
    payload, ``intact`` (the payload is of the digest that its record names; true for revisits) and, if wanted, ``payload``
    (null for revisits).
    """
    schema = PAGES + ", payload binary" * payloads
    kinds = arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                held, size = [], 0
                for fields, block in records(content.as_py()):
                    if fields["warc-type"] not in (RESPONSE, REVISIT):
                        continue
                    held.append(_page(fields, block))
                    size += len(block)
                    if size >= 4 << 20 or len(held) >= 4096:
                        yield _batch(held, kinds)
                        held, size = [], 0
                if held:
                    yield _batch(held, kinds)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(read, schema)


def _page(fields: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    key, first = (fields.get(name) for name in ("page-key", "refers-to-page-key"))
    named = [None if x is None else unquote(x) for x in (key, first)]
    if fields["warc-type"] == REVISIT:
        size = int(re.search(rb"(?im)^content-length: *(\d+)", head).group(1))
        return named[0], fields.get("warc-target-uri"), REVISIT, named[1], size, digest, True, None
    found = hashlib.sha256(payload).hexdigest()
    return named[0], fields.get("warc-target-uri"), RESPONSE, None, len(payload), found, found == digest, payload


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)
