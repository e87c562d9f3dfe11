import hashlib
import struct

import pytest
import zstandard

from promptroute.llm import warc
from tests.llm.helpers import frame

SCHEMA = "page_id long, url string, html string"


def written(spark, tmp_path, pages, **options):
    path = str(tmp_path / "archives")
    warc.write_archives(pages, path, **options)
    return path, warc.read_archives(spark, path)


def archives(path):
    import glob

    return [open(f, "rb").read() for f in sorted(glob.glob(f"{path}/part-*"))]


def expected(rows):
    """Record type and first page of every row, by the contract."""
    out = []
    for key, _, html in rows:
        raw = (html or "").encode()
        keys = [k for k, _, other in rows if (other or "") == (html or "") and k is not None]
        first = min(keys, default=None) if len(raw) >= 100 else None
        revisit = first is not None and key != first
        out.append((str(key) if key is not None else None, len(raw), hashlib.sha256(raw).hexdigest(),
                    "revisit" if revisit else "response", str(first) if revisit else None))
    return sorted(out, key=str)


def found(df):
    return sorted(
        ((r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=str)


ROWS = [
    (3, "http://a.org/", "x" * 100), (1, "http://a.org/b c", "x" * 100), (2, None, "y" * 99), (4, "u\r\nEvil: 1", "y" * 99),
    (5, "", None), (6, "http://é/", ""), (None, "n", "x" * 100), (None, "n", "z" * 200), (None, "m", "z" * 200),
    (7, "l", "é" * 50), (8, "l", "é" * 50), (8, "l", "é" * 50), (9, "l", "WARC/1.1\r\n\r\n" * 20), (10, "l", "P*M\x18\0\0\0\0" * 20),
]


def test_every_row_comes_back(spark, tmp_path):
    pages = frame(spark, ROWS, SCHEMA).repartition(3)
    _, back = written(spark, tmp_path, pages)
    assert found(back) == expected(ROWS)
    rows = back.collect()
    assert all(r.intact for r in rows)
    urls = {r.key: r.url for r in rows}
    assert urls["3"] == "http://a.org/" and urls["1"] == "http://a.org/b%20c" and urls["2"] is None
    assert urls["4"] == "u%0D%0AEvil:%201" and urls["6"] == "http://é/"
    by_key = {r.key: r.payload for r in rows if r.record_type == "response" and r.key}
    assert all(by_key[str(k)] == (h or "").encode() for k, _, h in ROWS if str(k) in by_key)


def test_archives_are_closed_by_size_and_hold_their_dictionary(spark, tmp_path):
    words = [hashlib.sha256(str(i).encode()).hexdigest()[:8] for i in range(400)]
    rows = [(i, f"http://h/{i}", "<p>" + " ".join(words[(i * k) % 400] for k in range(1, 200)) + "</p>") for i in range(600)]
    path, back = written(spark, tmp_path, frame(spark, rows, SCHEMA).coalesce(1), archive_bytes=200_000)
    assert found(back) == expected(rows)
    files = archives(path)
    assert len(files) == -(-sum(len(h) for _, _, h in rows) // 200_000) or len(files) > 3
    for content in files:
        magic, size = struct.unpack_from("<II", content)
        assert magic == 0x184D2A5D and content[8:12] == struct.pack("<I", 0xEC30A437)
        known = zstandard.ZstdCompressionDict(content[8 : 8 + size])
        # Every record is a frame of its own, and any reader of Zstandard with the dictionary reads the whole.
        stream = zstandard.ZstdDecompressor(dict_data=known).stream_reader(content, read_across_frames=True).read()
        parts = [(m, a, b) for m, a, b in warc.frames(content) if m == warc._FRAME]
        assert stream.count(b"WARC/1.1\r\n") == len(parts)
        for _, a, b in parts:
            one = zstandard.ZstdDecompressor(dict_data=known).decompress(content[a:b])
            assert one.startswith(b"WARC/1.1\r\nWARC-Type: ") and one.endswith(b"\r\n\r\n")


def test_frames_of_other_writers_are_walked():
    raw = [b"", b"a" * 500_000, bytes(range(256)) * 2000]
    made = [
        zstandard.ZstdCompressor(write_checksum=check, write_content_size=sized).compress(x)
        for x in raw for check in (True, False) for sized in (True, False)
    ]
    content = struct.pack("<II", 0x184D2A53, 3) + b"abc" + b"".join(made)
    parts = list(warc.frames(content))[1:]
    assert [content[a:b] for _, a, b in parts] == made
    with pytest.raises(ValueError):
        list(warc.frames(b"no archive"))


def test_changed_payload_is_seen():
    good = warc.page_record("1", "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, False, "now")
    (fields, block), = warc.records(warc.archive([good.replace(b"payload\r\n", b"paxload\r\n")]))
    assert warc._page(fields, block)[6] is False
    (fields, block), = warc.records(warc.archive([good]))
    assert warc._page(fields, block)[6] is True


def test_text_keys_other_columns_and_long_pages(spark, tmp_path):
    rows = [("b\n: c", "u", "q" * 3_000_000, 1), ("ä", "u", "q" * 3_000_000, 2), ("z", "u", "short", 3)]
    pages = frame(spark, rows, "name string, link string, body string, payload int")
    pages = pages.selectExpr("*", "payload as digest", "payload as first", "payload as revisit", "payload as key")
    _, back = written(spark, tmp_path, pages, key="name", url="link", payload="body")
    assert {r.key: (r.record_type, r.refers_to, r.payload_bytes) for r in back.collect()} == {
        "b\n: c": ("response", None, 3_000_000), "ä": ("revisit", "b\n: c", 3_000_000), "z": ("response", None, 5)}


def test_empty_table(spark, tmp_path):
    _, back = written(spark, tmp_path, frame(spark, [], SCHEMA))
    assert back.collect() == []


def test_query(spark, sf_dir):
    from promptroute.llm.queries import op11_warc

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = op11_warc(spark, sf_dir)
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert sorted(((str(r[0]), *r[1:4], r[4]) for r in out.collect()), key=str) == expected(rows)
