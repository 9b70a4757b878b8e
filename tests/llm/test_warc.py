import hashlib
import io
import struct

import pytest
import zstandard

from gleanery.llm import warc

A, B, SMALL = "<p>" + "a" * 200, "<p>" + "é" * 200, "<p>tiny"


def expected(rows):
    out = []
    for page_id, _, html, *_ in rows:
        data = (html or "").encode()
        ids = [p for p, _, h, *_ in rows if (h or "") == (html or "") and p is not None]
        again = len(data) >= 100 and ids and page_id != min(ids)
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(ids) if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rows = [(5, "u", A, 1), (3, None, A, 2), (3, "v", A, 3), (9, "w", B, 4), (None, "x", B, 5), (1, "y", SMALL, 6), (2, "z", SMALL, 7), (4, "", None, 8), (6, "q\r\nX: y", "", 9), (None, "n", "c" * 150, 10)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    out = warc.archived(df).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=repr)
    assert got == expected(rows)
    kept = {r.page_id: r.payload for r in out if r.record_type == "response"}
    assert kept[9] == B.encode() and kept[4] == b"" and kept[6] == b""
    assert warc.archived(df.limit(0)).count() == 0


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    out = warc.archived(pages.unionByName(pages.selectExpr("page_id + 1000 AS page_id", "url", "html"))).collect()
    rows += [(p + 1000, u, h) for p, u, h in rows]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=repr) == expected(rows)


def archive(records):
    out = io.BytesIO()
    n, ended = warc.write_archive(out, iter(records))
    assert ended and n == len(records)
    return out.getvalue()


def made(k, body=b"x"):
    return warc.record(k, "http://a", body * 300, hashlib.sha256(body * 300).hexdigest(), "response", None)


def test_dictionary_frame_and_one_frame_per_record():
    records = [made(k, b"body %d " % k) for k in range(200)]
    data = archive(records)
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.DICTIONARY_FRAME
    known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    assert zstandard.ZstdDecompressor(dict_data=known).decompress(data[8 + size :]) == records[0]  # the first frame alone
    assert list(warc.Archive(io.BytesIO(data)).records()) == records
    bare = struct.pack("<II", warc.DICTIONARY_FRAME, len(known.as_bytes())) + known.as_bytes() + data[8 + size :]
    assert list(warc.Archive(io.BytesIO(bare)).records()) == records
    skip = struct.pack("<II", 0x184D2A50, 3) + b"abc"
    assert list(warc.Archive(io.BytesIO(data + skip)).records()) == records


def test_large_record_over_many_chunks():
    records = [made(1, bytes(range(256)) * 100), made(2)]  # 8 MB
    assert [warc.parsed(r)["page_id"] for r in warc.Archive(io.BytesIO(archive(records))).records()] == [1, 2]


@pytest.mark.parametrize(
    "change",
    [
        lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"),
        lambda r: r.replace(b"WARC-Date", b"X-Date"),
        lambda r: r[:-1],
        lambda r: r.replace(b"xxx", b"xxy", 1),
        lambda r: r.replace(b"sha256:", b"md5:"),
        lambda r: r.replace(b"Content-Length: 300", b"Content-Length: 299"),
        lambda r: r + b"more",
    ],
)
def test_bad_records(change):
    warc.parsed(made(1))
    with pytest.raises(ValueError):
        warc.parsed(change(made(1)))


@pytest.mark.parametrize("cut", [1, 5, 100])
def test_cut_archives(cut):
    data = archive([made(k) for k in range(20)])
    with pytest.raises(ValueError):
        list(warc.Archive(io.BytesIO(data[:-cut])).records())
    with pytest.raises(ValueError):
        list(warc.Archive(io.BytesIO(data + b"\x00" * cut)).records())
