"""Archives: against zipfile, with ZIP64 fields, and the records against brute force."""

import hashlib
import io
import zipfile

import pytest

from tallyforge.llm import zipwarc as Z


@pytest.mark.parametrize("zip64", [False, True])
def test_directory(zip64):
    out = io.BytesIO()
    w = Z.ZipWriter(out, zip64)
    w.add("a/é.txt", [b"one", b"two"])
    w.add("empty", [])
    w.add("tail", [b"PK\x05\x06 not the end"])
    w.close()
    raw = out.getvalue()
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and z.read("a/é.txt") == b"onetwo" and z.namelist() == ["a/é.txt", "empty", "tail"]
    members = Z.directory(io.BytesIO(raw), len(raw))
    assert {k: raw[at : at + n] for k, (at, n, _) in members.items()} == {"a/é.txt": b"onetwo", "empty": b"", "tail": b"PK\x05\x06 not the end"}
    with pytest.raises(ValueError):
        Z.directory(io.BytesIO(raw[:-30]), len(raw) - 30)


def test_foreign_archives():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x", b"stored")
        z.comment = b"a comment"
    raw = out.getvalue()
    at, n, _ = Z.directory(io.BytesIO(raw), len(raw))["x"]
    assert raw[at : at + n] == b"stored"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", b"deflated" * 50)
    with pytest.raises(ValueError):
        Z.directory(out, len(out.getvalue()))


def test_record():
    raw = Z.record(7, "http://x/é a\r\nb?q=1%20", b"<p>\r\n\r\n", "d", None, False)
    head, payload = Z.parse(raw)
    assert head["WARC-Target-URI"] == "http://x/%C3%A9%20a%0D%0Ab?q=1%20" and payload == b"<p>\r\n\r\n"
    assert b"\r\n\r\nHTTP/1.1 200 OK\r\n" in raw and head["Content-Type"].startswith("application/http")
    head, payload = Z.parse(Z.record(None, None, b"x", "d", 3, True))
    assert "WARC-Target-URI" not in head and payload == b"" and head["WARC-Refers-To"] == "<urn:page:3>"


def test_pages(spark):
    long = "<p>" + "é" * 60
    rows = [(5, "u5", long), (2, "u2\r\nWARC-Type: x", long), (9, None, long), (1, "u1", "short"), (3, "u3", "short"), (4, "u4", None), (6, "u6", ""), (7, "u7", "\r\n\r\n" * 50), (2, "again", long), (None, "n", long), (8, "u8", "x" * 3_000_000)]
    df = spark.createDataFrame([(i, u, h, "c") for i, u, h in rows], "page_id long, url string, html string, digest string")
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = h == long and i != 2
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None))
    key = lambda r: (r[0] or -1, r[1])
    assert sorted(map(tuple, Z.read_archives(Z.write_archives(df)).collect()), key=key) == sorted(want, key=key)
    rolled = Z.write_archives(df, archive_bytes=150)
    assert rolled.count() > 4 and rolled.agg({"n": "sum"}).first()[0] == len(rows)
    assert sorted(map(tuple, Z.read_archives(rolled).collect()), key=key) == sorted(want, key=key)
    assert Z.read_archives(Z.write_archives(df.limit(0))).collect() == []
