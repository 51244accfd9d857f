import gzip
import hashlib

import pyarrow as pa
import pytest
from fixtures import messy_tables, prose, SCHEMAS

from freshet.llm import warc

BODY = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>text</p>"


@pytest.mark.parametrize("version", [1, 2])
def test_arc_of_either_version(version):
    records = [("http://a.example/", "19990102030405", "text/html", BODY), ("http://b.example/ x", "20000101", "text/plain", b""), ("", "2001", "a/b", b"\n\nhttp://no header\n")]
    found = list(warc.parse_arc(warc.arc_file(records, version)))
    assert found[0][0]["url"].startswith("filedesc:")
    assert [(f["url"], b) for f, b in found[1:]] == [("http://a.example/", BODY), ("http://b.example/%20x", b""), ("unknown:", b"\n\nhttp://no header\n")]
    assert found[1][0]["archive-length"] == str(len(BODY)) and ("result-code" in found[1][0]) == (version == 2)


def test_a_version_block_changes_the_fields_that_follow():
    data = warc.arc_file([("http://a/", "20000101000000", "t/h", b"1")], 1) + warc.arc_file([("http://b/", "20000101000000", "t/h", b"22")], 2)
    assert [(f["url"], b) for f, b in warc.parse_arc(data) if not f["url"].startswith("filedesc:")] == [("http://a/", b"1"), ("http://b/", b"22")]


@pytest.mark.parametrize("data", [b"http://a/ 0.0.0.0 2000 t/h notanumber\nx\n", b"http://a/ 0.0.0.0 2000 t/h 99\nshort\n", b"nonsense\n"])
def test_broken_archives_are_refused(data):
    with pytest.raises(ValueError):
        list(warc.parse_arc(data))


def test_dates():
    assert [warc.iso_date(d) for d in ("19990102030405", "199901020304", "19990102", "1999", "")] == ["1999-01-02T03:04:05Z", "1999-01-02T03:04:00Z", "1999-01-02T00:00:00Z", "1999-01-01T00:00:00Z", "1970-01-01T00:00:00Z"]


def test_record_types_and_round_trip():
    fields = {"url": "http://a.example/ü", "archive-date": "19990102030405", "content-type": "text/html", "ip-address": "1.2.3.4"}
    made = [warc.warc_record(fields, BODY), warc.warc_record(fields, BODY, "x", "<urn:uuid:1>"), warc.warc_record(fields, b"plain"), warc.warc_record(fields | {"url": "filedesc://x"}, b"1 0 x\n")]
    found = list(warc.parse_warc(b"".join(gzip.compress(m) + gzip.compress(b"") for m in made)))
    assert [f["warc-type"] for f, _ in found] == ["response", "revisit", "resource", "warcinfo"]
    assert found[0][1] == BODY and found[1][1] == BODY[: BODY.index(b"<p>")] and found[1][0]["warc-refers-to"] == "<urn:uuid:1>"
    assert found[0][0]["warc-date"] == "1999-01-02T03:04:05Z" and found[0][0]["warc-payload-digest"] == found[1][0]["warc-payload-digest"]
    assert warc.warc_record(fields, BODY) == made[0]  # the same identifier each time
    assert list(warc.parse_warc(b"".join(made))) == found


def test_pages_against_brute_force(spark, tmp_path):
    rows = messy_tables()["pages"] + [(10, "u", prose(1, 400), "c", "c"), (12, "v", prose(1, 400), "c", "c"), (11, "w", prose(1, 400), "c", "c"), (13, "w", "short", "c", "c"), (14, "w", "short", "c", "c")]
    pages = spark.createDataFrame(rows, SCHEMAS["pages"]).repartition(3)
    want = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        alike = [p for p, _, h, *_ in rows if (h or "").encode() == data and p is not None]
        first = max(alike, default=None) if len(data) >= 1000 else None
        revisit = first is not None and first != page
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    for version in (1, 2):
        got = warc.archive_pages(pages, version=version, path=str(tmp_path / f"v{version}")).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
        files = list((tmp_path / f"v{version}").glob("part-*.warc.gz"))
        assert sum(1 for f in files for _ in warc.parse_warc(f.read_bytes())) == len(rows)


@pytest.mark.parametrize("block", [1, 2_000, 8 << 20])
def test_blocks_are_bounded_by_bytes(monkeypatch, block):
    monkeypatch.setattr(warc, "BLOCK", block)
    payloads = [prose(k, 300).encode() for k in range(20)] + [None, b"", b"x" * 100_000]
    columns = [list(range(23)), [f"u{k}" for k in range(23)], payloads, [None] * 23, [None] * 23]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list("abcde"))
    rows = [r for b in warc._members([batch.slice(0, 9), batch.slice(9, 0), batch.slice(9)], 1) for r in b.column(0).to_pylist()]
    found = [[(f["page-id"], warc.split_http(x)[1]) for f, x in warc.parse_warc(r)] for r in rows]
    assert [x for row in found for x in row] == [(str(k), p or b"") for k, p in enumerate(payloads)]
    assert all(len(r) <= block or len(row) == 1 for r, row in zip(rows, found, strict=True))
    assert len(rows) == {1: 23, 8 << 20: 1}.get(block, len(rows)) and (block != 2_000 or 1 < len(rows) < 23)
