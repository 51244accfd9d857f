"""Legacy archives: ARC files parsed by their declared header version, and WARC records made of them.

``parse_arc`` reads the version block, whose second line names the fields of every later header line (version 1 has
five, version 2 ten), and takes each body by its declared length.  ``warc_record`` gives a record its WARC type
(filedesc: warcinfo, HTTP: response or revisit, else resource), a time stamp from the ARC date, SHA-1 digests of
block and payload, and an identifier that is a function of URL, date and content, so a task that runs again writes the
same record.  Archives are one gzip member a record; an empty member stands between two.

Defined cases: null payloads are empty, a null or blank address becomes ``unknown:`` and blanks inside one are
percent-encoded; pages with a null id are written and read back with a null id; rows that repeat the largest id of a
payload are all responses, and equal payloads with no id at all as well; an empty table makes an empty archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_values, checkpointed, fits_broadcast, map_rows

ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
MIN_REVISIT = 1000
#: An archive is written in blocks of whole records of about so many bytes (one larger record is a block), and holds so many blocks at most.
BLOCK, BLOCKS = 8 << 20, 8
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)


def address(url: str | None) -> str:
    return re.sub(r"[^\x21-\x7E]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "unknown:"


def arc_file(records: list[tuple[str, str, str, bytes]], version: int = 1) -> bytes:
    """An uncompressed ARC file of (url, date, content type, body) records."""
    body = f"{version} 0 freshet\n{ARC_FIELDS[version]}\n".encode()
    rest = [] if version == 1 else ["200", "-", "-", "0", "-"]
    out = []
    for url, date, kind, data in [("filedesc://pages.arc", "19960101000000", "text/plain", body), *records]:
        out.append(" ".join([address(url), "0.0.0.0", date, kind, *rest, str(len(data))]).encode() + b"\n" + data + b"\n")
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, body) of each record, the version block first."""
    at, names = 0, ARC_FIELDS[1].lower().split()
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at : len(data) if end < 0 else end].rstrip(b"\r")
        if not line.strip():
            at = end + 1 if end >= 0 else len(data)
            continue
        text, first = line.decode("utf-8", "replace"), line.startswith(b"filedesc:")
        if first:  # its own line may be of either version; its body says what follows
            length = int(text.rsplit(" ", 1)[1])
            lines = data[end + 1 : end + 1 + length].decode("utf-8", "replace").splitlines()
            names = lines[1].lower().split() if len(lines) > 1 else names
        values = text.rsplit(" ", len(names) - 1)  # an address may hold blanks
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"not an ARC header line of {len(names)} fields: {text[:200]!r}")
        fields = dict(zip(names, values, strict=True))
        start, length = end + 1, int(fields["archive-length"])
        if start + length > len(data):
            raise ValueError(f"the archive ends inside the record of {fields['url'][:200]}")
        yield fields, data[start : start + length]
        at = start + length


def iso_date(arc_date: str) -> str:
    """14, 12 or 8 digits to a WARC date; what is missing is the earliest that fits."""
    d = re.sub(r"\D", "", arc_date)
    d = (d + "19700101000000"[len(d) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, digest: str, salt: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {salt}')}>"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """(headers with the blank line, payload)."""
    at = body.find(b"\r\n\r\n")
    return (body[: at + 4], body[at + 4 :]) if at >= 0 else (body, b"")


def warc_record(fields: dict[str, str], body: bytes, salt: str = "", refers_to: str | None = None, extra: dict[str, str] | None = None) -> bytes:
    """One WARC/1.1 record made of an ARC record; a revisit where ``refers_to`` names another."""
    url, date = fields["url"], iso_date(fields["archive-date"])
    http = body.startswith(b"HTTP/")
    head, payload = split_http(body) if http else (b"", body)
    digest = _digest(payload)
    kind = "warcinfo" if url.startswith("filedesc:") else "revisit" if http and refers_to else "response" if http else "resource"
    block = head if kind == "revisit" else body
    lines = {
        "WARC-Type": kind, "WARC-Record-ID": record_id(url, date, digest, salt), "WARC-Date": date, "WARC-Target-URI": None if kind == "warcinfo" else url, "WARC-IP-Address": fields.get("ip-address"),
        "WARC-Profile": _PROFILE if kind == "revisit" else None, "WARC-Refers-To": refers_to if kind == "revisit" else None, "WARC-Payload-Digest": None if kind == "warcinfo" else digest, "WARC-Block-Digest": _digest(block),
        "Content-Type": "application/http;msgtype=response" if http else fields.get("content-type", "application/octet-stream"), **(extra or {}), "Content-Length": str(len(block)),
    }
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in lines.items() if v is not None), "\r\n"]).encode() + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields in lower case, block) of each record of a gzip-member or plain archive."""
    plain = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    with io.BufferedReader(plain, 1 << 17) as stream:
        while version := stream.readline():
            if not version.startswith(b"WARC/"):
                raise ValueError(f"not a WARC version line: {version[:100]!r}")
            fields = {}
            while line := stream.readline().rstrip(b"\r\n"):
                name, _, value = line.decode("utf-8").partition(":")
                fields[name.lower()] = value.strip()
            block = stream.read(int(fields["content-length"]))
            stream.read(4)
            yield fields, block


def _cut(batches, most):
    """Parts of the batches with about ``most`` bytes of payload, which is their third column."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _members(batches, version):
    """(archive bytes) rows, of many records each: pages as an ARC file, that file converted record by record."""
    out, held = [], 0
    for batch in _cut(batches, BLOCK):
        ids, urls, firsts, first_urls = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
        pages = []
        for url, payload in zip(urls, binary_values(batch.column(2)), strict=True):
            payload = payload or b""
            pages.append((url, "20200101000000", "text/html", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload))
        converted = parse_arc(arc_file(pages, version))
        next(converted)
        for page, first, first_url, (fields, body) in zip(ids, firsts, first_urls, converted, strict=True):
            refers = None
            if first is not None and first != page:
                date = iso_date(fields["archive-date"])
                refers = record_id(address(first_url), date, _digest(split_http(body)[1]), str(first))
            extra = {} if page is None else {"Page-ID": str(page)}
            member = gzip.compress(warc_record(fields, body, str(page), refers, extra), 1, mtime=0)
            if out and held + len(member) > BLOCK:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["value"])
                out, held = [], 0
            out.append(member)
            held += len(member)
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["value"])


def write_archives(pages: DataFrame, path: str, version: int = 1) -> None:
    """Write (id, url, payload, first, first_url) rows to ``part-*.warc.gz`` files of bounded size under ``path``."""
    spark = pages.sparkSession
    members = map_rows(pages.select("id", "url", "payload", "first", "first_url"), lambda b: _members(b, version), "value binary")
    # The text sink writes a value's bytes as they are, and its separator is the empty gzip member.
    (members.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY_MEMBER.decode("latin-1"))
        .option("maxRecordsPerFile", BLOCKS).text(path))
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.globStatus(jvm.org.apache.hadoop.fs.Path(folder, "part-*.txt")):
        name = status.getPath().getName()
        system.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name[:-4] + ".warc.gz"))


def read_archives(spark, path: str) -> DataFrame:
    """(record_id, type, page_id, payload_bytes, payload_digest, refers_to) of the archived pages."""

    def rows(batches):
        for batch in batches:
            out = []
            for data in batch.column(0).to_pylist():
                for fields, block in parse_warc(data):
                    head, payload = split_http(block)
                    size = len(payload)
                    digest = hashlib.sha1(payload).hexdigest()
                    if fields["warc-type"] == "revisit":  # its payload is elsewhere: the headers have length and digest
                        size = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)[1])
                        digest = base64.b32decode(fields["warc-payload-digest"][5:]).hex()
                    page = fields.get("page-id")
                    out.append((fields["warc-record-id"], fields["warc-type"], page, size, digest, fields.get("warc-refers-to")))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
            columns = list(zip(*out, strict=True)) or [[]] * 6
            names = ["record_id", "type", "page_id", "payload_bytes", "payload_digest", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.warc.gz").load(path)
    return map_rows(files.select("content"), rows, "record_id string, type string, page_id string, payload_bytes bigint, payload_digest string, refers_to string")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", version: int = 1, path: str | None = None, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write the pages as archives and read them back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    With no ``path`` the archives stand in the shared checkpoint folder until they have been read.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    plain = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(payload_col, F.lit("")), "UTF-8").alias("payload"))
    plain = plain.withColumn("sha", F.sha1("payload"))
    first = F.max_by(F.struct("id", "url"), "id").alias("f")
    repeated = plain.where(F.octet_length("payload") >= min_revisit).groupBy("sha").agg(first, F.count("*").alias("n")).where("n > 1 AND f.id IS NOT NULL")
    repeated = checkpointed(repeated.select("sha", F.col("f.id").alias("first"), F.col("f.url").alias("first_url")))
    few = fits_broadcast(repeated, 128 + F.coalesce(F.octet_length("first_url"), F.lit(0)))
    marked = plain.join(F.broadcast(repeated) if few else repeated, "sha", "left")
    folder = path or f"{_shared(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(marked, folder, version)
    back = checkpointed(read_archives(spark, folder))
    if path is None:
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    referred = back.where("type = 'response'").select(F.col("record_id").alias("rid"), F.col("page_id").alias("referred"))
    referred = referred.join(back.where("type = 'revisit'").select(F.col("refers_to").alias("rid")).distinct(), "rid").distinct()
    return back.join(referred, back.refers_to == referred.rid, "left").select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("referred").cast(kind).alias("refers_to")
    )


def _shared(spark) -> str:
    checkpointed(spark.range(0))  # makes the folder known
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def op6_arc_to_warc(spark, sf_dir: str) -> DataFrame:
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) b FROM pages), h AS (SELECT page_id, octet_length(b) n, sha1(b) d FROM p),
g AS (SELECT d, max(page_id) first FROM h WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) payload_bytes, d payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END record_type,
  CASE WHEN first <> page_id THEN first END refers_to FROM h LEFT JOIN g USING (d)
"""
