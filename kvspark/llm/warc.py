"""Legacy web archives: ARC files are written, parsed by version and declared length, and converted to WARC."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kvspark.llm.common import materialize, shared_dir

#: Bytes of records in one archive file; a larger record is a file by itself.
ARCHIVE_BYTES = 8 << 20
#: Payloads at least so long are stored once.
REVISIT_BYTES = 1000
# Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id string, url string, ip string, date string, mime string, size long, digest string, payload binary"


def arc_record(version: int, url: str, ip: str, date: str, mime: str, content: bytes, at: int = 0, file: str = "-") -> bytes:
    """One record: a header line with the fields of its version, then as many bytes as it declares."""
    more = f" 200 {hashlib.md5(content).hexdigest()} - {at} {file}" if version == 2 else ""
    return f"{url} {ip} {date} {mime}{more} {len(content)}\n".encode() + content + b"\n"


def arc_head(version: int, name: str, date: str) -> bytes:
    """The version block that an archive starts with."""
    return arc_record(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", f"{version} 0 kvspark\n{ARC_FIELDS[version]}\n".encode(), 0, name)


def parse_arc(data: bytes) -> Iterator[tuple[str, str, str, str, bytes]]:
    """(url, ip, date, mime, content) of each record but the version block, which says how header lines are read."""
    version, at, end = 0, 0, len(data)
    while at < end:
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        stop = data.find(b"\n", at)
        line = data[at : stop if stop >= 0 else end].decode("utf-8", "replace").rstrip("\r")
        if not version:
            content = data[stop + 1 :] if stop >= 0 else b""
            head = re.match(r"filedesc://\S+ ", line)
            block = content[: int(line.rsplit(" ", 1)[1])] if head and line.rsplit(" ", 1)[1].isdigit() else b""
            if block[:2] not in (b"1 ", b"2 "):
                raise ValueError(f"no version block of an ARC archive: {line[:80]!r}")
            version, at = int(block[:1]), stop + 1 + len(block)
            continue
        fields = line.rsplit(" ", {1: 4, 2: 9}[version])  # a legacy URL may hold spaces
        if len(fields) != {1: 5, 2: 10}[version] or not fields[-1].isdigit():
            raise ValueError(f"at byte {at}: no header line of ARC version {version}: {line[:80]!r}")
        length = int(fields[-1])
        if stop + 1 + length > end:
            raise ValueError(f"at byte {at}: {length} bytes declared, {end - stop - 1} there")
        yield fields[0], fields[1], fields[2], fields[3], data[stop + 1 : stop + 1 + length]
        at = stop + 1 + length


def warc_date(arc_date: str) -> str:
    """ISO time of an ARC date of 8 to 14 digits."""
    d = (arc_date + "0" * 14)[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def record_id(key: str, digest: str) -> str:
    """An identifier that a record of this key and payload gets in any run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}/{digest}')}>"


def _base32(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", _base32(hashlib.sha1(block).digest())), ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def http_block(page_id: str, payload: bytes, mime: str) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: {mime}; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {page_id}\r\n\r\n".encode()


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields in lower case, block) of each record, by declared length."""
    at, end = 0, len(data)
    while at < end:
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or data[at : at + 5] != b"WARC/":
            raise ValueError(f"at byte {at}: no WARC record")
        fields = dict(x.split(": ", 1) for x in data[at:stop].decode().split("\r\n")[1:])
        fields = {k.lower(): v for k, v in fields.items()}
        length = int(fields["content-length"])
        if stop + 4 + length > end:
            raise ValueError(f"at byte {at}: {length} bytes declared, {end - stop - 4} there")
        yield fields, data[stop + 4 : stop + 4 + length]
        at = stop + 4 + length


def _archives(rows: Iterator[bytes], head, trail: bytes) -> Iterator[pa.RecordBatch]:
    """Archives of about ARCHIVE_BYTES, each with a head of its own, less the trail that the file writer adds."""
    parts: list[bytes] = []
    size = number = 0
    for row in rows:
        if not parts:
            parts.append(head(number))
        parts.append(row)
        size += len(row)
        if size >= ARCHIVE_BYTES:
            yield pa.RecordBatch.from_pydict({"value": [b"".join(parts)[: -len(trail)].decode()]})
            parts, size, number = [], 0, number + 1
    if parts:
        yield pa.RecordBatch.from_pydict({"value": [b"".join(parts)[: -len(trail)].decode()]})


def _write(archives: DataFrame, path: str, trail: str, compression: str) -> None:
    """A file for each row, by Spark's own writer, so any file system that it knows will do."""
    archives.write.option("maxRecordsPerFile", 1).option("lineSep", trail).option("compression", compression).text(path)


def _plain(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def write_arc(pages: DataFrame, path: str, *, date: str = "20240101000000") -> None:
    """Archives of pages (page_id, url, html); partitions take turns with versions 1 and 2.  Null html is empty."""
    clean = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7f]", "_"), F.lit("about:blank"))
    rows = pages.select(F.coalesce(F.col("page_id").cast("string"), F.lit("-")), clean, F.coalesce("html", F.lit("")), F.spark_partition_id())

    def run(batches):
        at: dict[str, int] = {}

        def records():
            for batch in batches:
                for page, url, html, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    at["part"] = part
                    body = html.encode()
                    yield arc_record(part % 2 + 1, url, "0.0.0.0", date, "text/html", http_block(page, body, "text/html") + body)

        yield from _archives(records(), lambda n: arc_head(at["part"] % 2 + 1, f"{at['part']:05d}-{n:05d}.arc", date), b"\n")

    _write(rows.mapInArrow(run, "value string"), path, "\n", "gzip")


def arc_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of ARC archives, with their payloads or only their sizes and SHA-1; a broken archive raises."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                found: list[tuple] = []
                size = 0
                for url, ip, date, mime, content in parse_arc(_plain(data.as_py())):
                    head, _, payload = content.partition(b"\r\n\r\n")
                    page = re.search(rb"(?im)^X-Page-Id: (\S+)", head)
                    found.append((page[1].decode() if page else None, url, ip, date, mime, len(payload), hashlib.sha1(payload).hexdigest(), payload if payloads else None))
                    size += len(payload)
                    if size > 4 << 20:
                        yield _batch(found)
                        found, size = [], 0
                if found:
                    yield _batch(found)

    return read_archives(spark, path).mapInArrow(run, RECORD)


def _batch(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["page_id", "url", "ip", "date", "mime", "size", "digest", "payload"])


def arc_to_warc(spark: SparkSession, arc: str, warc: str) -> None:
    """Converts archives: identifiers, times, types and digests are synthesised; of equal payloads one is stored.

    Of records with equal payloads of REVISIT_BYTES at least, that with the largest page number is a response and the
    others are revisits of it; rows that repeat this number are responses too.  Which payloads recur is counted by
    digest before a shuffle, written, and joined: small, it is broadcast by Spark; else its large groups are split.
    """
    met = arc_records(spark, arc, payloads=False).filter(F.col("size") >= REVISIT_BYTES).select("digest", F.expr("try_cast(page_id AS long)").alias("n"))
    again = met.groupBy("digest").agg(F.max("n").alias("refers"), F.count("*").alias("times")).filter("times > 1 AND refers IS NOT NULL")
    again = materialize(again.select(F.col("digest").alias("d"), "refers"))
    joined = arc_records(spark, arc).join(again, (F.col("digest") == F.col("d")) & (F.col("size") >= REVISIT_BYTES), "left").drop("d", "size")

    def run(batches):
        def records():
            for batch in batches:
                for page, url, ip, date, mime, digest, payload, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    page = page or "-"
                    revisit = refers is not None and page != str(refers)
                    head = http_block(page, payload, mime)
                    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", warc_date(date)), ("WARC-Target-URI", url), ("WARC-IP-Address", ip), ("WARC-Payload-Digest", _base32(bytes.fromhex(digest))), ("Content-Type", "application/http; msgtype=response")]
                    if revisit:
                        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(str(refers), digest)), ("X-Refers-To-Page", str(refers))]
                    yield warc_record(fields, head if revisit else head + payload)

        def head(n):
            block = b"software: kvspark\r\nformat: WARC File Format 1.1\r\n"
            return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", warc_date("20240101")), ("Content-Type", "application/warc-fields")], block)

        yield from _archives(records(), head, b"\r\n\r\n")

    _write(joined.mapInArrow(run, "value string"), warc, "\r\n\r\n", "none")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the response and revisit records.

    A payload that is stored is measured; that of a revisit is what its fields and HTTP header say of it.
    """

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                found = []
                for fields, block in parse_warc(_plain(data.as_py())):
                    if (kind := fields["warc-type"]) not in ("response", "revisit"):
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    page = re.search(rb"(?im)^X-Page-Id: (\d+|-\d+)", head)
                    size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    if kind == "revisit":
                        size = int(re.search(rb"(?im)^Content-Length: (\d+)", head)[1])
                        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    refers = fields.get("x-refers-to-page")
                    found.append((int(page[1]) if page else None, size, digest, kind, int(refers) if refers else None))
                if found:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return read_archives(spark, path).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """The query: all pages go to ARC archives, these to WARC archives, and those are read.

    Null html is an empty payload, a null url is about:blank, an empty table gives an empty result.
    """
    base = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_arc(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{base}/arc")
    arc_to_warc(spark, f"{base}/arc", f"{base}/warc")
    return read_warc(spark, f"{base}/warc")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
g AS (SELECT t, max(page_id) AS m, count(*) AS n FROM p WHERE strlen(t) >= 1000 GROUP BY t)
SELECT page_id, CAST(strlen(p.t) AS BIGINT) AS payload_bytes, sha1(p.t) AS payload_digest,
  CASE WHEN n > 1 AND page_id < m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND page_id < m THEN m END AS refers_to
FROM p LEFT JOIN g ON p.t = g.t
"""
