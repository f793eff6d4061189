"""Converts legacy ARC archives to WARC.

An ARC file starts with a version block, whose second line says which version's fields
the header line of every record has; each header ends in the length of what follows. The
converter reads records by declared length and makes the WARC equivalents: an identifier
from the name in the version block and the record's offset, a timestamp from the 14 digits, a type
from the scheme and content, and SHA-1 digests of block and payload. Of records with
equal payloads of at least `least_bytes` bytes one is a response, that with the largest
document id (then the largest identifier); the others become revisits of it, which keep
their HTTP head and no payload.

Archives are written by Spark's text writer (a record is a row of bytes; its separator is
the one the format asks for), so commits and retries are Spark's, and read as whole files
whose records are parsed as a stream. A file holds what one task
read, so its size follows spark.sql.files.maxPartitionBytes.

Nulls: a null payload counts as empty; a null id is written as "-" and read as null; a
null url is written as "unknown:-". White space in a url is percent-encoded. Repeated
rows are records of their own. An empty table gives archives without documents and no
rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.sources.tables import new_path, saved

#: The field lines of the two versions of the format.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ID_HEADER = "X-Document-Id"
_SPACE = re.compile(r"\s")
_LONGEST_LINE = 1 << 20


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def http_head(doc_id: int | None, size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n{ID_HEADER}: {'-' if doc_id is None else doc_id}\r\n\r\n".encode()


def version_block(version: int, name: str, date: str) -> bytes:
    """The first record of an ARC file."""
    body = f"{version} 0 brindle\n{FIELDS[version]}\n".encode()
    url, middle = f"filedesc://{name}", "" if version == 1 else "200 - - 0 - "
    return f"{url} 0.0.0.0 {date} text/plain {middle}{len(body)}\n".encode() + body


def arc_record(version: int, url: str | None, date: str, doc_id: int | None, payload: bytes, name: str, ip: str = "0.0.0.0") -> bytes:
    block = http_head(doc_id, len(payload)) + payload
    url = _SPACE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else "unknown:-"
    middle = "" if version == 1 else f"200 {base32_sha1(payload)} - 0 {name} "
    return f"{url} {ip} {date} text/html {middle}{len(block)}\n".encode() + block


class Stream:
    """Bytes of a file that may be gzip, decompressed as they are asked for."""

    def __init__(self, data: bytes):
        self.view, self.at, self.held, self.offset = memoryview(data), 0, bytearray(), 0
        self.gz = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        part = self.view[self.at : self.at + (1 << 18)]
        if not len(part):
            return False
        if self.gz is None:
            self.at += len(part)
            self.held += part
            return True
        self.held += self.gz.decompress(part)
        self.at += len(part) - len(self.gz.unused_data)
        if self.gz.eof:
            self.gz = zlib.decompressobj(31)
        return True

    def line(self) -> bytes | None:
        """Up to and without the next newline; None at the end."""
        seen = 0
        while (i := self.held.find(b"\n", seen)) < 0:
            seen = len(self.held)
            if seen > _LONGEST_LINE:
                raise ValueError(f"a header line of over {_LONGEST_LINE} bytes at {self.offset}")
            if not self._more():
                if not self.held:
                    return None
                i = len(self.held)
                break
        return self.take(i + 1).rstrip(b"\n")

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        self.offset += len(out)
        return out


@dataclass
class ArcRecord:
    offset: int
    fields: dict[str, str]
    block: bytes


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file after its version block, by the fields that block declares."""
    stream, names = Stream(data), None
    while True:
        offset = stream.offset
        line = stream.line()
        if line is None:
            return
        if not line.strip():
            continue
        values = line.decode("utf-8", "surrogateescape").rstrip("\r").split(" ")
        if names is None:
            if not values[0].startswith("filedesc:"):
                raise ValueError("no version block at the start")
            body = stream.take(int(values[-1])).decode("utf-8", "replace").splitlines()
            version = int(body[0].split(" ")[0])
            names = (body[1] if len(body) > 1 and body[1].strip() else FIELDS[version]).split(" ")
            if names != FIELDS.get(version, "").split(" "):
                raise ValueError(f"version {version} with fields {names}")
            continue
        if len(values) != len(names):  # an unescaped space can only be in the URL
            extra = len(values) - len(names)
            if extra < 0:
                raise ValueError(f"{len(values)} fields at {offset}")
            values = ["%20".join(values[: extra + 1]), *values[extra + 1 :]]
        fields = dict(zip(names, values, strict=True))
        size = int(fields["Archive-length"])
        block = stream.take(size)
        if len(block) < size:
            raise ValueError(f"cut off at {offset}")
        yield ArcRecord(offset, fields, block)


def archive_name(data: bytes) -> str:
    """The name that the version block of an ARC file gives it."""
    line = Stream(data).line() or b""
    return line.split(b" ")[0].removeprefix(b"filedesc:").strip(b"/").decode("utf-8", "replace")


def split_http(url: str, block: bytes) -> tuple[bytes, bytes]:
    """The HTTP head of a block (empty for other schemes) and its payload."""
    if url.startswith(("http:", "https:", "unknown:")) and block.startswith(b"HTTP/") and (i := block.find(b"\r\n\r\n")) >= 0:
        return block[: i + 4], block[i + 4 :]
    return b"", block


def head_value(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower().encode():
            return value.strip().decode("utf-8", "replace")
    return None


def warc_date(digits: str) -> str:
    """ISO 8601 from up to 14 digits; missing ones count as the earliest."""
    d = digits + "00000101000000"[len(digits) :] if len(digits) < 14 else digits
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(archive: str, offset: int) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}"


_RECORD = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("kind", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("ip", T.StringType()), T.StructField("date", T.StringType()), T.StructField("content_type", T.StringType()),
    T.StructField("head", T.BinaryType()), T.StructField("payload", T.BinaryType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
])
_ARROW = pa.schema([
    ("archive", pa.string()), ("record_id", pa.string()), ("doc_id", pa.int64()), ("kind", pa.string()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("content_type", pa.string()),
    ("head", pa.binary()), ("payload", pa.binary()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
])
_BATCH_BYTES = 4 << 20


def _emitted(rows: Iterator[tuple], schema: pa.Schema, size_of) -> Iterator[pa.RecordBatch]:
    """Batches of about _BATCH_BYTES."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += size_of(row) + 200
        if size >= _BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _doc_id(head: bytes) -> int | None:
    value = head_value(head, ID_HEADER)
    return int(value) if value and value.lstrip("-").isdigit() else None


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")


def _equivalents(path: str, content: bytes) -> Iterator[dict]:
    """What the WARC equivalent of each record of an ARC file needs.

    Identifiers come from the name in the archive's version block, so a file that is moved or
    written again keeps them; archives of one data set need names of their own.
    """
    archive, name = path.rpartition("/")[2], archive_name(content)
    for r in read_arc(content):
        url = r.fields["URL"]
        head, payload = split_http(url, r.block)
        yield {
            "archive": archive, "record_id": record_id(name or archive, r.offset), "doc_id": _doc_id(head), "kind": "response" if head else "resource", "url": url,
            "ip": r.fields["IP-address"], "date": warc_date(r.fields["Archive-date"]), "content_type": r.fields["Content-type"], "head": head, "payload": payload,
            "payload_digest": base32_sha1(payload), "payload_bytes": len(payload),
        }


def arc_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the ARC files at a path; without payloads, those are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (r for batch in batches for p, c in zip(*batch.columns, strict=True) for r in _equivalents(p.as_py(), c.as_py()))
        rows = (tuple(None if n == "payload" and not payloads else r[n] for n in _ARROW.names) for r in found)
        yield from _emitted(rows, _ARROW, lambda r: len(r[9] or b""))

    return _files(spark, path).mapInArrow(run, _RECORD)


def _write_rows(rows: DataFrame, path: str, separator: str) -> None:
    """Rows of one binary column as files of these bytes, each followed by the separator."""
    rows.select(F.col(rows.columns[0]).cast("string").alias("value")).write.option("lineSep", separator).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "20050101000000") -> None:
    """ARC files of both versions, one per task by turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"brindle-{part:06d}.arc"
        schema = pa.schema([("value", pa.binary())])

        def rows():
            yield (version_block(version, name, date),)
            for batch in batches:
                for k, u, h in zip(batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), strict=True):
                    yield (arc_record(version, u.as_py(), date, k.as_py(), h.as_py() or b"", name),)

        yield from _emitted(rows(), schema, lambda r: len(r[0]))

    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.col(payload).cast("string").alias("payload"))
    _write_rows(rows.mapInArrow(run, "value binary"), path, "\n")


def warc_record(r: dict, refers: tuple[str, str, str] | None) -> bytes:
    """A WARC/1.1 record; refers: identifier, url and date of the response that a revisit repeats."""
    block = r["head"] if refers else r["head"] + r["payload"]
    kind = "revisit" if refers else r["kind"]
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{r['record_id']}>", f"WARC-Date: {r['date']}", f"WARC-Target-URI: {r['url']}", f"WARC-IP-Address: {r['ip']}",
        f"WARC-Payload-Digest: sha1:{r['payload_digest']}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"Content-Type: {'application/http; msgtype=response' if r['head'] else r['content_type']}", f"Content-Length: {len(block)}",
    ]
    if refers:
        lines[7:7] = [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers[0]}>",
            f"WARC-Refers-To-Target-URI: {refers[1]}", f"WARC-Refers-To-Date: {refers[2]}",
        ]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 0) -> None:
    """ARC files to WARC files, with revisits for repeated payloads."""
    brief = saved(arc_records(spark, arc_path, payloads=False).select("archive", "record_id", "doc_id", "url", "date", "payload_digest", "payload_bytes"), "arc")
    best = F.max_by(F.struct("record_id", "url", "date"), F.struct(F.col("doc_id").isNotNull(), "doc_id", "record_id"))
    winners = saved(brief.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(best.alias("w"), F.count("*").alias("n")).where("n > 1").drop("n"), "winners")
    refers = brief.join(winners, ["payload_digest", "payload_bytes"]).where("record_id != w.record_id")
    # What an archive's own records refer to: as many as it has records at most.
    of_archive = saved(refers.groupBy("archive").agg(F.collect_list(F.struct("record_id", "w")).alias("refers")), "refers")
    files = _files(spark, arc_path).withColumn("archive", F.substring_index("path", "/", -1)).join(of_archive, "archive", "left").select("path", "content", "refers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            info = b"software: brindle\r\nformat: WARC File Format 1.1\r\n"
            name = record_id(f"{warc_path}/{TaskContext.get().partitionId()}", 0)
            yield ("\r\n".join(["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <{name}>", "WARC-Date: 2005-01-01T00:00:00Z", "Content-Type: application/warc-fields", f"Content-Length: {len(info)}"]).encode() + b"\r\n\r\n" + info,)
            for batch in batches:
                for path, content, refers in zip(*batch.columns, strict=True):
                    own = {x["record_id"]: (x["w"]["record_id"], x["w"]["url"], x["w"]["date"]) for x in refers.as_py() or ()}
                    for r in _equivalents(path.as_py(), content.as_py()):
                        yield (warc_record(r, own.get(r["record_id"])),)

        yield from _emitted(rows(), pa.schema([("value", pa.binary())]), lambda r: len(r[0]))

    _write_rows(files.mapInArrow(run, "value binary"), warc_path, "\r\n\r\n")


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every record of a WARC file."""
    stream = Stream(data)
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {stream.offset}")
        headers = {}
        while line := (stream.line() or b"").rstrip(b"\r"):
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.take(size)
        if len(block) < size:
            raise ValueError("a record is cut off")
        yield headers, block


_READ = pa.schema([("doc_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("url", pa.string()), ("payload", pa.binary())])


def warc_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every document record of the WARC files at a path. Digests of responses are those of the bytes read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for content in batch.column(1):
                    for h, block in read_warc(content.as_py()):
                        kind = h["warc-type"]
                        if kind not in ("response", "resource", "revisit"):
                            continue
                        url = h.get("warc-target-uri", "")
                        head, payload = split_http(url, block)
                        stated = h["warc-payload-digest"].partition(":")[2]
                        if kind == "revisit":
                            size, digest, payload = int(head_value(head, "Content-Length") or 0), stated, None
                        else:
                            size, digest = len(payload), base32_sha1(payload)
                            if digest != stated:
                                raise ValueError(f"{h['warc-record-id']}: its payload's digest is {digest}, not {stated}")
                        yield _doc_id(head), h["warc-record-id"].strip("<>"), kind, h.get("warc-refers-to", "").strip("<>") or None, size, digest, url, payload if payloads else None

        yield from _emitted(rows(), _READ, lambda r: len(r[7] or b""))

    return _files(spark, path).mapInArrow(run, "doc_id long, record_id string, record_type string, refers_to_id string, payload_bytes long, payload_digest string, url string, payload binary")


def archived_pages(pages: DataFrame, least_bytes: int = 0, key: str = "page_id") -> DataFrame:
    """Pages written as ARC, converted to WARC and read back: one row per page."""
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc, key)
    convert(spark, arc, warc, least_bytes)
    read = saved(warc_records(spark, warc, payloads=False).drop("payload"), "read")
    named = lambda df: df.select(F.col("doc_id").alias(key), "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url")
    whole = read.where("record_type != 'revisit'").withColumn("record_type", F.lit("response"))
    # Only revisits are joined, with the records that some revisit refers to.
    revisits = read.where("record_type = 'revisit'")
    targets = whole.join(revisits.select(F.col("refers_to_id").alias("record_id")).distinct(), "record_id", "left_semi")
    targets = saved(targets.select(F.col("record_id").alias("refers_to_id"), F.col("doc_id").alias("refers_to")), "targets")
    return named(whole.withColumn("refers_to", F.lit(None).cast("long"))).unionByName(named(revisits.join(targets, "refers_to_id", "left")))


#: DuckDB SQL of the contract's columns: pages with distinct ids, base 32 in groups of five hexadecimal digits.
PAGES_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, t, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS best FROM p)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM d
"""
