"""Legacy archive converter: ARC to WARC, with revisit records and a reader.

An ARC archive opens with a ``filedesc`` record whose body names the format version and the
fields of the header lines that follow: five in version 1, ten in version 2.  Each record is a
header line, the declared number of bytes, and a newline.  The converter reads lines by
their version, trusts only declared lengths, and synthesises what WARC wants
beyond that: a record identifier from what the record is, an ISO timestamp from the 14 digits, a record type from the scheme,
and SHA-1 digests of block and payload.

Records with equal payloads become one response and revisits of it.  Spark's text writer puts
records into gzip archives in the shared folder; reading them back follows Content-Length.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import col, scratch_path, ship_with_tasks

# Header fields of the two ARC versions, WARC version and revisit profile.
ARC_FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "result_code", "checksum", "location", "offset", "filename", "length"),
}
ARC_FIELD_LINES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURED = "20240101000000"
RECORDS_PER_ARCHIVE = 2000
RECORD_END = "\r\n\r\n"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---------------------------------------------------------------- ARC

def arc_record(version: int, url: str, date: str, content_type: str, body: bytes, ip: str = "0.0.0.0", status: str = "200", name: str = "-") -> bytes:
    values = {"url": url, "ip": ip, "date": date, "content_type": content_type, "result_code": status, "checksum": "-", "location": "-",
              "offset": "0", "filename": name, "length": str(len(body))}
    line = " ".join(re.sub(r"\s", lambda m: f"%{ord(m.group()):02X}", values[f]) or "-" for f in ARC_FIELDS[version])
    return line.encode("utf-8", "replace") + b"\n" + body + b"\n"


def arc_head(version: int, name: str, date: str = CAPTURED) -> bytes:
    """The record that opens an archive; its line has five fields in both versions."""
    body = f"{version} 0 tablewright\n{ARC_FIELD_LINES[version]}\n\n".encode()
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}\n".encode() + body + b"\n"


def pages_to_arc(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", pages_per_archive: int = 500) -> DataFrame:
    """Pages as ARC archives, (path, content); archives of both versions take turns.

    The page's id travels as an HTTP header of its response.
    """
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, pages_per_archive):
                part = batch.slice(at, pages_per_archive)
                first = part.column(0)[0].as_py()
                version = 1 + zlib.crc32(str(first).encode()) % 2
                name = f"pages-{first}-v{version}.arc"
                out = [arc_head(version, name)]
                for page_id, url, html in zip(*[part.column(k).to_pylist() for k in range(3)]):
                    payload = (html or "").encode("utf-8", "replace")
                    marker = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{marker}Content-Length: {len(payload)}\r\n\r\n"
                    out.append(arc_record(version, url or f"urn:page:{page_id}", CAPTURED, "text/html", http.encode() + payload, name=name))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(out)])], ["path", "content"])

    rows = df.select(col(id_col).alias("page_id"), col(url_col).cast("string").alias("url"), col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "path string, content binary")


def read_arc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(version, header fields, body) of each record but the opening one.

    Raises ValueError where a line doesn't fit the version or a declared length runs past the end.
    """
    at, version = 0, 0
    while at < len(data):
        if data[at:at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no end of the header line at {at}")
        values = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        opening = values[0].startswith("filedesc:")
        names = ARC_FIELDS[1] if opening and len(values) == 5 else ARC_FIELDS.get(version or 1 + (len(values) == 10), ())
        # Some writers left spaces in content types: the outer fields are sure, the middle is what is left.
        if len(values) > len(names) and names:
            extra = len(values) - len(names) + 1
            values[3:3 + extra] = [" ".join(values[3:3 + extra])]
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"not a version {version or '?'} header line at {at}")
        fields, start = dict(zip(names, values)), end + 1
        body = data[start:start + int(values[-1])]
        if len(body) < int(values[-1]):
            raise ValueError(f"record at {at} declares {values[-1]} bytes, {len(body)} are there")
        at = start + len(body)
        if opening:
            version = int(body.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown version {version}")
        else:
            yield version or 1, fields, body


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its empty line, and payload."""
    found = re.search(rb"\r?\n\r?\n", body)
    return (body[:found.end()], body[found.end():]) if body.startswith(b"HTTP/") and found else (b"", body)


RECORDS = ("record_id string, page_key string, record_type string, uri string, date string, ip string, content_type string, http_head binary, payload binary, "
           "payload_bytes bigint, payload_digest string, arc_version int, error string")


def convert_arc(archives: DataFrame) -> DataFrame:
    """WARC record fields of each record in (path, content) ARC archives.

    The type is response for HTTP answers, else resource.  The identifier is a name-based UUID of the page id the
    response names, else of archive and place.  Where an archive breaks off, its records up to there come with one
    more row that holds ``error``.  Null content is an empty archive.
    """
    def fields(path, place, version, head, body):
        http, payload = split_http(body)
        marker = re.search(rb"(?im)^X-Page-Id:[ \t]*([^\r\n]+)", http)
        key = marker[1].decode() if marker else None
        when = (head["date"] + "00000000000000")[:14] if head["date"].isdigit() else CAPTURED
        date = f"{when[:4]}-{when[4:6]}-{when[6:8]}T{when[8:10]}:{when[10:12]}:{when[12:]}Z"
        kind = "response" if http else "resource"
        name = f"page/{key}" if key else f"{path}#{place}"
        return (str(uuid.uuid5(uuid.NAMESPACE_URL, name)), key, kind, head["url"], date, head["ip"], "application/http; msgtype=response" if http else head["content_type"],
                http, payload, len(payload), sha1_base32(payload), version, None)

    names = [f.split()[0] for f in RECORDS.split(", ")]
    types = [{"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32()}[f.split()[1]] for f in RECORDS.split(", ")]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                try:
                    for place, (version, head, body) in enumerate(read_arc(content.as_py() or b"")):
                        rows.append(fields(path, place, version, head, body))
                        if len(rows) == 100:
                            yield table(rows)
                            rows = []
                except ValueError as e:
                    rows.append((None,) * 12 + (f"{path}: {e}",))
                if rows:
                    yield table(rows)

    return archives.select("path", "content").mapInArrow(run, RECORDS)


# ---------------------------------------------------------------- WARC

def revisits(keys: DataFrame) -> DataFrame:
    """(page_id, digest, first_id, n) from (page_id, digest): where a payload was seen first, and rows alike."""
    each = keys.groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    first = each.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    return each.join(first, "digest").where((F.col("n") > 1) | ~F.col("page_id").eqNullSafe(F.col("first_id")))


def warc_record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    lines = [WARC_VERSION, *[f"{k}: {v}" for k, v in fields if v is not None], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block


def _warc_records(batches):
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            revisit = r["refers_to"] is not None or r["again"]
            block = r["http_head"] or b""
            block = block if revisit else block + r["payload"]
            target = None if not revisit else uuid.uuid5(uuid.NAMESPACE_URL, f"page/{r['refers_to']}") if r["refers_to"] is not None else r["record_id"]
            out.append(warc_record([
                ("WARC-Type", "revisit" if revisit else r["record_type"]), ("WARC-Record-ID", f"<urn:uuid:{r['record_id']}>"), ("WARC-Date", r["date"]),
                ("WARC-Target-URI", r["uri"]), ("WARC-IP-Address", r["ip"]), ("Content-Type", r["content_type"]),
                ("WARC-Profile", REVISIT_PROFILE if revisit else None), ("WARC-Refers-To", f"<urn:uuid:{target}>" if revisit else None),
                ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"),
                ("X-Page-Id", r["page_key"]), ("X-Refers-To-Page-Id", r["refers_to"] if revisit else None), ("X-Payload-Length", r["payload_bytes"])], block))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def write_warc(records: DataFrame, path: str, records_per_archive: int = RECORDS_PER_ARCHIVE) -> None:
    """Write converted records, with ``refers_to`` and ``again``, as gzip archives below ``path``.

    The text writer puts bytes down as they are and closes each record with its two line ends.
    """
    (records.mapInArrow(_warc_records, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", RECORD_END).option("maxRecordsPerFile", records_per_archive).text(path, compression="gzip"))


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive, packed or plain, by declared lengths."""
    packed = data[:2] == b"\x1f\x8b"
    unpack = zlib.decompressobj(31)
    buffer, at, step = bytearray(), 0, 1 << 20

    def more() -> bool:
        nonlocal at, unpack
        if at >= len(data):
            return False
        chunk, at = data[at:at + step], at + step
        while chunk:
            if not packed:
                buffer.extend(chunk)
                break
            buffer.extend(unpack.decompress(chunk))
            chunk = unpack.unused_data
            if unpack.eof:
                unpack = zlib.decompressobj(31)
        return True

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer.strip():
                    raise ValueError("an archive ends inside a record's head")
                return
        lines = bytes(buffer[:end]).decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record where one is due: {lines[0][:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        need = end + 4 + int(fields["Content-Length"])
        while len(buffer) < need + 4:
            if not more():
                if len(buffer) < need:
                    raise ValueError("an archive ends inside a record's block")
                break
        yield fields, bytes(buffer[end + 4:need])
        del buffer[:need + 4]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``page_key, record_type, refers_to, uri, date, payload_bytes, payload_digest`` of each record below ``path``.

    Length and digest of a response are of the payload that was read, and must agree with what the record declares.
    """
    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for f, block in read_warc(content.as_py()):
                    size, digest = int(f["X-Payload-Length"]), f["WARC-Payload-Digest"].split(":", 1)[1]
                    if f["WARC-Type"] != "revisit":
                        payload = split_http(block)[1]
                        if (len(payload), sha1_base32(payload)) != (size, digest):
                            raise ValueError(f"payload of {f['WARC-Record-ID']} isn't what the record declares")
                    rows.append((f.get("X-Page-Id"), f["WARC-Type"], f.get("X-Refers-To-Page-Id"), f["WARC-Target-URI"], f["WARC-Date"], size, digest))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.string()] * 5 + [pa.int64(), pa.string()])],
                                                     ["page_key", "record_type", "refers_to", "uri", "date", "payload_bytes", "payload_digest"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_key string, record_type string, refers_to string, uri string, date string, payload_bytes bigint, payload_digest string")


def archive_pages(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Convert pages by way of ARC to WARC archives below ``path``; then ``page_id, payload_bytes, payload_digest,
    record_type, refers_to, uri, date`` as read back from them.

    Of records with equal payloads the one with the smallest page id is the response; others revisit it.  Null html is an
    empty payload, and empty payloads are equal.  A null id comes after all others; of rows that repeat id and payload one
    is the response, if any is.  A null url becomes ``urn:page:<id>``; blanks in a url are percent-encoded.  An empty table gives no archive
    with records and an empty result; further columns are ignored.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    payload = F.coalesce(col(html_col).cast("string"), F.lit(""))
    seen = revisits(df.select(col(id_col).alias("page_id"), F.unhex(F.sha1(payload.cast("binary"))).alias("digest")))
    # One key for join and window: payloads cross the network once.
    key = lambda page, digest: F.struct(page.cast("string").alias("page"), digest.alias("digest"))
    seen = seen.select(key(F.col("page_id"), F.hex("digest")).alias("_key"), F.col("first_id").cast("string").alias("_first"),
                       F.col("page_id").eqNullSafe(F.col("first_id")).alias("_is_first"))
    records = convert_arc(pages_to_arc(df, id_col, url_col, html_col))
    records = records.withColumn("_key", key(F.col("page_key"), F.upper(F.sha1("payload")))).join(seen, "_key", "left")
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("record_id"))
    again = F.col("_is_first").isNotNull() & (~F.col("_is_first") | (nth > 1))
    records = records.withColumn("again", again).withColumn("refers_to", F.when(F.col("again"), F.col("_first"))).drop("_key", "_first", "_is_first")
    write_warc(records, path)
    return (read_archives(spark, path)
            .select(F.col("page_key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "uri", "date"))


def archive_pages_once(df: DataFrame) -> DataFrame:
    """:func:`archive_pages` into a new folder of the shared scratch space."""
    return archive_pages(df, scratch_path(df.sparkSession, "warc"))


ship_with_tasks(__name__)
