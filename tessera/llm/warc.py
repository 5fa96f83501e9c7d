"""Legacy web archives (ARC) to WARC.

ARC files start with a version block: `filedesc://name ip date type length`, then `version reserved
origin` and the names of the fields of a record's header line. Version 1 has URL, IP address, date, content type
and length; version 2 also result code, checksum, location, offset and file name before the length. A record's block
has the length that its header declares, then a line feed. URLs and content types may hold blanks, as they do in old files: a line is read
by the fields around them. The converter reads that and makes the records that a WARC writer would have made: a warcinfo record of
the version block, name-based identifiers (of the archive, the record's place in it and what it holds), ISO dates, types by content, the
address it came from, SHA-1 digests of the payload behind the HTTP headers. Payloads that repeat become revisit records,
which keep their HTTP headers only. A record that can't be read is reported, with its archive and place, and reading goes on at the
next header line.

Archives are text files whose line separator is the CRLF CRLF that ends a WARC record, so Spark's own
writer makes them wherever the cluster's file system is; bytes pass through it unchanged. That writer compresses a file as
one gzip stream; where records must be reached one by one, write without compression.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import scratch, stored, table

#: Payloads of fewer bytes are always written in full.
LEAST = 1000
#: Bytes of pages in one ARC file, and about as many in one WARC file.
ARC_BYTES, WARC_BYTES = 8 << 20, 32 << 20
SALTS = 16
FIELDS = {1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"], 2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"]}
_DATE = "20240101000000"


class ArcError(ValueError):
    pass


#: How a field looks in a header line. Fixed values of the format.
_FIELD = {"URL": r"(\S.*|)", "IP-address": r"(\S+)", "Archive-date": r"(\d{4,14})", "Content-type": r"(\S.*|-|)", "Archive-length": r"(\d+)"}


def write_arc(name: str, version: int, records: list[tuple], origin: str = "tessera") -> bytes:
    """An ARC file of (url, date, block[, IP address, content type]) records."""
    body = f"{version} 0 {origin}\n{' '.join(FIELDS[version])}\n".encode()
    rest = "text/plain" if version == 1 else f"text/plain 200 - - 0 {name}"
    out = [f"filedesc://{name} 0.0.0.0 {_DATE} {rest} {len(body) + 1}\n".encode() + body + b"\n\n"]
    at = len(out[0])
    for url, date, block, *more in records:
        ip, kind = (*more, "0.0.0.0", "text/html")[:2] if len(more) < 2 else more
        if version == 1:
            line = f"{url} {ip} {date} {kind} {len(block)}\n"
        else:
            line = f"{url} {ip} {date} {kind} 200 {hashlib.md5(block).hexdigest()} - {at} {name} {len(block)}\n"
        out.append(line.encode() + block + b"\n")
        at += len(out[-1])
    return b"".join(out)


def _line(names: list[str]) -> re.Pattern:
    return re.compile(" ".join(_FIELD.get(n, r"(\S+)") for n in names))


def read_arc(data: bytes, problems: list[tuple[int, str]] | None = None):
    """(fields by name, block, place) of each record of an ARC file; the version block comes first, its fields named as version 1 names them.

    What can't be read is a problem: a file without a version block or of an unknown version, a header line that lacks a field, a declared length
    that goes past the end. With a list of problems, (place, what) is put there and reading goes on at the next line that is a
    header line whose length fits; without one, ArcError is raised."""

    def bad(at: int, what: str) -> None:
        if problems is None:
            raise ArcError(f"{what} at byte {at}")
        problems.append((at, what))

    def header(at: int):
        """(match, where the block starts), or None."""
        eol = data.find(b"\n", at)
        eol = eol if eol >= 0 else len(data)
        return line.fullmatch(data[at:eol].decode("utf-8", "surrogateescape").rstrip("\r")), min(eol + 1, len(data))

    if not data.strip(b"\r\n"):
        return
    line = _line(FIELDS[1])
    eol = data.find(b"\n")
    first = data[: max(0, eol)].decode("utf-8", "surrogateescape").rstrip("\r").split(" ")
    if not first[0].startswith("filedesc://") or not first[-1].isdigit() or len(first) < 5:
        bad(0, "no version block")
        return
    at = eol + 1 + int(first[-1])
    head = data[eol + 1 : at].decode("utf-8", "replace").splitlines()
    number = head[0].split()[:1] if head else []
    version = int(number[0]) if number and number[0].isdigit() else 0
    if version not in FIELDS:
        bad(0, f"version {head[:1]}")
        return
    names = head[1].split(" ") if len(head) > 1 and head[1].strip() else FIELDS[version]
    yield {**dict(zip(FIELDS[1], first, strict=False)), "Archive-length": first[-1]}, data[eol + 1 : at], 0
    line = _line(names)
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        got, start = header(at)
        length = int(got[len(names)]) if got else 0
        if got and start + length <= len(data):
            yield dict(zip(names, got.groups(), strict=True)), data[start : start + length], at
            at = start + length
            continue
        bad(at, "a declared length beyond the end" if got else f"no header line of the fields {names}")
        at = start
        while at < len(data):
            got, start = header(at)
            if got and start + int(got[len(names)]) <= len(data):
                break
            at = start


def warc_date(arc_date: str) -> str:
    """14 digits as ISO 8601; shorter dates are filled up with their first moment."""
    if not arc_date.isdigit() or not 4 <= len(arc_date) <= 14:
        raise ArcError(f"date {arc_date!r}")
    full = arc_date + "00000101000000"[len(arc_date) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


_PAGE = re.compile(rb"\r\nX-Page-Id: (-?\d+)\r\n")
_UNSAFE = re.compile(r"[\x00-\x20\x7f\udc80-\udcff]")


def _safe(text: str) -> str:
    """What may not stand in a header line, percent-encoded; bytes that aren't UTF-8 as they are."""
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]) & 0xFF:02X}", text)


def convert(data: bytes, name: str | None = None, problems: list | None = None):
    """(page_id, record_id, type, uri, date, ip, content type, warcinfo's id, head, payload, sha1) of each record of an ARC file.

    The version block becomes a warcinfo record. Blocks that are HTTP responses have type response, and their payload starts behind the headers; any other
    block is a resource with the content type that its header line declares. Identifiers are named by the archive (its digest, if it has no name),
    the record's place, URI, date and digest, so they are the same in every run and no two records share one."""
    name = name or hashlib.sha1(data).hexdigest()
    info = None
    for fields, block, at in read_arc(data, problems):
        uri, date = _safe(fields["URL"]) or "-", warc_date(fields["Archive-date"])
        if info is None:
            uri = uri.removeprefix("filedesc://")
            version = block.split(b"\n", 1)[0].strip().decode("utf-8", "replace")
            block = f"software: tessera\r\nformat: WARC File Format 1.1\r\ndescription: converted from the ARC file {uri}, version {version}\r\n".encode()
        split = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") and b"\r\n\r\n" in block else 0
        head, payload = block[:split], block[split:]
        digest = hashlib.sha1(payload).hexdigest()
        page = _PAGE.search(head)
        record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {at} {uri} {date} {digest}')}>"
        declared = _safe(fields.get("Content-type", "").replace(" ", "")) or "-"
        if info is None:
            kind, content, info, own = "warcinfo", "application/warc-fields", record_id, None
        else:
            kind, own = ("response" if split else "resource"), info
            content = "application/http; msgtype=response" if split else "application/octet-stream" if declared in ("-", "no-type") else declared
        ip = fields.get("IP-address", "-")
        yield int(page[1]) if page else None, record_id, kind, uri, date, None if ip in ("-", "0.0.0.0") else ip, content, own, head, payload, digest


def to_arc(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) as ARC files (name, data), versions 1 and 2 in turn; each file holds about ARC_BYTES."""

    def op(batches):
        k, task = 0, TaskContext.get().partitionId()

        def done():
            name = f"pages-{task}-{k}.arc"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([write_arc(name, 1 + k % 2, held)], pa.binary())], ["name", "data"])

        held, size = [], 0
        for b in batches:
            for page_id, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                html = html or b""
                own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(html)}\r\n\r\n".encode() + html
                held.append((_safe(url or "") or "-", _DATE, block))
                size += len(block)
                if size >= ARC_BYTES:
                    yield done()
                    held, size, k = [], 0, k + 1
        if held:
            yield done()

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(op, "name string, data binary")


_RECORD = "page_id long, record_id string, type string, uri string, date string, ip string, content string, info string, head binary, payload binary, sha1 string"


def from_arc(archives: DataFrame) -> DataFrame:
    """The records of ARC files(name, data): page_id, record_id, type, uri, date, ip, content, info (its warcinfo's id), head, payload, sha1.

    What can't be read is left out here and listed by problems_of(). An archive that is null or empty has no records."""

    def op(batches):
        names, kinds = zip(*(x.split() for x in _RECORD.split(", ")), strict=True)
        types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k] for k in kinds]
        for b in batches:
            for name, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = list(convert(data or b"", name, []))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names)

    return archives.select(F.col("name").cast("string").alias("name"), F.col("data").cast("binary").alias("data")).mapInArrow(op, _RECORD)


def problems_of(archives: DataFrame) -> DataFrame:
    """(name, place, problem) of what can't be read in ARC files(name, data)."""

    def op(batches):
        for b in batches:
            for name, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found: list[tuple[int, str]] = []
                for _ in read_arc(data or b"", found):
                    pass
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found)), pa.array([at for at, _ in found], pa.int64()), pa.array([x for _, x in found])], ["name", "place", "problem"])

    return archives.select(F.col("name").cast("string").alias("name"), F.col("data").cast("binary").alias("data")).mapInArrow(op, "name string, place long, problem string")


def deduplicated(records: DataFrame) -> DataFrame:
    """records with refers_to, refers_id, refers_uri and refers_date: of the response that a record revisits, else null.

    Of records with equal payloads of at least LEAST bytes, that with the largest page_id is the response; without
    any page_id, all are. Rows that repeat that page_id are responses too. Digests are counted from narrow rows;
    what is joined back is one row per repeated payload, so the payload itself meets a hot digest only in salted parts."""
    size = F.octet_length("payload").alias("n")
    narrow = records.select("sha1", size, "page_id", "record_id", "uri", "date", "type").where((F.col("n") >= LEAST) & (F.col("type") != "warcinfo"))
    best = narrow.groupBy("sha1", "n").agg(F.count(F.lit(1)).alias("copies"), F.max(F.struct("page_id", "record_id", "uri", "date")).alias("best"))
    best = best.where("copies > 1 and best.page_id is not null").select("sha1", "n", F.col("best.page_id").alias("best_id"), F.col("best.record_id").alias("best_record"), F.col("best.uri").alias("best_uri"), F.col("best.date").alias("best_date"))
    best = stored(best, "responses")
    dealt = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = records.withColumn("n", size).withColumn("salt", F.pmod(F.xxhash64("page_id", "record_id"), F.lit(SALTS)).cast("int"))
    both = salted.join(dealt, ["sha1", "n", "salt"], "left").drop("salt", "n")
    again = F.col("best_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best_id"))
    out = both
    for to, of in (("refers_to", "best_id"), ("refers_id", "best_record"), ("refers_uri", "best_uri"), ("refers_date", "best_date")):
        out = out.withColumn(to, F.when(again, F.col(of)))
    return out.drop("best_id", "best_record", "best_uri", "best_date")


def to_warc(records: DataFrame):
    """A WARC record per row, without the CRLF CRLF that ends it, as a string column of raw bytes."""
    text = lambda c: F.col(c).cast("string")
    again = F.col("refers_to").isNotNull()
    # Base 32 of 20 bytes: 32 groups of 5 bits.
    bits = F.concat(*(F.lpad(F.conv(F.substring("sha1", i, 2), 16, 2), 8, "0") for i in range(1, 41, 2)))
    digits = F.concat(*(F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.conv(F.substring("bits", i, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(1, 161, 5)))
    block = F.concat(text("head"), F.when(again, F.lit("")).otherwise(text("payload")))
    referred = F.when(
        again,
        F.concat(
            F.lit("WARC-Refers-To: "), "refers_id", F.lit("\r\nWARC-Refers-To-Target-URI: "), "refers_uri", F.lit("\r\nWARC-Refers-To-Date: "), "refers_date",
            F.lit("\r\nX-Refers-To-Page: "), F.col("refers_to").cast("string"), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
        ),
    ).otherwise(F.lit(""))
    kind = F.when(again, "revisit").otherwise(F.col("type"))
    line = lambda name, c: F.coalesce(F.concat(F.lit(f"{name}: "), c, F.lit("\r\n")), F.lit(""))
    target = F.when(F.col("type") == "warcinfo", line("WARC-Filename", F.col("uri"))).otherwise(line("WARC-Target-URI", F.col("uri")))
    return records.withColumn("bits", bits).withColumn("base32", digits).withColumn("block", block).select(
        F.concat(
            F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), "record_id", F.lit("\r\nWARC-Date: "), "date", F.lit("\r\n"), target, line("WARC-IP-Address", F.col("ip")), line("WARC-Warcinfo-ID", F.col("info")),
            F.lit("WARC-Payload-Digest: sha1:"), "base32", F.lit("\r\n"), referred, F.lit("Content-Type: "), "content",
            F.lit("\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n\r\n"), "block",
        ).alias("value")
    )


def write_warc(records: DataFrame, path: str, per_file: int, compression: str = "gzip") -> None:
    """records (as deduplicated() gives them) to WARC files of at most per_file records each; compression: gzip, one stream a file, or none."""
    to_warc(records).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", max(1, per_file)).option("compression", compression).text(path)


def parse_warc(data: bytes):
    """(headers, block) of each record of a WARC file."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])
        size = int(headers["Content-Length"])
        if end + 4 + size > len(data):
            raise ValueError(f"the record at byte {at} is cut off")
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 8 + size


def read_warc(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record in the archives under path.

    A response's bytes and digest are taken from its payload and held against its headers; a revisit's come
    from its own headers, HTTP and WARC."""

    def op(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                rows = [_read(h, block) for h, block in parse_warc(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(op, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _read(headers: dict, block: bytes):
    kind = headers["WARC-Type"]
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    split = block.find(b"\r\n\r\n") + 4 if kind in ("response", "revisit") else 0
    head = block[:split]
    page = _PAGE.search(head)
    if kind == "revisit":
        size = int(re.search(rb"\r\nContent-Length: (\d+)\r\n", head)[1])
    else:
        size = len(block) - split
        if hashlib.sha1(block[split:]).hexdigest() != digest:
            raise ValueError(f"digest of {headers['WARC-Record-ID']}")
    refers = headers.get("X-Refers-To-Page")
    return int(page[1]) if page else None, size, digest, kind, int(refers) if refers else None


def archived(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) through ARC files and the converter into WARC archives, and read back.

    Null html counts as empty, a null url as "-"; rows without a page_id come back without one. Extra columns are left aside, repeated rows
    archived each. An empty table gives an empty result."""
    spark = pages.sparkSession
    records = from_arc(to_arc(pages))
    size = pages.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col("html").cast("string"))).alias("s")).first()
    path = scratch(spark, "warc")
    write_warc(deduplicated(records), path, size["n"] * WARC_BYTES // max(1, (size["s"] or 0) + 500 * size["n"]) or 1)
    return read_warc(spark, path).where("record_type <> 'warcinfo'")


def op5_arc_to_warc(spark, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


OP5_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS best FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= {LEAST} AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {LEAST} AND page_id <> best THEN best END AS refers_to FROM w
"""
