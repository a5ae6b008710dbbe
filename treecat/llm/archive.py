"""Legacy archive converter: ARC files to WARC files.

ARC files open with a ``filedesc://`` record whose body names the version and
the fields of every header line; a record is one header line, then as many
bytes as the line declares. The converter parses versions 1 and 2, plain or
gzipped (as a whole or record by record), and gives every record what WARC asks
for: a type, an identifier, a timestamp and digests. HTTP responses whose
payloads repeat become ``revisit`` records; what is no HTTP response (DNS
answers, plain files) becomes a ``resource``.

A record is known by its file and its place there, so archives of any origin
convert. Tasks get paths and stream the files themselves, so no archive is
ever a row, whatever its size, and payloads are not shuffled: what is hashed
once is written as a table of digests, the repeats are found among those, and
each file's task gets its own records' marks.

Every record is one gzip member, as WARC readers that jump to an offset want.
Files are written by Spark's text writer, so any Hadoop file system and
committer works (see ``gzip_lines``).
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.streams import open_input
from ._shared import cut, new_folder, slices, table

# Fixed values of the formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A gzip member's header up to its open name field.
_MEMBER = b"\x1f\x8b\x08\x08" + b"\0" * 5 + b"\xffrecord"

_FLUSH = 8 << 20


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight: int) -> Iterator[pa.RecordBatch]:
    """Record batches of about 8 MB, by the length of the binary at ``weight``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight] or b"") + 200
        if size >= _FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_LINE = pa.schema([("line", pa.binary())])


def gzip_lines(records: Iterator[bytes]) -> Iterator[bytes]:
    """Records as gzip members, in lines that a NUL separates.

    A line ends with the next member's header up to its name, which the
    separator then ends; the NUL behind the last one is padding, which gzip
    allows. So the text writer's file is a plain series of members.
    """
    line = None
    for record in records:
        packer = zlib.compressobj(1, zlib.DEFLATED, -15)  # a fast level: the payloads are read back soon
        body = packer.compress(record) + packer.flush() + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
        if line is None:
            line = _MEMBER + b"\0" + body
        else:
            yield line + _MEMBER
            line = body
    if line is not None:
        yield line


def _write(lines: DataFrame, path: str) -> None:
    """One file per partition, in row order; bytes pass through the text writer unchanged."""
    lines.select(F.col("line").cast("string")).write.text(path, compression="none", lineSep="\0")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """``(path)`` of every file below ``path``, dealt over partitions by size; no content is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")


def unzipped(stream: io.BufferedReader) -> io.BufferedReader:
    """The stream, through gzip if it opens like gzip."""
    return io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20) if stream.peek(2)[:2] == b"\x1f\x8b" else stream


def _field(value: object, gap: str = "%20") -> str:
    """A header line's field: no blanks or line ends, never empty."""
    return re.sub(r"[\s\x00]", gap, str(value)) if value not in (None, "") else "-"


# --- ARC ---------------------------------------------------------------------


def arc_opening(version: int, name: str, archived: str) -> bytes:
    body = f"{version} 0 treecat\n{ARC_FIELDS[version]}\n".encode()
    extra = "" if version == 1 else "200 - - 0 " + name + " "
    return f"filedesc://{name} 0.0.0.0 {archived} text/plain {extra}{len(body)}\n".encode() + body


def arc_record(version: int, url: object, ip: str, archived: str, kind: str, body: bytes, name: str = "-", code: int = 200) -> bytes:
    extra = "" if version == 1 else f"{code} {hashlib.md5(body).hexdigest()} - 0 {name} "
    return f"{_field(url)} {ip} {archived} {kind} {extra}{len(body)}\n".encode() + body


def http_response(payload: bytes, headers: dict[str, object]) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{lines}\r\n".encode() + payload


def write_arc(pages: DataFrame, path: str, archived: str = "19970101000000", versions: tuple = (1, 2)) -> None:
    """``pages(page_id, url, html)`` as ARC files, the versions by turns over the partitions.

    The page's id travels as an HTTP header; a null html is an empty body.
    """

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name = versions[part % len(versions)], f"part-{part:05d}.arc"

        def records() -> Iterator[bytes]:
            yield arc_opening(version, name, archived) + b"\n"
            for b in slices(batches):
                for page, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    payload = html.encode("utf-8", "surrogatepass") if html else b""
                    body = http_response(payload, {} if page is None else {"X-Page-Id": page})
                    yield arc_record(version, url, "0.0.0.0", archived, "text/html", body, name) + b"\n"

        yield from _batches(((x,) for x in gzip_lines(records())), _LINE, 0)

    _write(pages.select("page_id", "url", "html").mapInArrow(lines, "line binary"), path)


def parse_arc(stream: io.BufferedIOBase) -> Iterator[dict]:
    """The records of one ARC stream, by the fields of its own version.

    Raises ValueError where the opening record, a header line or a declared
    length does not fit.
    """
    fields, opening = None, True
    while line := stream.readline():
        if not line.strip(b"\r\n\0 "):
            continue
        parts = line.rstrip(b"\r\n").decode("utf-8", "replace").split(" ")
        if opening and (len(parts) < 5 or not parts[0].startswith("filedesc://")):
            raise ValueError(f"not an ARC file: it opens with {line[:80]!r}")
        if not opening and len(parts) != len(fields):
            raise ValueError(f"a header line has {len(parts)} fields, not {len(fields)}: {line[:80]!r}")
        if not parts[-1].isdigit():
            raise ValueError(f"no length in {line[:80]!r}")
        body = stream.read(int(parts[-1]))
        if len(body) != int(parts[-1]):
            raise ValueError(f"{len(body)} of {parts[-1]} declared bytes after {line[:80]!r}")
        if opening:
            version, names = body.split(b"\n")[:2]
            number = int(version.split(b" ")[0])
            if number not in ARC_FIELDS:
                raise ValueError(f"ARC version {number} is not known")
            fields, opening = names.decode().strip().split(" "), False
            continue
        yield dict(zip(fields, parts)) | {"body": body}


def _arc_records(path: str) -> Iterator[dict]:
    with open_input(path) as stream:
        yield from parse_arc(unzipped(stream))


# --- WARC --------------------------------------------------------------------


def split_http(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Head (with its blank line), header fields by lower-case name, payload; no head and the whole block if it is no HTTP response."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        return b"", {}, block
    named = (x.partition(b":") for x in head.split(b"\r\n")[1:])
    return head + mark, {k.decode("latin-1").strip().lower(): v.decode("latin-1").strip() for k, _, v in named}, payload


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d{1,18}", text) else None


def record_id(file: str, position: int, digest: str) -> str:
    """An identifier from the record's place, so that equal payloads elsewhere have others."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{position}:{digest}')}>"


def warc_date(archived: str) -> str:
    """14 digits (short ones are padded) as an ISO timestamp in UTC."""
    full = archived + "00000101000000"[len(archived) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def warc_record(headers: dict[str, object], block: bytes) -> bytes:
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in headers.items() if v is not None)
    return WARC_VERSION + b"\r\n" + lines + f"Content-Length: {len(block)}\r\n\r\n".encode() + block


_DIGESTS = pa.schema([("file", pa.string()), ("position", pa.int64()), ("page_id", pa.int64()), ("http", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def arc_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(file, position, page_id, http, payload_bytes, payload_digest)`` of all records of all ARC files below ``path``.

    ``page_id`` is the number that an HTTP header ``X-Page-Id`` names, if there is one.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for file in b.column("path").to_pylist():
                    for n, r in enumerate(_arc_records(file)):
                        head, fields, payload = split_http(r["body"])
                        yield file, n, _number(fields.get("x-page-id")), bool(head), len(payload), hashlib.sha256(payload).hexdigest()

        yield from _batches(rows(), _DIGESTS, 5)

    return _files(spark, path).mapInArrow(digests, "file string, position long, page_id long, http boolean, payload_bytes long, payload_digest string")


def repeated(digests: DataFrame, least_bytes: int = 100, most_broadcast: int = 200_000) -> DataFrame:
    """``digests`` with ``first``, the record that a revisit refers to; null where a record stays.

    Of HTTP responses with equal payloads of ``least_bytes`` or more, the first
    is the one with the smallest page_id, or without page ids the first by file
    and position. Records that repeat the first one's page_id stay. A list of
    repeated digests of up to ``most_broadcast`` is broadcast; beyond it digests
    are shuffled, one row a record, in a join that AQE splits at a hot payload.
    """
    order = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "file", "position")
    found = digests.where(F.col("http") & (F.col("payload_bytes") >= least_bytes)).groupBy("payload_digest")
    found = cut(found.agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "repeats")
    found = F.broadcast(found) if found.count() <= most_broadcast else found
    marked = digests.join(found.withColumn("http", F.lit(True)), ["payload_digest", "http"], "left")
    same_page = F.col("page_id").eqNullSafe(F.col("first.page_id")) & F.col("page_id").isNotNull()
    same_place = (F.col("file") == F.col("first.file")) & (F.col("position") == F.col("first.position"))
    return marked.withColumn("first", F.when(~(same_page | same_place), F.col("first")))


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 100, most_broadcast: int = 200_000) -> None:
    """Convert every ARC file below ``arc_path`` to WARC files.

    A file's marks (digests and revisits, some 200 bytes a record) go to the
    task that converts it; it parses the file again but hashes no payload anew.
    """
    marks = repeated(cut(arc_digests(spark, arc_path), "digests"), least_bytes, most_broadcast)
    mark = F.struct("position", "payload_digest", "payload_bytes", F.col("first.page_id").alias("page"), F.col("first.file").alias("file"), F.col("first.position").alias("at"))
    plans = marks.groupBy("file").agg(F.sort_array(F.collect_list(mark)).alias("marks"))
    plans = plans.repartition(max(1, min(_files(spark, arc_path).count(), 10_000)), "file")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            info = b"software: treecat\r\nformat: WARC File Format 1.1\r\nconformsTo: ARC conversion\r\n"
            head = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": warc_date("1997"), "Content-Type": "application/warc-fields"}
            opened = False
            for b in slices(batches, 1):
                if not opened:
                    yield warc_record(head, info) + END
                    opened = True
                file = b.column("file")[0].as_py()
                for m, r in zip(b.column("marks")[0], _arc_records(file), strict=True):
                    m, block = m.as_py(), r["body"]
                    http, _, _ = split_http(block)
                    revisit, digest = m["file"] is not None, m["payload_digest"]
                    block = http if revisit else block
                    headers = {
                        "WARC-Type": "revisit" if revisit else "response" if http else "resource",
                        "WARC-Record-ID": record_id(file, m["position"], digest),
                        "WARC-Date": warc_date(r["Archive-date"]),
                        "WARC-Target-URI": r["URL"],
                        "WARC-IP-Address": r["IP-address"],
                        "WARC-Payload-Digest": f"sha256:{digest}",
                        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
                        "WARC-Refers-To": record_id(m["file"], m["at"], digest) if revisit else None,
                        "WARC-Profile": REVISIT_PROFILE if revisit else None,
                        "Content-Type": "application/http; msgtype=response" if http else r["Content-type"],
                        "X-Payload-Length": m["payload_bytes"],
                        "X-Refers-To-Page-Id": m["page"] if revisit else None,
                    }
                    yield warc_record(headers, block) + END

        yield from _batches(((x,) for x in gzip_lines(records())), _LINE, 0)

    _write(plans.mapInArrow(lines, "line binary"), warc_path)


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record of one WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.partition(b":")
            fields[name.decode().strip().lower()] = value.decode("utf-8", "replace").strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"{len(block)} of {size} declared bytes in {fields.get('warc-record-id')}")
        yield fields, block


_WARC = {"page_id": "long", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long", "record_id": "string", "refers_to_id": "string", "warc_date": "string", "url": "string", "content_type": "string", "payload": "binary"}
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Response, revisit and resource records of all WARC files below ``path``; digests are checked against the bytes.

    Without ``payloads`` the bytes are checked but not returned.
    """
    names = {c: t for c, t in _WARC.items() if payloads or c != "payload"}
    schema = pa.schema([(c, _ARROW[t]) for c, t in names.items()])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for file in b.column("path").to_pylist():
                    with open_input(file) as stream:
                        for f, block in parse_warc(unzipped(stream)):
                            kind = f["warc-type"]
                            if kind not in ("response", "revisit", "resource"):
                                continue
                            _, http, payload = split_http(block)
                            digest = f["warc-payload-digest"].removeprefix("sha256:")
                            if kind != "revisit" and hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"the payload of {f['warc-record-id']} does not have its digest")
                            size = int(f["x-payload-length"]) if kind == "revisit" else len(payload)
                            row = (_number(http.get("x-page-id")), size, digest, kind, _number(f.get("x-refers-to-page-id")), f["warc-record-id"], f.get("warc-refers-to"), f["warc-date"], f.get("warc-target-uri"), f.get("content-type"))
                            yield (*row, None if kind == "revisit" else payload) if payloads else row

        yield from _batches(rows(), schema, len(schema) - 1)

    return _files(spark, path).mapInArrow(records, ", ".join(f"{c} {t}" for c, t in names.items()))


def pages_through_archives(pages: DataFrame) -> DataFrame:
    """Every page written to ARC files, converted to WARC files and read back: one row per page.

    A null html is an empty payload; payloads under 100 bytes never are
    revisits; a page without an id comes back with a null id, as a revisit
    where a page with an id has its payload; rows that repeat the smallest
    page_id are responses each. Other columns are not read; no pages give no rows.
    """
    spark = pages.sparkSession
    arc, warc = new_folder(spark, "arc"), new_folder(spark, "warc")
    write_arc(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")), arc)
    arc_to_warc(spark, arc, warc)
    return read_warc(spark, warc, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_archive_converter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` through both formats, as ``pages_through_archives`` has them."""
    return pages_through_archives(table(spark, sf_dir, "pages"))


ARCHIVE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
r AS (
  SELECT *, CASE WHEN payload_bytes >= 100 AND count(*) OVER w > 1 THEN min(page_id) OVER w END AS first_id
  FROM p WINDOW w AS (PARTITION BY payload_digest))
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM r
"""
