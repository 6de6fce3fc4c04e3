"""WARC derivatives: metadata and plain-text conversion records linked to their responses."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .markup import read_page

#: Names fixed by the WARC format.
VERSION = "WARC/1.1"
RESPONSE = "record_id string, target_uri string, date string, payload_digest string, block binary, headers array<struct<name: string, value: string>>"
GZIP = b"\x1f\x8b\x08"
_RECORD = re.compile(rb"^WARC/\d+\.\d+[ \t]*\r\n", re.MULTILINE)
#: Bytes that are inflated at a time.
PIECE = 1 << 16
#: A batch of responses ends after so many rows, or a block of so many bytes.
BLOCK_ROWS, BLOCK_BYTES = 256, 8_000_000
HEADERS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
DERIVED = "type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, source_digest string, record binary"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One WARC record; headers without a value are left out, line ends in values become spaces."""
    lines = [VERSION, *(f"{k}: {' '.join(v.splitlines())}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def header_list(lines: list[str]) -> list[tuple[str, str]]:
    """Names and values in order, repeated ones too; a line that begins with white space goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        else:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def members(data: bytes):
    """(bytes, error) of the gzip members of a file, as far as each is valid; after a damaged one, reading goes on at the next that begins.
    Data that is not compressed is one piece."""
    if data[:2] != b"\x1f\x8b":
        yield data, None
        return
    at = 0
    while at < len(data):
        d, out, error, end = zlib.decompressobj(31), [], None, at
        try:
            while end < len(data) and not d.eof:
                out.append(d.decompress(data[end : end + PIECE]))
                end += PIECE
            error = None if d.eof else "cut gzip member"
        except zlib.error as e:
            error = f"damaged gzip member: {e}"
        yield b"".join(out), error
        end = min(end, len(data)) - len(d.unused_data) if d.eof else data.find(GZIP, at + 1)
        if d.eof and end < len(data) and data[end : end + 2] != GZIP[:2]:
            end = data.find(GZIP, end)  # padding, or rubbish, between members
        at = end if end > at else len(data)


def records_and_errors(data: bytes):
    """(headers, block, error) of a WARC file's bytes, compressed or not: a record, with error None, or what is wrong with a stretch of the file, which
    is passed over up to the next line that begins a record."""
    held = b""
    for piece, damage in members(data):
        held += piece
        at = 0
        while True:
            start = _RECORD.search(held, at)
            if not start:
                if rest := held[at:].strip():
                    yield [], b"", f"{len(rest)} bytes that are no record"
                held = b""
                break
            if rest := held[at : start.start()].strip():
                yield [], b"", f"{len(rest)} bytes that are no record"
            at = start.start()
            end = held.find(b"\r\n\r\n", at)
            if end < 0:
                held = held[at:]
                break
            headers = header_list(held[at:end].decode("utf-8", "replace").split("\r\n")[1:])
            size = next((v for k, v in headers if k.lower() == "content-length"), "")
            if not re.fullmatch("[0-9]{1,18}", size):
                yield headers, b"", f"Content-Length {size!r}"
                at = end + 4
                continue
            stop = end + 4 + int(size)
            if stop > len(held):
                held = held[at:]
                break
            yield headers, held[end + 4 : stop], None
            at = stop
        if damage:
            yield [], b"", damage
            if held:
                yield [], b"", "cut record"
                held = b""
    if held:
        yield [], b"", "cut record"


def record_parts(data: bytes):
    """(list of headers, block) of each whole record of a WARC file's bytes."""
    return ((headers, block) for headers, block, error in records_and_errors(data) if error is None)


def parse_records(data: bytes):
    """As record_parts, with the headers by lower-case name; of a repeated one the last counts."""
    for headers, block in record_parts(data):
        yield {k.lower(): v for k, v in headers}, block


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in order and body of an HTTP message; without a header part all is body."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"HTTP/"):
        return "", [], block
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, header_list(lines), body


def codings(headers: list[tuple[str, str]], name: str) -> list[str]:
    """The codings that the headers of a name list, in the order in which they are undone."""
    return [c for k, v in headers if k.lower() == name for c in v.lower().replace(" ", "").split(",") if c and c != "identity"][::-1]


def dechunked(body: bytes) -> bytes:
    """The data of a chunked body, as far as it goes; a body that is not in chunks is returned as it is."""
    out: list[bytes] = []
    at = 0
    while at < len(body):
        end = body.find(b"\r\n", at)
        size = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]+", size):
            return b"".join(out) if at else body
        n = int(size, 16)
        if not n:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out)


def inflated(data: bytes, wbits: int, whole: bool = False) -> bytes | None:
    """What zlib reads of data, all members and as far as it is valid; None where nothing is, or (whole) not all."""
    out: list[bytes] = []
    rest = data
    while rest:
        d = zlib.decompressobj(wbits)
        try:
            for at in range(0, len(rest), 1 << 16):
                out.append(d.decompress(rest[at : at + (1 << 16)]))
                if d.eof:
                    break
        except zlib.error:
            return (b"".join(out) or None) if not whole else None
        if not d.eof:
            return None if whole else b"".join(out)
        rest = d.unused_data + rest[at + (1 << 16) :] if wbits == 31 else b""
    return b"".join(out)


def payload(headers: list[tuple[str, str]], body: bytes) -> tuple[bytes, bytes, list[str]]:
    """The body without its transfer coding, the same without its content codings, and the codings that stay since they are
    neither chunked, gzip nor deflate. Crawlers that store decoded bodies under the old headers are read too."""
    unknown: list[str] = []
    steps = []
    for name in ("transfer-encoding", "content-encoding"):
        for c in codings(headers, name) if not unknown else ():
            if c == "chunked":
                body = dechunked(body)
            elif c in ("gzip", "x-gzip"):
                body = found if (found := inflated(body, 31)) is not None else body
            elif c == "deflate":
                body = next((x for x in (inflated(body, 15), inflated(body, -15, True)) if x is not None), body)
            else:
                unknown.append(c)
                break
        steps.append(body)
    return steps[0], steps[1], unknown


def body_text(headers: list[tuple[str, str]], body: bytes) -> str:
    """The body decoded by its charset, UTF-8 by default; what is not valid becomes U+FFFD."""
    kind = next((v for k, v in headers if k.lower() == "content-type"), "").lower()
    charset = kind.partition("charset=")[2].split(";")[0].strip(" \"'") or "utf-8"
    try:
        return body.decode(charset, "replace")
    except (LookupError, ValueError):  # no charset, or one that is no name
        return body.decode("utf-8", "replace")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The whole response records of WARC files (.warc, .warc.gz), in the columns of RESPONSE; read_errors lists the rest. A file is one value
    here, so files are at most 2 GB, as crawlers write them; it is inflated a member at a time."""
    names = StructType.fromDDL(RESPONSE).fieldNames()

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, block in record_parts(content.as_py()):
                    h = {k.lower(): v for k, v in headers}
                    if h.get("warc-type") == "response":
                        rows.append((h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-payload-digest"), block, [{"name": k, "value": v} for k, v in headers]))
                    if len(rows) >= BLOCK_ROWS or rows and len(rows[-1][4]) > BLOCK_BYTES:
                        yield _responses(rows, names)
                        rows = []
                yield _responses(rows, names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RESPONSE)


def _responses(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:4]), pa.array(cols[4], pa.binary()), pa.array(cols[5], HEADERS)], names)


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    """(path, nth, record_id, error) of WARC files: damaged or cut gzip members, records without a usable length, stretches that are no record, cut records."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                wrong = [(dict((k.lower(), v) for k, v in h).get("warc-record-id"), e) for h, _, e in records_and_errors(content.as_py()) if e]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(wrong), pa.string()), pa.array(range(len(wrong)), pa.int64()), pa.array([i for i, _ in wrong], pa.string()), pa.array([e for _, e in wrong], pa.string())], ["path", "nth", "record_id", "error"]
                )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, nth long, record_id string, error string")


def page_responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """pages as response records with id_col kept: the id of a record is a name-based UUID of the page's id and url. Each has the headers that a crawler would write."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    h = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), url_col))
    uid = F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(head.cast("binary"), html)
    values = [
        ("WARC-Type", F.lit("response")), ("WARC-Record-ID", uid), ("WARC-Target-URI", F.col(url_col).cast("string")), ("WARC-Date", F.lit(date)),
        ("WARC-Identified-Payload-Type", F.lit("text/html")), ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.octet_length(block).cast("string")),
    ]
    headers = F.filter(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in values]), lambda x: x["value"].isNotNull())
    return pages.select(F.col(id_col), uid.alias("record_id"), F.col(url_col).cast("string").alias("target_uri"), F.lit(date).alias("date"), F.lit(None).cast("string").alias("payload_digest"), block.alias("block"), headers.alias("headers"))


def derivatives(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two rows per response (columns of RESPONSE; headers may be absent): its metadata record and its plain-text conversion record, each with
    WARC-Refers-To the response's id and the source's target and date; columns named in keep are carried.

    The metadata block is JSON: the source's main record headers and payload digest, all its record headers in order,
    its HTTP status and headers in order, codings that could not be undone (the page is then read as empty), the page's title and links. The conversion block is the page's text, one block a line, without scripts, styles and head.
    record is the whole record's bytes. The source digest is computed where the response has none. New ids are
    name-based UUIDs of the source's id and the type, so a task run twice makes the same records. A null block is
    empty; a null id is the name ''; repeated responses give repeated records. Other columns are not read."""
    names, fields = StructType.fromDDL(RESPONSE).fieldNames(), StructType.fromDDL(DERIVED).fieldNames()
    if "headers" not in responses.columns:
        responses = responses.withColumn("headers", F.lit(None).cast(StructType.fromDDL(RESPONSE)["headers"].dataType))
    rows = responses.select(*keep, *(F.col(n).alias(f"__{n}") for n in names))

    def run(batches):
        for batch in batches:
            out, kept = [], []
            for i, (rid, uri, date, known, block, given) in enumerate(zip(*(batch.column(len(keep) + j).to_pylist() for j in range(6)), strict=True)):
                status, headers, body = http_parts(block or b"")
                entity, body, unknown = payload(headers, body)
                page = read_page("" if unknown else body_text(headers, body))
                source = known or digest(entity)
                text = "".join(b.text + "\n" for b in page.blocks if not b.path.startswith("/html/head")).encode()
                meta = json.dumps(
                    {"source": {"WARC-Record-ID": rid, "WARC-Target-URI": uri, "WARC-Date": date, "WARC-Payload-Digest": source},
                     "source_headers": [(x["name"], x["value"]) for x in given or () if x],
                     "http": {"status": status, "headers": headers, **({"undecoded": unknown} if unknown else {})}, "html": {"title": page.title, "links": page.links}},
                    ensure_ascii=False,
                ).encode()
                for kind, content_type, data in (("metadata", "application/json", meta), ("conversion", "text/plain; charset=utf-8", text)):
                    new = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{rid or ""}#{kind}')}>"
                    own = digest(data)
                    made = record(
                        [("WARC-Type", kind), ("WARC-Record-ID", new), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", rid), ("WARC-Block-Digest", own),
                         ("WARC-Source-Payload-Digest", source), ("Content-Type", content_type)], data,
                    )
                    out.append((kind, new, rid, uri, date, content_type, own, source, made))
                    kept.append(i)
            at = pa.array(kept, pa.int64())
            cols = list(zip(*out, strict=True)) if out else [[]] * 9
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(at) for j in range(len(keep))), *(pa.array(c, pa.binary() if n == "record" else pa.string()) for c, n in zip(cols, fields, strict=True))], [*keep, *fields])

    schema = StructType([*(StructField(f.name, f.dataType) for f in rows.schema.fields[: len(keep)]), *StructType.fromDDL(DERIVED).fields])
    return rows.mapInArrow(run, schema)
