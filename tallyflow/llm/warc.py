"""WARC archives with transaction assembly.

Writing: each page becomes a transaction of three records: a response (or a revisit), a request and a metadata record; the latter two
name the first in WARC-Concurrent-To. Of pages with equal payloads the one with the smallest id is the response, the others are
revisits of it (profile identical-payload-digest, no payload, HTTP headers kept). Records are gzip members. Tasks write files
under fresh names into the shared folder; the manifest names those that count.

Reading: files are parsed a record at a time; payload digests are computed from the bytes that stand there. Records meet by their
transaction (WARC-Concurrent-To, or a head's own id) in one aggregation, which gives one nested row for each capture.

Equal payloads are found by their digests: ids are aggregated map-side, and only digests with several pages are joined back; the join
has an exchange of its own on both sides, so adaptive execution splits a payload that very many pages share.

A revisit names the response's target and date (WARC-Refers-To-Target-URI, WARC-Refers-To-Date) and, in its metadata, the page; the
response's record identifier isn't known where the revisit is written. `unmatched` holds revisits against the responses that were read.

Defined results: a payload of any length is one record, held in memory; a null html is the empty payload, a null url the empty target; rows repeated with the smallest id of a payload are
responses each, and rows repeated with another id revisits each; a null page_id sorts before all, so its payload's
other pages are revisits with null as refers_to; `min_bytes` leaves smaller payloads
as responses; a capture without request or metadata has null there, a request or metadata record without its head gives a row without a
head; other columns are ignored; an empty table gives no file and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import filesystem, shared_folder, slices, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = "\r\n"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes, level: int = 1) -> bytes:
    """A WARC/1.1 record as a gzip member."""
    head = "WARC/1.1" + _CRLF + "".join(f"{k}: {v}{_CRLF}" for k, v in headers) + f"Content-Length: {len(block)}{_CRLF}{_CRLF}"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def transaction(page_id: int | None, url: str, payload: bytes, original: int | None, is_revisit: bool, date: str, original_url: str = "") -> bytes:
    """The three records of a capture."""
    head_id, request_id, meta_id = (f"<urn:uuid:{uuid.uuid4()}>" for _ in range(3))
    uri, original_uri = (re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", x) for x in (url, original_url))
    http = f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: {len(payload)}{_CRLF}{_CRLF}".encode()
    common = [("WARC-Date", date), ("WARC-Target-URI", uri)]
    head = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", head_id), *common, ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest32(payload)}")]
    if is_revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", original_uri), ("WARC-Refers-To-Date", date)]
    path = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "", uri).partition("#")[0] or "/"
    host = m[1] if (m := re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", uri)) else ""
    fields = "".join(f"{k}: {v}{_CRLF}" for k, v in (("page-id", page_id), ("revisit-of", original if is_revisit else None)) if v is not None)
    return b"".join(
        (
            record(head, http if is_revisit else http + payload),
            record([("WARC-Type", "request"), ("WARC-Record-ID", request_id), *common, ("WARC-Concurrent-To", head_id), ("Content-Type", "application/http; msgtype=request")], f"GET {path} HTTP/1.1{_CRLF}Host: {host}{_CRLF}{_CRLF}".encode()),
            record([("WARC-Type", "metadata"), ("WARC-Record-ID", meta_id), *common, ("WARC-Concurrent-To", head_id), ("Content-Type", "application/warc-fields")], fields.encode()),
        )
    )


def _write(folder: str, date: str):
    def run(batches):
        fs, base = filesystem(folder)
        name, out, n, size = f"{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for part in slices(batch, "html"):
                for page, url, html, original, is_revisit, original_url in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "original", "is_revisit", "original_url"))):
                    if out is None:
                        fs.create_dir(base, recursive=True)
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                        size += out.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    size += out.write(transaction(page, url or "", html or b"", original, is_revisit, date, original_url or ""))
                    n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["file", "n_captures", "n_bytes"])

    return run


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> tuple[str, DataFrame]:
    """Writes page_id, url, html as archives; returns the folder and the manifest (file, n_captures, n_bytes)."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html).alias("sha"))
    rank = F.struct(F.col("page_id").isNotNull().alias("known"), F.col("page_id").alias("id"), F.col("url").alias("url"))
    firsts = pages.where(F.octet_length("html") >= min_bytes).groupBy(F.col("sha").alias("s")).agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").select("s", F.col("first.id").alias("original"), F.col("first.url").alias("original_url")).hint("rebalance")
    marked = pages.join(firsts, F.col("sha") == F.col("s"), "left").select("page_id", "url", "html", "original", "original_url", (F.col("s").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))).alias("is_revisit"))
    return folder, written(marked.mapInArrow(_write(folder, date), "file string, n_captures long, n_bytes long"), "warc-manifest")


def members(file, size: int = 1 << 20):
    """The gzip members of an archive, one at a time."""
    z, out, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or file.read(size)
        if not data:
            break
        out.append(z.decompress(data))
        rest = z.unused_data
        if z.eof:
            yield b"".join(out)
            z, out = zlib.decompressobj(31), []
    if any(out):
        raise ValueError("archive cut short")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split(_CRLF)
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def _fields(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, s, v in (x.partition(":") for x in block.decode("utf-8", "replace").split(_CRLF)) if s}


RECORD = "transaction string, record_id string, type string, uri string, date string, payload_bytes long, payload_digest string, http string, fields map<string,string>, payload binary"
_ARROW = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]


def _parse_files(folder: str, with_payload: bool):
    names = [x.split(" ")[0] for x in RECORD.replace(", payload binary", ", payload x").split(", ")]

    def row(raw: bytes) -> tuple | None:
        h, block = parse(raw)
        kind, fields, payload, http, n, sha = h.get("warc-type"), {}, None, None, None, None
        if kind in ("response", "revisit", "request"):
            head, _, body = block.partition(b"\r\n\r\n")
            http = head.decode("utf-8", "replace")
            if kind == "response":
                payload, n, sha = body, len(body), digest32(body)
            elif kind == "revisit":
                n, sha = int(_fields(head).get("content-length", 0)), h.get("warc-payload-digest", "").removeprefix("sha1:")
        elif kind == "metadata":
            fields = _fields(block)
        else:
            return None
        return (h.get("warc-concurrent-to") or h["warc-record-id"], h["warc-record-id"], kind, h.get("warc-target-uri"), h.get("warc-date"), n, sha, http, list(fields.items()), payload if with_payload else None)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _ARROW)], names)

    def run(batches):
        fs, base = filesystem(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_file(f"{base}/{name}") as file:
                    for raw in members(file):
                        if (r := row(raw)) is not None:
                            rows.append(r)
                            held += len(raw) if with_payload else 500
                        if held > 4 << 20:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    return run


def records(folder: str, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Request, response, revisit and metadata records of the archives, a row each."""
    return manifest.select("file").repartition(max(1, manifest.count())).mapInArrow(_parse_files(folder, with_payload), RECORD)


def captures(found: DataFrame) -> DataFrame:
    """transaction, head, requests, metadata: one nested row for each capture."""
    part = F.struct(*(c for c in found.columns if c != "transaction"))
    of = lambda *kinds: F.when(F.col("type").isin(*kinds), part)
    return found.groupBy("transaction").agg(F.first(of("response", "revisit"), ignorenulls=True).alias("head"), F.collect_list(of("request")).alias("requests"), F.collect_list(of("metadata")).alias("metadata"))


def unmatched(assembled: DataFrame) -> DataFrame:
    """The captures that are revisits but have no response of the digest and size that their headers state."""
    heads = assembled.where(F.col("head.type") == "response").select(F.col("head.payload_digest").alias("d"), F.col("head.payload_bytes").alias("n")).distinct()
    revisits = assembled.where(F.col("head.type") == "revisit")
    return revisits.join(heads, (F.col("head.payload_digest") == F.col("d")) & (F.col("head.payload_bytes") == F.col("n")), "left_anti")


def digest(assembled: DataFrame) -> DataFrame:
    """The columns of the op6 contract."""
    field = lambda name: F.aggregate("metadata", F.lit(None).cast("string"), lambda a, m: F.coalesce(a, m["fields"][name])).cast("long")
    return assembled.where(F.col("head").isNotNull()).select(field("page-id").alias("page_id"), F.col("head.payload_bytes").alias("payload_bytes"), F.col("head.payload_digest").alias("payload_digest"), F.col("head.type").alias("record_type"), field("revisit-of").alias("refers_to"))
