"""WARC derivatives: response records become linked metadata and plain-text conversion records.

Records are WARC/1.1. For each response two records are written: `metadata` (application/warc-fields: HTTP status, media
type, title, outlinks, and the source's headers and digests) and `conversion` (text/plain, the page's visible text). Both
carry WARC-Refers-To, WARC-Refers-To-Target-URI and WARC-Refers-To-Date of their response and the response's payload
digest, and have identifiers derived from the response's, so that building again gives equal records. Digests are sha1 in
base 32; a response whose stored payload digest doesn't fit its payload is reported by `digest_ok`.

Cases: null bytes, or bytes without a WARC header, give no derivative. A response without HTTP header has an empty one. A
null url gives no target URI. Header names are matched without regard to case and folded lines are joined. Repeated rows
give repeated records. Empty tables give empty results; records are whole, whatever their length.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import strings
from .html_extract import visible_text

DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space for URLs
LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I | re.S)
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.I | re.S)
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, block: bytes, media: str, headers: list[tuple[str, str | None]]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", *(f"{k}: {v}" for k, v in headers if v is not None), f"WARC-Block-Digest: {digest(block)}", f"Content-Type: {media}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(raw: bytes) -> tuple[str, list[tuple[str, str]]]:
    """First line, and the fields in order; folded lines are joined."""
    lines = re.sub(rb"\r?\n[ \t]+", b" ", raw).decode("utf-8", "replace").splitlines()
    fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]) if k.strip()]
    return (lines[0] if lines else ""), fields


def parse(raw: bytes | None) -> tuple[dict[str, str], bytes] | None:
    """The fields (names in lower case) and the block of one record."""
    if not raw or not raw.startswith(b"WARC/"):
        return None
    head, _, rest = raw.partition(b"\r\n\r\n")
    _, fields = parse_headers(head)
    named = {k.lower(): v for k, v in fields}
    size = int(named["content-length"]) if named.get("content-length", "").isdigit() else len(rest)
    return named, rest[:size]


def response(page_id, url: str | None, page: str | None) -> bytes:
    """A page as the response record of its capture."""
    body = (page or "").encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    name = f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id} {url}')}>"
    return record("response", name, block, "application/http; msgtype=response", [("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Payload-Digest", digest(body))])


def derive(raw: bytes | None) -> list[tuple]:
    """(type, id, refers_to, target_uri, source_digest, digest_ok, n_bytes, block_digest, record) of the derivatives."""
    got = parse(raw)
    if got is None or got[0].get("warc-type", "").lower() != "response":
        return []
    fields, block = got
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or not gap:
        head, payload = b"", block
    status, http = parse_headers(head)
    media = next((v for k, v in http if k.lower() == "content-type"), "")
    charset = CHARSET.search(media)
    try:
        text = payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        text = payload.decode("utf-8", "replace")
    source, stored = digest(payload), fields.get("warc-payload-digest")
    refers = fields.get("warc-record-id", "")
    shared = [
        ("WARC-Date", fields.get("warc-date")), ("WARC-Target-URI", fields.get("warc-target-uri")), ("WARC-Refers-To", refers),
        ("WARC-Refers-To-Target-URI", fields.get("warc-target-uri")), ("WARC-Refers-To-Date", fields.get("warc-date")), ("WARC-Source-Payload-Digest", stored or source),
    ]
    title = TITLE.search(text)
    lines = [f"http-status: {status}", *(f"http-header: {k}: {v}" for k, v in http), f"source-payload-digest: {source}", f"source-block-digest: {digest(block)}"]
    if title:
        lines.append("title: " + " ".join(title[1].split()))
    lines += ["outlink: " + " ".join(m[1].strip("\"'").split()) for m in LINK.finditer(text)]
    out = []
    for kind, data, kind_media in (("metadata", "".join(x + "\r\n" for x in lines).encode(), "application/warc-fields"), ("conversion", visible_text(text).encode(), "text/plain; charset=utf-8")):
        name = f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind} {refers}')}>"
        whole = record(kind, name, data, kind_media, shared)
        out.append((kind, name, refers, fields.get("warc-target-uri"), stored or source, stored in (None, source), len(data), digest(data), whole))
    return out


FIELDS = "record_type string, record_id string, refers_to string, target_uri string, source_digest string, digest_ok boolean, n_bytes long, block_digest string, record binary"


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, record) of pages (page_id, url, html)."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows = zip(b.column(0).to_pylist(), strings(b.column(1)), strings(b.column(2)), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([response(*r) for r in rows], pa.binary())], names=["page_id", "record"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, record binary")


def derivatives(records: DataFrame, with_record: bool = True) -> DataFrame:
    """The derivatives of a table (page_id, record), two rows for each response."""
    kind = records.schema["page_id"].dataType.simpleString()
    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                ids, rows = [], []
                for key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for row in derive(raw):
                        ids.append(key)
                        rows.append(row)
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), *(pa.array([r[k] for r in rows], kinds[k]) for k in range(len(kinds)))], names=["page_id", *names])

    return records.select("page_id", "record").mapInArrow(run, f"page_id {kind}, {FIELDS}")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: metadata and conversion records of every page's response, with the digest of each record's bytes."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = derivatives(responses(pages))
    return out.selectExpr(*[c for c in out.columns if c != "record"], "sha2(record, 256) AS record_sha256")
