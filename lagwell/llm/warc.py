"""WARC derivatives: responses to linked metadata and plain-text conversion records.

A response record is a row: record_id, target_uri, date, headers (its WARC header lines as an ordered list), block (HTTP head and
payload). `derive` makes two records of each: `metadata` (title, links, language, payload size as warc-fields) and `conversion`
(the visible text). Both carry WARC-Refers-To with the response's identifier, its target, date and payload digest; record
identifiers are name-based, so a task that runs again writes the same ones. `serialised` gives each record as one gzip member,
`parsed` reads members back.

Defined cases: null html is an empty payload and still gives both records; a null url gives an empty target; repeated pages give
repeated records of equal identifiers; HTTP blocks without an empty line are all payload; extra columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame

from lagwell.llm.markup import read

#: Level of the gzip members; higher ones take several times as long for a few percent.
LEVEL = 1
NAMES = uuid.UUID("6d0f6f1e-3d53-4b62-9f0a-5c1a2f9f7d11")
HEADER = "array<struct<name:string,value:string>>"
RECORD = f"page_id bigint, warc_type string, record_id string, refers_to string, target_uri string, headers {HEADER}, block binary"
_TYPE = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, chr(0).join(parts))}>"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 7
    kinds = [pa.int64(), *[pa.string()] * 4, _TYPE, pa.binary()]
    names = ["page_id", "warc_type", "record_id", "refers_to", "target_uri", "headers", "block"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _record(page_id, kind: str, rid: str, refers, target: str, date: str, extra: list[tuple[str, str]], content_type: str, block: bytes) -> tuple:
    head = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", target), *extra,
            ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return page_id, kind, rid, refers, target, [{"name": a, "value": b} for a, b in head], block


def _mapped(df: DataFrame, one) -> DataFrame:
    """Applies one(row) -> records to rows, 200 at a time."""

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 200):
                yield _batch([r for row in batch.slice(i, 200).to_pylist() for r in one(row)])

    return df.mapInArrow(run, RECORD)


DATE = "2024-01-01T00:00:00Z"


def _response(row: dict, date: str):
    payload, url = (row["html"] or "").encode(), row["url"] or ""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    payload_digest = digest(payload)
    rid = identifier("response", str(row["page_id"]), url, payload_digest)
    yield _record(row["page_id"], "response", rid, None, url, date, [("WARC-Payload-Digest", payload_digest)], "application/http; msgtype=response", block)


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of pages (page_id, url, html)."""
    return _mapped(pages.select("page_id", "url", "html"), lambda row: _response(row, date))


def _http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return {}, block
    lines = [x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:]]
    return {k.strip().lower(): v.strip() for k, _, v in lines}, payload


def _derived(row: dict):
    if row["warc_type"] != "response":
        return
    head = {x["name"]: x["value"] for x in row["headers"]}
    http, payload = _http(row["block"] or b"")
    kind = http.get("content-type", "text/html")
    charset = (re.search(r"charset=([\w-]+)", kind) or [None, "utf-8"])[1]
    try:
        source = payload.decode(charset, "replace")
    except LookupError:
        source = payload.decode("utf-8", "replace")
    page = read(source)
    rid, date, target = row["record_id"], head.get("WARC-Date", ""), row["target_uri"] or ""
    payload_digest = head.get("WARC-Payload-Digest") or digest(payload)
    linked = [("WARC-Refers-To", rid), ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date), ("WARC-Source-Payload-Digest", payload_digest), ("WARC-Source-Content-Type", kind)]
    lang = re.search(r"<html[^>]*\blang\s*=\s*[\"']?([\w-]+)", source, re.I)
    fields = [("title", page.title), ("language", lang[1] if lang else ""), ("charset", charset), ("payload-length", str(len(payload))), *(("outlink", " ".join(x.split())) for x in page.links)]
    meta = "".join(f"{a}: {b}\r\n" for a, b in fields).encode()
    text = "\n".join(b.text for b in page.blocks).encode()
    for type_, content_type, block in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", text)):
        own = identifier(type_, rid)
        more = [("WARC-Concurrent-To", identifier("conversion", rid))] if type_ == "metadata" else []
        yield _record(row["page_id"], type_, own, rid, target, date, linked + more, content_type, block)


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of response records; other record types give nothing."""
    return _mapped(records, _derived)


def member(headers: list[dict], block: bytes) -> bytes:
    """One record as a gzip member without a time stamp; members can be concatenated to a file."""
    # a header value never holds a line break, whatever a url held
    head = "WARC/1.1\r\n" + "".join(f"{h['name']}: {re.sub(r'[\r\n]+', ' ', h['value'])}\r\n" for h in headers) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", LEVEL, mtime=0)


def unpacked(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    headers = [tuple(x.split(": ", 1)) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:]]
    length = int(dict(headers)["Content-Length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("the record's length doesn't match its block")
    return headers, rest[:length]


def serialised(records: DataFrame) -> DataFrame:
    """page_id and member of each record."""

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 200):
                b = batch.slice(i, 200)
                out = [member(h, x or b"") for h, x in zip(b.column("headers").to_pylist(), b.column("block").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(out, pa.binary())], ["page_id", "member"])

    return records.mapInArrow(run, "page_id bigint, member binary")


_FIELDS = ["page_id", "warc_type", "record_id", "refers_to", "target_uri", "headers", "block"]


def archived(pages: DataFrame, date: str = DATE) -> DataFrame:
    """serialised(derive(responses(pages))) in one pass over the pages: page_id and member of each derivative."""

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 200):
                made = [d for row in batch.slice(i, 200).to_pylist() for r in _response(row, date) for d in _derived(dict(zip(_FIELDS, r, strict=True)))]
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in made], pa.int64()), pa.array([member(d[5], d[6]) for d in made], pa.binary())], ["page_id", "member"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, member binary")


def parsed(members: DataFrame) -> DataFrame:
    """Records (schema RECORD) of gzip members (page_id, member)."""

    def one(row):
        headers, block = unpacked(row["member"])
        h = dict(headers)
        if h.get("WARC-Block-Digest", digest(block)) != digest(block):
            raise ValueError(f"digest of {h['WARC-Record-ID']} doesn't match its block")
        yield row["page_id"], h["WARC-Type"], h["WARC-Record-ID"], h.get("WARC-Refers-To"), h.get("WARC-Target-URI"), [{"name": a, "value": b} for a, b in headers], block

    return _mapped(members.select("page_id", "member"), one)
