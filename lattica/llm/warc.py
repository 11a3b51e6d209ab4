"""WARC derivatives: metadata and plain-text conversion records from response records.

Each response gives a ``metadata`` record (warc-fields: title, outlinks, the source's
WARC and HTTP headers and digests) and a ``conversion`` record (the page's plain
text).  Both refer to the response by ``WARC-Refers-To``, keep its target and date, and
carry a digest of their own block; ids follow from the response's id, so a task that
runs twice writes the same records.

Bodies are read through their Transfer-Encoding (chunked) and Content-Encoding (gzip,
deflate, zstd) up to ``max_body`` bytes.  Pages are read by one linear scan over their
tags: a tag ends at the next ``>``; comments, and scripts, styles, noscript and template
elements, are dropped, and what is never closed is dropped to the page's end.

Edge cases: null records give no rows; a broken record, a body that can't be decoded or
grows beyond the bound gives one row with ``error``; a response without a body gives an
empty conversion.  Repeated records give repeated rows, with the same record ids.  An
empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from urllib.parse import urljoin

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.text import pieces
from lattica.session import prepare

VERSION = b"WARC/1.1"
MAX_BODY = 64 << 20
#: Elements that break lines, and those whose content isn't text.
BREAKING = frozenset("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 article section header footer nav main aside title head body blockquote pre form hr dd dt dl option figure".split())
RAW = frozenset(("script", "style", "noscript", "template"))
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_HREF = re.compile(r"(?<![\w-])href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_CHARSET = re.compile(r"charset=[\"']?([\w-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def named(*parts: str) -> str:
    """A record id that follows from the parts."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(chr(0).join(parts).encode('utf-8', 'surrogatepass')).digest()[:16], version=5)}>"


def _lines(text: str) -> str:
    lines = (" ".join(x.split()) for x in html.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def scan(page: str) -> tuple[str, str, list[str]]:
    """Plain text, title and link targets of a page, from one pass over its tags."""
    low = page.lower()
    if len(low) != len(page):  # some letters grow when lowered
        low = page.translate({c: c + 32 for c in range(65, 91)})
    out: list[str] = []
    links: list[str] = []
    title, title_from, at, last = None, None, 0, page.rfind(">")
    while at < len(page):
        here = page.find("<", at)
        if here < 0:
            out.append(page[at:])
            break
        out.append(page[at:here])
        if page.startswith("<!--", here):
            end = page.find("-->", here + 4)
            out.append(" ")
            at = end + 3 if end >= 0 else len(page)
            continue
        name = _NAME.match(page, here)
        if name is None and not page.startswith("<!", here):
            out.append("<")
            at = here + 1
            continue
        if here > last:
            break
        at = page.index(">", here) + 1
        if name is None:
            out.append(" ")
            continue
        kind, closing = name[1].lower(), page[here + 1] == "/"
        if kind in RAW and not closing:
            end = low.find(f"</{kind}", at)
            end = page.find(">", end) if end >= 0 else -1
            out.append(" ")
            at = end + 1 if end >= 0 else len(page)
            continue
        if kind == "title" and title is None:
            if not closing:
                title_from = len(out) if title_from is None else title_from
            elif title_from is not None:
                title = "".join(out[title_from:])
        elif kind == "a" and not closing:
            href = _HREF.search(page, here, at)
            if href:
                links.append(html.unescape(next(x for x in href.groups() if x is not None)))
        if kind in BREAKING:
            out.append("\n")
    return _lines("".join(out)), _lines(title or ""), links


def plain_text(page: str) -> str:
    return scan(page)[0]


def dechunked(body: bytes) -> bytes:
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at, at + 4096)
        if end < 0:
            raise ValueError("a broken chunk")
        try:
            size = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            raise ValueError("a broken chunk") from None
        if size < 0 or end + 2 + size > len(body):
            raise ValueError("a broken chunk")
        if not size:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def _inflated(data: bytes, window: int, most: int) -> bytes:
    """All members of a zlib, gzip or raw stream."""
    out, room = [], most
    while data:
        stream = zlib.decompressobj(window)
        try:
            part = stream.decompress(data, room + 1)
        except zlib.error as e:
            raise ValueError(f"a broken encoded body: {e}") from None
        room -= len(part)
        if room < 0:
            raise ValueError("a body beyond max_body")
        if not stream.eof:
            raise ValueError("a broken encoded body: cut off")
        out.append(part)
        data = stream.unused_data if window == 47 and stream.unused_data[:2] == b"\x1f\x8b" else b""
    return b"".join(out)


def decoded(body: bytes, coding: str, most: int = MAX_BODY) -> bytes:
    """A body out of the codings that a Content-Encoding header names, applied last first."""
    for kind in reversed([x.strip().lower() for x in coding.split(",") if x.strip()]):
        if not body or kind == "identity":
            continue
        if kind in ("gzip", "x-gzip"):
            body = _inflated(body, 47, most)
        elif kind == "deflate":
            raw = (body[0] & 15) != 8 or (body[0] << 8 | (body[1] if len(body) > 1 else 0)) % 31
            body = _inflated(body, -15 if raw else 15, most)
        elif kind == "zstd":
            try:
                body = zstandard.ZstdDecompressor().stream_reader(body).read(most + 1)
            except zstandard.ZstdError as e:
                raise ValueError(f"a broken encoded body: {e}") from None
        else:
            raise ValueError(f"an unknown Content-Encoding: {kind}")
        if len(body) > most:
            raise ValueError("a body beyond max_body")
    return body


def write_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    own = [*headers, ("Content-Length", str(len(block)))]
    lines = [VERSION, *(f"{k}: {' '.join(v.split())}".encode("utf-8", "surrogatepass") for k, v in own)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(lines: list[bytes]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (b" ", b"\t") and out:
            out[-1] = (out[-1][0], out[-1][1] + " " + line.strip().decode("utf-8", "replace"))
        elif b":" in line:
            name, value = line.split(b":", 1)
            out.append((name.strip().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace")))
    return out


def read_record(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of one record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    headers = _fields(head.split(b"\r\n")[1:])
    size = next((v for k, v in headers if k.lower() == "content-length"), None)
    if size is None or not size.isdigit() or int(size) > len(rest):
        raise ValueError("a wrong Content-Length")
    return headers, rest[: int(size)]


def response_record(key: str, url: str | None, page: str | None, date: str) -> bytes:
    """A response record of a stored page."""
    body = (page or "").encode("utf-8", "surrogatepass")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", named("response", key, url or "", digest(body))), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", url))
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block))]
    return write_record(headers, block)


def derive(record: bytes, max_body: int = MAX_BODY) -> list[dict]:
    """The metadata and the conversion record of a response record."""
    headers, block = read_record(record)
    get = {k.lower(): v for k, v in headers}.get
    if get("warc-type") != "response":
        raise ValueError("not a response record")
    http_head, gap, body = block.partition(b"\r\n\r\n")
    lines = http_head.split(b"\r\n")
    http = _fields(lines[1:])
    said = {k.lower(): v for k, v in reversed(http)}
    kind = said.get("content-type", "")
    entity = dechunked(body) if "chunked" in said.get("transfer-encoding", "").lower() else body
    content = decoded(entity, said.get("content-encoding", ""), max_body)
    charset = _CHARSET.search(kind)
    try:
        page = content.decode(charset[1] if charset else "utf-8", "replace")
    except (LookupError, UnicodeError):  # an unknown charset, or one that isn't of text
        page = content.decode("utf-8", "replace")
    source, uri = get("warc-record-id", ""), get("warc-target-uri")
    plain, title, targets = scan(page)
    links = []
    for raw in targets:
        try:
            links.append(urljoin(uri or "", raw))
        except ValueError:
            links.append(raw)
    facts = [("title", title), *(("outlink", x) for x in links)]
    facts += [(f"source-{k}", v) for k, v in headers if k.lower() != "content-length"]
    facts += [("http-status", lines[0].decode("utf-8", "replace")), *((f"http-{k}", v) for k, v in http)]
    meta = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in facts).encode("utf-8", "surrogatepass")
    text = plain.encode("utf-8", "surrogatepass")
    out = []
    for type_, media, own in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", text)):
        key = named(type_, source)
        made = [("WARC-Type", type_), ("WARC-Record-ID", key), ("WARC-Date", get("warc-date", "")), ("WARC-Refers-To", source)]
        if uri is not None:
            made += [("WARC-Target-URI", uri), ("WARC-Refers-To-Target-URI", uri)]
        if get("warc-date"):
            made.append(("WARC-Refers-To-Date", get("warc-date")))
        made += [("Content-Type", media), ("WARC-Block-Digest", digest(own))]
        out.append({
            "record_type": type_, "record_id": key, "refers_to": source, "target_uri": uri, "date": get("warc-date"),
            "block_digest": digest(own), "source_block_digest": get("warc-block-digest"), "source_payload_digest": get("warc-payload-digest"),
            "payload_intact": get("warc-payload-digest") in (None, digest(body), digest(entity)), "n_links": len(links) if type_ == "metadata" else None,
            "content_length": len(own), "record": write_record(made, own), "error": None,
        })
    return out


DERIVED = "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, block_digest string, source_block_digest string, source_payload_digest string, payload_intact boolean, n_links int, content_length long, record binary, error string"
_ARROW = pa.schema([("page_id", pa.int64()), *((n, pa.string()) for n in ("record_type", "record_id", "refers_to", "target_uri", "date", "block_digest", "source_block_digest", "source_payload_digest")), ("payload_intact", pa.bool_()), ("n_links", pa.int32()), ("content_length", pa.int64()), ("record", pa.binary()), ("error", pa.string())])


def derivatives(records: DataFrame, id_col: str = "page_id", record: str = "record", max_body: int = MAX_BODY) -> DataFrame:
    """Two rows for each response record in ``record``."""

    def run(batches):
        for batch in pieces(batches, "record"):
            rows = []
            for page, data in zip(batch.column("page_id").to_pylist(), batch.column("record").to_pylist()):
                if data is None:
                    continue
                try:
                    rows += [{"page_id": page} | x for x in derive(bytes(data), max_body)]
                except ValueError as e:
                    rows.append({"page_id": page, "error": str(e)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    prepare(records.sparkSession)
    return records.select(F.col(id_col).cast("long").alias("page_id"), F.col(record).alias("record")).mapInArrow(run, DERIVED)


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """page_id and record: a response record for each stored page."""

    def run(batches):
        for batch in pieces(batches, "html"):
            made = [response_record(str(k), u, h, date) for k, u, h in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")))]
            yield pa.record_batch({"page_id": batch.column("page_id"), "record": pa.array(made, pa.binary())})

    prepare(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, record binary")
