"""Derivatives of web archive responses.

A response record (named header fields and a block of HTTP) gives two records: a metadata record, whose JSON holds the
response's own header fields, the HTTP status and headers, title, links and digests, and a conversion record, whose
block is the page's plain text. Both refer to the response by WARC-Refers-To, keep its target and date, and carry block
digests; the metadata record also keeps the digests that the response came with and those found in its block.

A page is read by one forward scan: every search starts where the one before it ended, and a search that found nothing
is not made again, so the work follows the length of a page whatever it holds. Bodies are freed of chunked transfer
coding and of gzip or deflate, and decoded by the charset of the Content-Type field, else by that of a meta tag within
the first kilobyte, else as UTF-8. Links are resolved against the base tag, else the target.

Cases: a null block is an empty one, with status 0. A null target is the empty string. Bytes that are no text of their
charset read as U+FFFD, an unknown charset counts as UTF-8. A body that its codings do not fit, or that would unpack to
more than UNPACKED bytes, stays as it is. A tag that is not closed is text, a comment or script that is not closed ends
the page. Line ends in field values are percent-encoded. Equal responses give equal records. An empty table gives no
records. Other columns are ignored but for those that `keep` names, which may have any name. Very long pages take one
pass.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvina.llm.common import chunks

NAMESPACE = uuid.UUID("7d0c1d52-9f0b-5f6b-8d9a-0d5d1e0a4c11")
#: Bytes that a compressed body may unpack to.
UNPACKED = 256 << 20
#: Elements that begin a line, elements whose content is no text, and those that hold neither.
BLOCKS = set("br hr p div h1 h2 h3 h4 h5 h6 li ul ol tr td th table section article header footer nav aside main blockquote pre title form dl dt dd figure figcaption body head html".split())
SILENT = {b"script", b"style", b"noscript", b"template"}
_NAME = re.compile(rb"[a-zA-Z][^\s/>]*+")
_FIELD = re.compile(rb"""([^\s=/>"']++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?|\s++|.""", re.S)
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]{1,40})", re.I)


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


class Page:
    """What one forward scan over a page finds: its text, title, links and base."""

    def __init__(self, page: str):
        data = page.encode("utf-8", "replace")
        low = data.lower()  # ASCII letters only, so places stay the same
        self.links: list[str] = []
        self.title: str | None = None
        self.base = ""
        out: list[bytes] = []
        missing: set[bytes] = set()

        def find(what: bytes, at: int) -> int:
            if what in missing:
                return -1
            k = low.find(what, at)
            if k < 0:
                missing.add(what)
            return k

        at, n = 0, len(data)
        while at < n:
            opening = find(b"<", at)
            if opening < 0:
                out.append(data[at:])
                break
            out.append(data[at:opening])
            if low.startswith(b"<!--", opening):
                stop = find(b"-->", opening + 4)
                out.append(b" ")
                at = stop + 3 if stop >= 0 else n
                continue
            closing = low.startswith(b"</", opening)
            name = _NAME.match(low, opening + 1 + closing)
            stop = find(b">", opening) if name or low[opening + 1 : opening + 2] in (b"!", b"?", b"/") else -1
            if stop < 0:
                out.append(b"<")
                at = opening + 1
                continue
            kind = name[0] if name else b""
            at = stop + 1
            if kind in SILENT and not closing:
                end = find(b"</" + kind, at)
                end = find(b">", end) if end >= 0 else -1
                out.append(b" ")
                at = end + 1 if end >= 0 else n
                continue
            if kind == b"title" and not closing and self.title is None:
                end = find(b"</title", at)
                if end >= 0:
                    self.title = html.unescape(" ".join(data[at:end].decode("utf-8").split()))
            if kind in (b"a", b"base") and not closing:
                href = self._href(data[name.end() : stop])
                if href is not None and kind == b"a":
                    self.links.append(href)
                elif href and not self.base:
                    self.base = href
            if kind.decode("utf-8") in BLOCKS:
                out.append(b"\n")
        self._text = b"".join(out).decode("utf-8")

    @staticmethod
    def _href(fields: bytes) -> str | None:
        for m in _FIELD.finditer(fields):
            if m[1] is not None and m[1].lower() == b"href" and m[2] is not None:
                value = m[2]
                if len(value) > 1 and value[:1] in (b'"', b"'") and value[-1:] == value[:1]:
                    value = value[1:-1]
                return html.unescape(value.decode("utf-8")).strip()
        return None

    def text(self) -> str:
        """A line for each block, no markup, blank lines dropped."""
        lines = (" ".join(line.split()) for line in html.unescape(self._text).split("\n"))
        return "\n".join(line for line in lines if line)

    def resolved(self, target: str) -> list[str]:
        base = joined(target, self.base) if self.base else target
        return [joined(base, x) for x in self.links]


def joined(base: str, link: str) -> str:
    """The absolute form of a link; what cannot be resolved stays as it is."""
    try:
        return urljoin(base, link)
    except ValueError:
        return link


def plain_text(page: str) -> str:
    return Page(page).text()


def unchunked(body: bytes) -> bytes:
    """A body without its chunked transfer coding; ValueError where it has none."""
    out, at = [], 0
    while True:
        stop = body.find(b"\r\n", at, at + 1024)
        if stop < 0:
            raise ValueError("no size of a chunk")
        size = int(body[at:stop].split(b";")[0].strip() or b"-", 16)
        if size == 0:
            return b"".join(out)
        if size < 0 or stop + 2 + size > len(body):
            raise ValueError("a chunk is cut")
        out.append(body[stop + 2 : stop + 2 + size])
        at = stop + 2 + size + 2


def unpacked(body: bytes, coding: str) -> bytes:
    """A body without gzip or deflate; ValueError or zlib.error where it does not fit."""
    for wbits in (31,) if "gzip" in coding else (15, -15):
        engine = zlib.decompressobj(wbits)
        try:
            out = engine.decompress(body, UNPACKED)
        except zlib.error:
            continue
        if not engine.eof:
            raise ValueError("cut or too large")
        return out
    raise ValueError("another coding")


def page_of(fields: list[tuple[str, str]], body: bytes) -> str:
    """The text of an HTTP body by its header fields."""
    given = {k.lower(): v.lower() for k, v in fields}
    if "chunked" in given.get("transfer-encoding", ""):
        with contextlib.suppress(ValueError):
            body = unchunked(body)
    if (coding := given.get("content-encoding", "")) and ("gzip" in coding or "deflate" in coding):
        with contextlib.suppress(ValueError):
            body = unpacked(body, coding)
    found = _CHARSET.search(given.get("content-type", "").encode()) or _CHARSET.search(body[:1024])
    try:
        return body.decode(found[1].decode() if found else "utf-8", "replace")
    except (LookupError, ValueError):
        return body.decode("utf-8", "replace")


def one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def http_parts(block: bytes) -> tuple[int, list[tuple[str, str]], bytes]:
    """(status, header fields in order, body) of an HTTP response."""
    head, gap, body = block.partition(b"\r\n\r\n")
    first, *fields = head.decode("utf-8", "replace").split("\r\n")
    status = first.split(" ")[1:2]
    if not first.startswith("HTTP/") or not status or not status[0].isdigit():
        return 0, [], block
    return int(status[0]), [(k.strip(), v.strip()) for k, _, v in (f.partition(":") for f in fields)], body


def derivatives(headers: dict[str, str], block: bytes | None) -> list[tuple[dict[str, str], bytes]]:
    """The metadata and the conversion record of one response, as (header fields, block)."""
    block = block or b""
    status, fields, body = http_parts(block)
    page = Page(page_of(fields, body))
    headers = {k: one_line(v or "") for k, v in headers.items()}
    source, target = headers.get("WARC-Record-ID", ""), headers.get("WARC-Target-URI", "")
    about = {
        "Envelope": {
            "WARC-Header-Metadata": headers, "Block-Digest": sha1(block), "Payload-Digest": sha1(body), "Payload-Length": len(body),
            "Payload-Metadata": {"HTTP-Response-Metadata": {"Status": status, "Headers": fields, "HTML-Metadata": {"Title": page.title, "Links": page.resolved(target)}}},
        }
    }
    text = page.text().encode()
    out = []
    for kind, media, data in (("metadata", "application/json", json.dumps(about, ensure_ascii=False, sort_keys=True).encode()), ("conversion", "text/plain", text)):
        record = {
            "WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(NAMESPACE, kind + source)}>", "WARC-Refers-To": source, "WARC-Target-URI": target, "WARC-Date": headers.get("WARC-Date", ""),
            "WARC-Block-Digest": sha1(data), "Content-Type": media, "Content-Length": str(len(data)),
        }
        if "WARC-Payload-Digest" in headers:
            record["WARC-Refers-To-Payload-Digest"] = headers["WARC-Payload-Digest"]
        out.append((record, data))
    return out


def derive(responses: DataFrame, keep: list[str] = (), headers_col: str = "headers", block_col: str = "block") -> DataFrame:
    """(kept columns, headers map, block binary), two rows for each response: metadata, then conversion."""
    slim = responses.select(responses[block_col].cast("binary").alias("b"), responses[headers_col].alias("h"), *(responses[k].alias(f"k{i}") for i, k in enumerate(keep)))
    fields = [f for f in slim.schema.fields if f.name not in ("b", "h")]
    schema = T.StructType([*fields, T.StructField("h", T.MapType(T.StringType(), T.StringType())), T.StructField("b", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "b"):
            made = [r for h, x in zip(b.column(1).to_pylist(), b.column(0).to_pylist()) for r in derivatives(dict(h or {}), x)]
            twice = pa.array([i // 2 for i in range(2 * b.num_rows)])
            headers = pa.array([list(h.items()) for h, _ in made], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([*(c.take(twice) for c in b.columns[2:]), headers, pa.array([x for _, x in made], pa.binary())], schema.fieldNames())

    return slim.mapInArrow(run, schema).select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keep)), F.col("h").alias("headers"), F.col("b").alias("block"))


def base32_sha1(data) -> Column:
    """The digest as sha1() writes it, in SQL functions: four times ten hex digits are eight digits of base 32."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(data), 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.concat(F.lit("sha1:"), F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records (id, headers map, block binary) of a table of pages, as a crawler would have stored them."""
    body = F.coalesce(pages[html_col].cast("string"), F.lit("")).cast("binary")
    url = F.replace(F.replace(F.coalesce(pages[url_col].cast("string"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")).cast("binary")
    block = F.concat(head, body)
    hexed = F.sha2(F.concat_ws("\n", F.coalesce(pages[id_col].cast("string"), F.lit("")), url), 256)
    name = F.concat(F.lit("<urn:uuid:"), F.substring(hexed, 1, 8), F.lit("-"), F.substring(hexed, 9, 4), F.lit("-5"), F.substring(hexed, 13, 3), F.lit("-8"), F.substring(hexed, 16, 3), F.lit("-"), F.substring(hexed, 19, 12), F.lit(">"))
    headers = F.create_map(
        F.lit("WARC-Type"), F.lit("response"), F.lit("WARC-Record-ID"), name, F.lit("WARC-Target-URI"), url, F.lit("WARC-Date"), F.lit(date), F.lit("Content-Type"), F.lit("application/http; msgtype=response"),
        F.lit("WARC-Payload-Digest"), base32_sha1(body), F.lit("Content-Length"), F.octet_length(block).cast("string"),
    )
    return pages.select(pages[id_col], headers.alias("headers"), block.alias("block"))


def serialized(headers: dict[str, str], block: bytes) -> bytes:
    """One WARC/1.0 record."""
    return b"WARC/1.0\r\n" + "".join(f"{k}: {one_line(v)}\r\n" for k, v in headers.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a WARC file's bytes."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        headers = dict(line.split(": ", 1) for line in data[at:stop].decode().split("\r\n")[1:])
        size = int(headers["Content-Length"])
        yield headers, data[stop + 4 : stop + 4 + size]
        at = stop + 8 + size
