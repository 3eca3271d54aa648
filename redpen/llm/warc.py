"""WARC derivatives: linked metadata and plain-text conversion records of response records.

A response yields a metadata record (application/warc-fields: title, language, out-links, HTTP
headers) and a conversion record (text/plain). Both name the response in WARC-Refers-To, keep its
target URI and date, and carry its digests (WARC-Source-Block-Digest, WARC-Source-Payload-Digest)
beside their own. Header fields keep their order, and repeated ones all their values. Record ids are
name-based UUIDs of what they stand for, so a rerun after a lost executor writes the same records.
Records can be written to and parsed from WARC/1.x bytes, plain or with a gzip member each; chunked and
gzipped HTTP bodies are decoded. `derivatives_of_files` reads WARC files, `derivatives` a table of pages.

Null html counts as empty; a page without url has the URI of its id. Pages with equal url and html
give equal records, one pair for each row. A page's table row without an id gets a null page_id. Pages
of any length are read in one pass, also with unclosed tags, comments and scripts. An empty table gives
no record. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import spread

DATE = "1970-01-01T00:00:00Z"  # pages carry no fetch time
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:redpen:warc")


class Fields(list):
    """Header fields as (name, value) in order; names are matched without regard to case."""

    def get(self, name: str, default: str | None = None) -> str | None:
        return next((v for k, v in self if k.lower() == name.lower()), default)

    def __getitem__(self, name):
        if not isinstance(name, str):
            return super().__getitem__(name)
        if (found := self.get(name)) is None:
            raise KeyError(name)
        return found

    def without(self, name: str) -> Fields:
        return Fields((k, v) for k, v in self if k.lower() != name.lower())


@dataclass
class Record:
    headers: Fields
    block: bytes = b""
    http: Fields = field(default_factory=Fields)  # of a response

    @property
    def kind(self) -> str:
        return self.headers["WARC-Type"]

    @property
    def payload(self) -> bytes:
        """The body of an HTTP response, with its transfer and content codings undone."""
        body = self.block.partition(b"\r\n\r\n")[2]
        if "chunked" in (self.http.get("Transfer-Encoding") or "").lower():
            body = unchunked(body)
        if (self.http.get("Content-Encoding") or "").strip().lower() in ("gzip", "x-gzip"):
            body = b"".join(members(body))
        return body

    def to_bytes(self) -> bytes:
        lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in self.headers), f"Content-Length: {len(self.block)}"]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + self.block + b"\r\n\r\n"


def members(data: bytes) -> Iterator[bytes]:
    """The contents of gzip members, one after another."""
    while data:
        one = zlib.decompressobj(31)
        yield one.decompress(data) + one.flush()
        if not one.eof:
            raise ValueError("a gzip member is cut short")
        data = one.unused_data


def unchunked(body: bytes) -> bytes:
    """A chunked body in one piece; one that ends early keeps what it has."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        n = int(body[at:end].partition(b";")[0].strip() or b"0", 16)
        if not n:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(10).join(names))}>"


def _fields(head: bytes) -> Fields:
    """Header lines; a line that starts with white space goes on with the one before it."""
    found = Fields()
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if found and line[:1] in (" ", "\t"):
            name, value = found.pop()
            found.append((name, f"{value} {line.strip()}"))
        elif ":" in line:
            name, _, value = line.partition(":")
            found.append((name, value.strip()))
    return found


def parse(data: bytes) -> Iterator[Record]:
    """The records of WARC bytes, gzipped or not; raises ValueError on a broken one."""
    for part in members(data) if data.startswith(b"\x1f\x8b") else [data]:
        yield from _parsed(part)


def _parsed(data: bytes) -> Iterator[Record]:
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/1.", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        headers = _fields(data[at:end].partition(b"\r\n")[2])
        n = int(headers["Content-Length"])
        block = data[end + 4 : end + 4 + n]
        if len(block) < n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        http = _fields(block.partition(b"\r\n\r\n")[0].partition(b"\r\n")[2]) if headers.get("WARC-Type") == "response" else Fields()
        yield Record(headers.without("Content-Length"), block, http)
        at = end + 8 + n


def response(url: str, html: str, date: str = DATE) -> Record:
    """A response record for a fetched page. White space and controls of the url are percent-encoded,
    since a header is one line."""
    url = re.sub(r"[\x00-\x20\x7f-\xa0\u2028\u2029\x85]", lambda m: quote(m[0]), url)
    body = html.encode()
    http = Fields([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))])
    block = ("HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in http) + "\r\n").encode() + body
    payload = digest(body)
    headers = {
        "WARC-Type": "response", "WARC-Record-ID": record_id("response", url, payload), "WARC-Date": date, "WARC-Target-URI": url,
        "Content-Type": "application/http; msgtype=response", "WARC-Block-Digest": digest(block), "WARC-Payload-Digest": payload,
    }
    return Record(Fields(headers.items()), block, http)


# -- text of a page ------------------------------------------------------------------------------

_TAG = re.compile(r"<!--|<(/?[a-zA-Z][a-zA-Z0-9]*)[^>]*>|<[!?][^>]*>")
_RAW = frozenset(("script", "style", "noscript", "template"))
_BLOCKS = frozenset("address article aside blockquote body br caption dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table td th title tr ul".split())
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def _tags(html: str) -> Iterator[tuple[str, str, int, int]]:
    """(name, tag, start, end) of each tag, comment or raw element, in one pass.

    What is never closed is looked for once: no tag is sought after the last '>', and a comment or raw
    element without an end is text from its opening on.
    """
    at, last, open_ = 0, html.rfind(">") + 1, set()
    while m := _TAG.search(html, at, last):
        name, end = (m[1] or "").lower(), m.end()
        kind = "--" if m[0] == "<!--" else name
        if kind == "--" or kind in _RAW:
            close = None if kind in open_ else re.compile("-->" if kind == "--" else rf"</{kind}\s*>", re.I).search(html, end)
            if close:
                end = close.end()
            else:
                open_.add(kind)
        yield name, m[0], m.start(), end
        at = end


@dataclass
class Page:
    """What a page says: text without markup (scripts, styles and comments go, block elements end lines,
    references are decoded, runs of white space become one space and empty lines go), title, language
    and links."""

    text: str
    title: str
    language: str
    links: list[str]


def read_page(html: str) -> Page:
    parts, links, language, title, at, opened = [], [], None, None, 0, None
    for name, tag, start, end in _tags(html):
        parts.append(html[at:start])
        if name.lstrip("/") in _BLOCKS:
            parts.append("\n")
        if name == "a" and (m := _HREF.search(tag)):
            links.append(entities.unescape(next(filter(None, m.groups()), "")))
        elif name == "html" and language is None and (m := _LANG.search(tag)):
            language = m[1]
        elif name == "title" and opened is None:
            opened = end
        elif name == "/title" and opened is not None and title is None:
            title = " ".join(entities.unescape(html[opened:start]).split())
        at = end
    parts.append(html[at:])
    lines = entities.unescape("".join(parts)).split("\n")
    return Page("\n".join(line for raw in lines if (line := " ".join(raw.split()))), title or "", language or "", links)


def plain_text(html: str) -> str:
    return read_page(html).text


def derive(source: Record) -> tuple[Record, Record]:
    """The metadata and the conversion record of a response."""
    page, of = read_page(source.payload.decode("utf-8", "replace")), source.headers
    info = [("title", page.title), ("language", page.language), ("links", str(len(page.links))), *(("outlink", " ".join(x.split())) for x in page.links), *((f"http-{k.lower()}", v) for k, v in source.http)]
    common = {"WARC-Date": of["WARC-Date"], "WARC-Target-URI": of["WARC-Target-URI"], "WARC-Refers-To": of["WARC-Record-ID"], "WARC-Source-Block-Digest": of.get("WARC-Block-Digest") or digest(source.block), "WARC-Source-Payload-Digest": of.get("WARC-Payload-Digest") or digest(source.payload)}
    made = []
    for kind, content, block in (
        ("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in info).encode()),
        ("conversion", "text/plain; charset=utf-8", page.text.encode()),
    ):
        headers = {"WARC-Type": kind, "WARC-Record-ID": record_id(kind, of["WARC-Record-ID"]), **common, "Content-Type": content, "WARC-Block-Digest": digest(block)}
        made.append(Record(Fields(headers.items()), block))
    # The two name each other, so either leads to both.
    for a, b in (made, made[::-1]):
        a.headers.append(("WARC-Concurrent-To", b.headers["WARC-Record-ID"]))
    return made[0], made[1]


_SCHEMA = pa.schema([("page_id", pa.int64()), *((n, pa.string()) for n in ("warc_type", "record_id", "refers_to", "concurrent_to", "target_uri", "content_type", "block_digest", "source_block_digest", "source_payload_digest", "source_headers")), ("content_length", pa.int64()), ("block", pa.string())])


_DDL = "page_id long, " + ", ".join(f"{f.name} {'long' if f.name == 'content_length' else 'string'}" for f in list(_SCHEMA)[1:])


def derivatives(pages: DataFrame) -> DataFrame:
    """Two rows per page (page_id, url, html): its metadata and its conversion record."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                rows = []
                for page, url, html in zip(*(c.to_pylist() for c in b.slice(start, 256).columns), strict=True):
                    # Through the bytes of a WARC file, as a reader of one would get it.
                    source = next(parse(response(url or f"urn:page:{page}", html or "").to_bytes()))
                    rows += [_row(page, source, r) for r in derive(source)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return spread(pages.selectExpr("cast(page_id as long) page_id", "url", "html")).mapInArrow(per_batch, _DDL)


def _row(page: int | None, source: Record, r: Record) -> tuple:
    h, http = r.headers, "\n".join(f"{k}: {v}" for k, v in source.http)
    return (page, r.kind, h["WARC-Record-ID"], h["WARC-Refers-To"], h["WARC-Concurrent-To"], h["WARC-Target-URI"], h["Content-Type"], h["WARC-Block-Digest"], h["WARC-Source-Block-Digest"], h["WARC-Source-Payload-Digest"], http, len(r.block), r.block.decode())


def derivatives_of_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of `derivatives` for the response records of WARC files, plain or gzipped; page_id is null.
    A file is one task's, as its records can be found from its start only."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                for source in parse(data.as_py()):
                    if source.kind == "response":
                        rows = [_row(None, source, r) for r in derive(source)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(per_batch, _DDL)


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
