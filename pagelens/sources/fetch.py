"""robots.txt and sitemap documents as tables, requested by tasks or read from files."""

from __future__ import annotations

import http.client
import ssl
import time
import zlib
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.functions.urls import origin
from pagelens.operators.ingest import REDIRECTS
from pagelens.schemas import ROBOTS_DOCS

# Limits of a robots.txt and of a sitemap request.
ROBOTS_MS, ROBOTS_BYTES, SITEMAP_MS, SITEMAP_BYTES, HOPS = 10_000, 512 * 1024, 15_000, 10 << 20, 5
SITEMAP_DOCS = "source string, xml string, error string"
_AGENT = "pagelens"


class FetchError(OSError):
    """Why a document could not be read."""


def is_web(url: str) -> bool:
    """Whether a text is an http or https URL with a host and without credentials."""
    parts = urlsplit(url)
    return parts.scheme in ("http", "https") and bool(parts.hostname) and "@" not in parts.netloc


def site(url: str) -> tuple[str, str | None, int]:
    """Scheme, host in lower case and port, named or not, of a URL."""
    parts = urlsplit(url)
    return parts.scheme, parts.hostname, parts.port or (443 if parts.scheme == "https" else 80)


def fetch(url: str, timeout_ms: int, max_bytes: int, accept: str, same_origin: bool) -> tuple[int, bytes]:
    """(status, body) after redirects; a body beyond max_bytes, a bad redirect or no time left is a FetchError."""
    ends, first = time.monotonic() + timeout_ms / 1000, site(url)
    for _ in range(HOPS + 1):
        left = ends - time.monotonic()
        if left <= 0:
            raise FetchError("no time left")
        scheme, host, port = site(url)
        secure = {"context": ssl.create_default_context()} if scheme == "https" else {}
        link = (http.client.HTTPSConnection if secure else http.client.HTTPConnection)(host, port, timeout=left, **secure)
        try:
            parts = urlsplit(url)
            link.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers={"User-Agent": _AGENT, "Accept": accept})
            answer = link.getresponse()
            if answer.status in REDIRECTS:
                following = urljoin(url, answer.getheader("location") or "").partition("#")[0]
                if not answer.getheader("location") or not is_web(following):
                    raise FetchError(f"{url} redirects to no page")
                if same_origin and site(following) != first:
                    raise FetchError(f"{url} redirects to another origin, {following}")
                url = following
                continue
            if not 200 <= answer.status < 300:
                return answer.status, b""
            body = bytearray()
            while chunk := answer.read1(65_536):
                body += chunk
                if len(body) > max_bytes:
                    raise FetchError(f"the answer is longer than {max_bytes} bytes")
                if time.monotonic() > ends:
                    raise FetchError("no time left")
            return answer.status, bytes(body)
        finally:
            link.close()
    raise FetchError(f"{url} redirects too often")


def inflated(body: bytes, max_bytes: int) -> bytes:
    """What begins as gzip unpacked, other content as it is; refused where it would be longer than max_bytes."""
    if body[:2] != b"\x1f\x8b":
        return body
    out = bytearray()
    while body:
        unpack = zlib.decompressobj(31)
        out += unpack.decompress(body, max_bytes + 1 - len(out))
        if len(out) > max_bytes:
            raise FetchError(f"unpacked it is longer than {max_bytes} bytes")
        if not unpack.eof:
            raise FetchError("the gzip content is not whole")
        body = unpack.unused_data
        if body[:2] != b"\x1f\x8b":
            break
    return bytes(out)


def robots_document(at: str, timeout_ms: int = ROBOTS_MS, max_bytes: int = ROBOTS_BYTES) -> dict:
    """An origin's robots.txt: a client error is one without rules, any other failure leaves it unavailable."""
    row = {"origin": at, "state": "unavailable", "status": None, "error": None, "body": None}
    try:
        status, body = fetch(f"{at}/robots.txt", timeout_ms, max_bytes, "text/plain,*/*", same_origin=False)
    except (OSError, http.client.HTTPException, ValueError) as error:
        return row | {"error": f"{type(error).__name__}: {error}"[:300]}
    if 200 <= status < 300:
        return row | {"state": "fetched", "status": status, "body": body.decode("utf-8", "replace")}
    if 400 <= status < 500:
        return row | {"state": "fetched", "status": status, "body": ""}
    return row | {"status": status, "error": f"robots.txt answered with status {status}"}


def sitemap_document(source: str, timeout_ms: int = SITEMAP_MS, max_bytes: int = SITEMAP_BYTES) -> dict:
    """A sitemap from a URL or from a file that the tasks can read: its text, or why there is none."""
    try:
        if source.startswith(("http://", "https://")):
            status, body = fetch(source, timeout_ms, max_bytes, "application/xml,text/xml,*/*", same_origin=True)
            if not 200 <= status < 300:
                raise FetchError(f"{source} answered with status {status}")
        else:
            with Path(source).open("rb") as f:
                body = f.read(max_bytes + 1)
            if len(body) > max_bytes:
                raise FetchError(f"the file is longer than {max_bytes} bytes")
        return {"source": source, "xml": inflated(body, max_bytes).decode("utf-8", "replace"), "error": None}
    except (OSError, http.client.HTTPException, ValueError, zlib.error) as error:
        return {"source": source, "xml": None, "error": str(error)[:300] or type(error).__name__}


_ROBOTS = pa.schema([("origin", pa.string()), ("state", pa.string()), ("status", pa.int32()), ("error", pa.string()), ("body", pa.string())])
_SITEMAP = pa.schema([("source", pa.string()), ("xml", pa.string()), ("error", pa.string())])


def _each(read, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist([read(name)], schema=schema)

    return run


def robots_docs(urls: DataFrame, lanes: int = 4, timeout_ms: int = ROBOTS_MS, max_bytes: int = ROBOTS_BYTES) -> DataFrame:
    """(origin, state, status, error, body) of every origin in `urls` (url), each asked once, by `lanes` tasks at a time."""
    sites = urls.select(origin(F.col("url")).alias("origin")).where("origin <> ''").distinct().repartition(lanes)
    return sites.mapInArrow(_each(lambda site: robots_document(site, timeout_ms, max_bytes), _ROBOTS), ROBOTS_DOCS)


def sitemap_docs(sources: DataFrame, lanes: int = 4, timeout_ms: int = SITEMAP_MS, max_bytes: int = SITEMAP_BYTES) -> DataFrame:
    """(source, xml, error) of every source in `sources` (source), a URL or a path."""
    return sources.select("source").repartition(lanes).mapInArrow(_each(lambda s: sitemap_document(s, timeout_ms, max_bytes), _SITEMAP), SITEMAP_DOCS)
