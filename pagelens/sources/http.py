"""Requests of pages by Spark tasks: one row a probe with its chunks."""

from __future__ import annotations

import hashlib
import http.client
import ssl
import time
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame

from pagelens.functions.urls import shown_url
from pagelens.operators.ingest import HEADERS, REDIRECTS
from pagelens.sources.fetch import is_web, site

SCHEMA = """probe_id string, requested_url string, final_url string, status int, completion string, error string, bytes_read bigint,
 body_sha256 string, headers map<string,string>, redirects array<struct<url:string,status:int,location:string,duration_ms:double>>,
 headers_ms double, first_byte_ms double, complete_ms double, body binary, chunk_ends array<bigint>, chunk_at array<double>"""
_NAMES = [
    "probe_id", "requested_url", "final_url", "status", "completion", "error", "bytes_read", "body_sha256", "headers", "redirects",
    "headers_ms", "first_byte_ms", "complete_ms", "body", "chunk_ends", "chunk_at",
]


def probe(task: dict) -> tuple:
    """One request with redirects followed by hand; whatever goes wrong is a completion, never an exception."""
    began = time.monotonic()
    now = lambda: (time.monotonic() - began) * 1000
    url, custom, hops = task["url"], dict(task.get("headers") or {}), []
    limit, most, timeout = task.get("max_bytes", 10 << 20), task.get("max_redirects", 10), task.get("timeout_ms", 15_000) / 1000
    state = {"status": None, "headers": {}, "h": None, "f": None, "c": None, "body": b"", "ends": [], "at": [], "cookie": False}

    def row(completion: str, error: str | None = None) -> tuple:
        body = state["body"]
        digest = hashlib.sha256(body).hexdigest() if completion == "complete" else None
        return (
            task["probe_id"], shown_url(task["url"]), shown_url(url), state["status"], completion, error, len(body), digest, state["headers"], hops,
            state["h"], state["f"], state["c"], body, state["ends"], state["at"],
        )

    if limit < 1 or most < 0 or timeout <= 0 or not is_web(url):
        return row("invalid-response", "the request is not valid")
    first = site(url)
    try:
        while True:
            parts, left = urlsplit(url), timeout - now() / 1000
            if left <= 0:
                return row("timeout", "no time left")
            kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
            extra = {"context": ssl.create_default_context()} if parts.scheme == "https" else {}
            link = kind(parts.hostname, parts.port, timeout=left, **extra)
            at = now()
            target = (parts.path or "/") + ("?" + parts.query if parts.query else "")
            link.request("GET", target, headers={"User-Agent": task["user_agent"], "Accept": "text/html,application/xhtml+xml", "Accept-Encoding": "identity", **custom})
            answer = link.getresponse()
            state["status"], state["h"] = answer.status, now()
            given = {k.lower(): v for k, v in answer.getheaders()}
            state["headers"] = {k: v for k, v in given.items() if k in HEADERS} | ({"set-cookie": "present"} if "set-cookie" in given else {})
            if answer.status not in REDIRECTS:
                break
            location = given.get("location")
            hops.append((url, answer.status, location, now() - at))
            link.close()
            if len(hops) > most:
                return row("redirect-limit", "too many redirects")
            following = urljoin(url, location) if location else ""
            if not is_web(following):
                return row("invalid-response", "a redirect leads nowhere")
            url = following
            if site(url) != first:
                custom = {}
        if given.get("content-type", "").split(";")[0].strip().lower() not in ("text/html", "application/xhtml+xml"):
            return row("invalid-response", "the response is not HTML")
        while chunk := answer.read1(65_536):
            state["f"] = state["f"] if state["f"] is not None else now()
            room = limit - len(state["body"])
            state["body"] += chunk[:room]
            state["ends"].append(len(state["body"]))
            state["at"].append(now())
            if len(chunk) > room:
                return row("max-bytes-exceeded", "the body is too long")
            if now() / 1000 > timeout:
                return row("timeout", "the body took too long")
        state["c"] = now()
        return row("complete")
    except TimeoutError as error:
        return row("timeout", str(error))
    except (OSError, http.client.HTTPException, ValueError) as error:
        return row("network-error", f"{type(error).__name__}: {error}"[:300])


def requested(tasks: DataFrame, lanes: int, headers: dict[str, str], limits: dict[str, int]) -> DataFrame:
    """The planned probes (probe_id, target_ord, agent_ord, sample, requested_url, user_agent) carried out, a row each.

    `lanes` tasks request at a time; samples of one target and agent follow each other in one of them.
    """
    options = {"headers": headers, "timeout_ms": limits["timeoutMs"], "max_bytes": limits["maxBytes"], "max_redirects": limits["maxRedirects"]}
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                found = probe({"probe_id": row.probe_id, "url": row.requested_url, "user_agent": row.user_agent, **options})
                yield pd.DataFrame([found], columns=_NAMES)

    order = ["target_ord", "agent_ord", "sample"]
    return tasks.repartition(lanes, *order[:2]).sortWithinPartitions(*order).mapInPandas(run, SCHEMA)
