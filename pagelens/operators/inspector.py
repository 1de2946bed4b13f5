"""HTML responses to signals, chunk by chunk: one row of nested facts a document, then tables of them.

A document is inspected where it lies; nothing of it is shuffled and only its facts leave the task, whose number is
bounded. The same state machine takes a whole response in a batch and one chunk at a time in a stream.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.functions.encodings import Decoder
from pagelens.functions.markup import Tokens
from pagelens.functions.text import SPACE
from pagelens.storage import small_batches

# Retained signals of a kind, and the limits of structured data and main text.
SIGNAL_CAP, BLOCK_CAP, BLOCK_CHARS, NODE_CAP, TYPE_CAP = 256, 64, 1_048_576, 10_000, 256
VALUE_CHARS, MAIN_CHARS, MAIN_RAW, ERROR_CHARS = 4096, 240, 1024, 240
# The social properties and the audiences of crawler directives that are read.
SOCIAL = (
    "og:title", "og:type", "og:url", "og:image", "og:description",
    "twitter:card", "twitter:title", "twitter:description", "twitter:image",
)
AUDIENCES = ("robots", "googlebot", "bingbot")

_SPACES = re.compile(SPACE.replace(r" ", " "))
_INERT = ("template", "svg", "math")
_SILENT = ("script", "style", "template", "noscript")

SIGNAL = "struct<kind:string,ord:int,property:string,audience:string,value:string,location:string,at_ms:double,observed_by_byte:bigint>"
BLOCK = "struct<ord:int,valid:boolean,types:array<string>,bytes:bigint,limit:string,error:string,location:string,at_ms:double,observed_by_byte:bigint>"
MARK = "struct<at_ms:double,observed_by_byte:bigint>"
INSPECTED = f"probe_id string, signals array<{SIGNAL}>, json_ld array<{BLOCK}>, body_start {MARK}, head_close {MARK}, document_close {MARK}"


def clip(text: str, limit: int) -> str:
    """The first `limit` UTF-16 units of a text."""
    if len(text) * 2 <= limit or (len(text) <= limit and text.isascii()):
        return text
    return text[:limit] if max(text[:limit]) <= "￿" else text.encode("utf-16-le", "surrogatepass")[: 2 * limit].decode("utf-16-le", "ignore")


def tidy(text: str, limit: int = VALUE_CHARS) -> str:
    return clip(_SPACES.sub(" ", text).strip(" "), limit)


def json_types(value: object) -> list[str]:
    """Distinct @type names of a JSON-LD value: the first TYPE_CAP as they are met.

    Values are looked at from the last one of a list or object to the first; those looked at and those that wait are NODE_CAP
    together at most, and what no longer fits is left out.
    """
    found: dict[str, None] = {}
    waiting, seen = [value], 0
    while waiting and seen < NODE_CAP:
        node, seen = waiting.pop(), seen + 1
        inside: Iterable[object] = ()
        if isinstance(node, dict):
            inside, named = node.values(), node.get("@type")
            for name in named if isinstance(named, list) else [named]:
                if isinstance(name, str) and name.strip() and len(found) < TYPE_CAP:
                    found[clip(name.strip(), VALUE_CHARS)] = None
        elif isinstance(node, list):
            inside = node
        waiting.extend(islice(inside, max(0, NODE_CAP - seen - len(waiting))))
    return sorted(found)


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


class Page:
    """Signals of one document as its chunks arrive.

    `signals`, `blocks` and `marks` hold what has been found and was not yet taken; state() and Page(**state) carry the
    rest over. A signal has the time of the chunk that completed it and all bytes up to that chunk's end.
    """

    def __init__(self, **state: object):
        self.decoder, self.tokens = Decoder(**state.get("decoder", {})), Tokens(**state.get("tokens", {}))
        # bytes so far; head and body open; depths of inert, main and silent elements; captures by element
        self.read, self.inside, self.depth = state.get("read", 0), state.get("inside", {}), state.get("depth", {})
        self.captures, self.counts = state.get("captures", {}), state.get("counts", {})
        self.main = state.get("main")
        self.signals: list[dict] = []
        self.blocks: list[dict] = []
        self.marks: dict[str, dict] = state.get("marks", {})

    def state(self) -> dict:
        keep = ("read", "inside", "depth", "captures", "counts", "main", "marks")
        return {k: getattr(self, k) for k in keep} | {"decoder": self.decoder.state(), "tokens": self.tokens.state()}

    def feed(self, data: bytes, at_ms: float, last: bool = False) -> None:
        self.read += len(data)
        at = max(0.0, at_ms) if at_ms is not None and abs(at_ms) < float("inf") else 0.0
        for text, (at, read) in self.decoder.feed(data, (at, self.read), last):
            self._events(text, {"at_ms": at, "observed_by_byte": read}, False)
        if last:
            mark = {"at_ms": at, "observed_by_byte": self.read}
            self._events("", mark, True)
            self._end_main()

    def _events(self, text: str, mark: dict, last: bool) -> None:
        for event, name, more in self.tokens.feed(text, last):
            inert = any(self.depth.get(n) for n in _INERT)
            if event == "text":
                if not inert:
                    self._hear(more, mark)
                continue
            by = 1 if event == "open" else -1
            if name in _SILENT and not inert and self.depth.get("main"):
                self._step("silent", by)
            if name in _INERT:
                self._step(name, by)
            elif not inert and (handler := (_OPENED if by > 0 else _CLOSED).get(name)):
                handler(self, name, more, mark)

    def _step(self, name: str, by: int) -> None:
        self.depth[name] = max(0, self.depth.get(name, 0) + by)

    def _location(self) -> str:
        return next((n for n in ("head", "body") if self.inside.get(n)), "document")

    def _signal(self, kind: str, value: str, mark: dict, location: str | None = None, prop: str | None = None, audience: str | None = None) -> None:
        """Adds a signal unless its kind, or its social property, has its number already."""
        key = prop or kind
        n = self.counts.get(key, 0) + 1
        if n > SIGNAL_CAP:
            return
        self.counts[key] = n
        self.signals.append({"kind": kind, "ord": n, "property": prop, "audience": audience, "value": value, "location": location or self._location(), **mark})

    def _enter(self, name: str, attributes: dict[str, str], mark: dict) -> None:
        self.inside[name] = True
        if name == "body":
            self.marks.setdefault("body_start", mark)

    def _leave(self, name: str, written: bool, mark: dict) -> None:
        """The end of head or body, or of the document where it is written out."""
        if name != "html":
            self.inside[name] = False
        if name == "head":
            self.marks.setdefault("head_close", mark)
        elif name == "html" and written:
            self.marks.setdefault("document_close", mark)

    def _deepen(self, name: str, attributes: dict[str, str], mark: dict) -> None:
        self._step(name, 1)

    def _surface(self, name: str, written: bool, mark: dict) -> None:
        self._step(name, -1)

    def _listen(self, name: str, attributes: dict[str, str], mark: dict) -> None:
        """Begin to take the text of an element, unless it is taken already or enough of its kind are known."""
        if name == "script":
            wanted = attributes.get("type", "").split(";", 1)[0].strip().lower() == "application/ld+json"
        else:
            wanted = name not in self.captures and self.counts.get(name, 0) < SIGNAL_CAP
        if wanted:
            self.captures[name] = {"location": self._location(), "text": "", "bytes": 0, "cut": False}

    def _hear(self, text: str, mark: dict) -> None:
        """Text for every element that is listened to, and for the main text."""
        for name, held in self.captures.items():
            if name != "script":
                held["text"] = clip(held["text"] + text, VALUE_CHARS)
                continue
            held["bytes"] += len(text.encode("utf-8", "replace"))
            # blocks beyond the cap are told by their size alone
            if self.counts.get("blocks", 0) < BLOCK_CAP:
                whole = held["text"] + text
                held["cut"], held["text"] = held["cut"] or len(whole) > BLOCK_CHARS, whole[:BLOCK_CHARS]
        if self.depth.get("main") and not self.depth.get("silent"):
            if self.main is None and _SPACES.sub("", text):
                self.main = {"text": "", "location": self._location(), **mark}
            if self.main is not None and len(self.main["text"]) < MAIN_RAW:
                self.main["text"] = clip(self.main["text"] + text, MAIN_RAW)

    def _heard(self, name: str, written: bool, mark: dict) -> None:
        """The text of an element is whole: a signal, unless it says nothing, or a block of structured data."""
        held = self.captures.pop(name, None)
        if held is None:
            return
        if name == "script":
            self._block(held, mark)
        elif value := tidy(held["text"]):
            self._signal(name, value, mark, held["location"])

    def _link(self, name: str, attributes: dict[str, str], mark: dict) -> None:
        if "href" in attributes and "canonical" in attributes.get("rel", "").lower().split():
            self._signal("canonical", tidy(attributes["href"]), mark)

    def _meta(self, name: str, attributes: dict[str, str], mark: dict) -> None:
        if "content" not in attributes:
            return
        value = tidy(attributes["content"])
        named, prop = (attributes.get(k, "").strip().lower() for k in ("name", "property"))
        if named == "description":
            self._signal("description", value, mark)
        elif named in AUDIENCES:
            self._signal("robots", value, mark, audience=named)
        for social in (x for x in (prop, named) if x in SOCIAL):
            self._signal("social", value, mark, prop=social)
            break

    def _block(self, held: dict, mark: dict) -> None:
        """A block of structured data: parsed within the limits; the first beyond their number stands for all of these."""
        n = self.counts["blocks"] = self.counts.get("blocks", 0) + 1
        if n > BLOCK_CAP + 1:
            return
        told = {"valid": None, "types": [], "limit": "blocks" if n > BLOCK_CAP else "size" if held["cut"] else None, "error": None}
        if told["limit"] is None:
            try:
                told |= {"valid": True, "types": json_types(json.loads(held["text"], parse_constant=_refuse))}
            except (ValueError, RecursionError) as error:
                told |= {"valid": False, "error": str(error)[:ERROR_CHARS]}
        self.blocks.append({"ord": n, "bytes": held["bytes"], "location": held["location"], **told, **mark})

    def _end_main(self) -> None:
        if self.main is not None and (value := tidy(self.main["text"], MAIN_CHARS)):
            self._signal("main", value, {k: self.main[k] for k in ("at_ms", "observed_by_byte")}, self.main["location"])


#: What the beginning and the end of an element mean, by its name; all others are passed over.
_OPENED = {"head": Page._enter, "body": Page._enter, "title": Page._listen, "h1": Page._listen, "script": Page._listen, "meta": Page._meta, "link": Page._link, "main": Page._deepen}
_CLOSED = {"head": Page._leave, "body": Page._leave, "html": Page._leave, "title": Page._heard, "h1": Page._heard, "script": Page._heard, "main": Page._surface}

#: Documents, signals and blocks that are sent on together.
HELD = 4096
_ARROW = pa.schema([
    ("probe_id", pa.string()),
    ("signals", pa.list_(pa.struct([("kind", pa.string()), ("ord", pa.int32()), ("property", pa.string()), ("audience", pa.string()), ("value", pa.string()), ("location", pa.string()), ("at_ms", pa.float64()), ("observed_by_byte", pa.int64())]))),
    ("json_ld", pa.list_(pa.struct([("ord", pa.int32()), ("valid", pa.bool_()), ("types", pa.list_(pa.string())), ("bytes", pa.int64()), ("limit", pa.string()), ("error", pa.string()), ("location", pa.string()), ("at_ms", pa.float64()), ("observed_by_byte", pa.int64())]))),
    *((name, pa.struct([("at_ms", pa.float64()), ("observed_by_byte", pa.int64())])) for name in ("body_start", "head_close", "document_close")),
])


def inspect_page(body: bytes, charset: str | None, ends: list[int], times: list[float], closed: bool = False) -> Page:
    """A whole response, fed in chunks that end at `ends`."""
    page, start = Page(decoder={"charset": charset}, tokens={"closed": closed}), 0
    for end, at in zip(ends, times, strict=True):
        if end > start:
            page.feed(body[start:end], at)
            start = end
    page.feed(body[start:], times[-1] if times else 0.0, last=True)
    return page


def _inspect(batches: Iterator[pa.RecordBatch], closed: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, held = [], 0
        for k in range(batch.num_rows):
            one = partial(lambda k, c: batch.column(c)[k].as_py(), k)
            page = inspect_page(one("body"), one("charset"), one("chunk_ends") or [], one("chunk_at") or [], closed)
            rows.append({"probe_id": one("probe_id"), "signals": page.signals, "json_ld": page.blocks} | {m: page.marks.get(m) for m in _ARROW.names[3:]})
            held += 1 + len(page.signals) + len(page.blocks)
            if held >= HELD:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def inspected(responses: DataFrame, closed: bool = False) -> DataFrame:
    """One row a document: probe_id, arrays signals and json_ld in order of appearance, and three marks.

    `responses` has probe_id, chunk_ends (cumulative bytes, array<bigint>), chunk_at (array<double>), and body with charset, or
    html. Responses without a body are left out. Title, h1 and main text keep non-empty values only; the others
    keep empty ones. With `closed`, only entities that end with their semicolon are read as such; by default also the
    names that HTML takes without one. The session's Arrow batches become small, so that a worker's memory is bounded in
    bytes of documents, not in their number.
    """
    if "html" in responses.columns:
        responses = responses.withColumns({"body": F.encode("html", "UTF-8"), "charset": F.lit("utf-8")})
    small_batches(responses.sparkSession)
    rows = responses.where("body IS NOT NULL").select("probe_id", "body", "charset", "chunk_ends", "chunk_at")
    return rows.mapInArrow(partial(_inspect, closed=closed), INSPECTED)


def signals_of(documents: DataFrame) -> DataFrame:
    """The signals of inspected documents, a row each."""
    return documents.select("probe_id", F.inline("signals"))


def json_ld_of(documents: DataFrame) -> DataFrame:
    """The structured data of inspected documents, a row a block."""
    return documents.select("probe_id", F.inline("json_ld"))


def fixed_chunks(pages: DataFrame, size: int, step_ms: float = 1.0) -> DataFrame:
    """Adds chunk_ends and chunk_at as if `html` had come in chunks of `size` bytes, one each step_ms."""
    total = F.octet_length("html")
    count = F.ceil(total / size).cast("int")
    return pages.withColumn(
        "chunk_ends", F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda k: F.least(k * size, total).cast("bigint"))
    ).withColumn("chunk_at", F.transform("chunk_ends", lambda e: F.ceil(e / size) * step_ms))
