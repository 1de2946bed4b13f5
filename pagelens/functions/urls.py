"""URL resolution and matching as vectorised functions over Python's own URL library."""

from __future__ import annotations

import re
from functools import lru_cache
from urllib.parse import quote, unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

_PORTS = {"http": 80, "https": 443}
_KEEP = "%/?:@!$&'()*+,;=-._~[]"


@lru_cache(maxsize=50_000)
def absolute(base: str | None, ref: str | None, keep_hash: bool = False) -> str | None:
    """`ref` against `base` as browsers write it, or None when it is no absolute URL."""
    if ref is None:
        return None
    try:
        parts = urlsplit(urljoin(base or "", ref.strip()))
        host = (parts.hostname or "").encode("idna").decode() if parts.hostname else ""
        port = parts.port
    except (ValueError, UnicodeError):
        return None
    scheme = parts.scheme.lower()
    if not scheme or (scheme in _PORTS and not host):
        return None
    user = parts.netloc.rpartition("@")[0]
    netloc = (user + "@" if user else "") + host + (f":{port}" if port and port != _PORTS.get(scheme) else "")
    path = quote(_dots(parts.path) or ("/" if scheme in _PORTS else ""), safe=_KEEP)
    query = "?" + quote(parts.query, safe=_KEEP) if parts.query else ""
    tail = "#" + quote(parts.fragment, safe=_KEEP) if keep_hash and parts.fragment else ""
    return f"{scheme}:{'//' if netloc or scheme in _PORTS else ''}{netloc}{path}{query}{tail}"


def _dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part in (".", "%2e", "%2E"):
            out += [""] if last else []
        elif part == "..":
            if len(out) > 1:
                out.pop()
            out += [""] if last else []
        else:
            out.append(part)
    return "/".join(out)


def _resolved(base: str | None, ref: str | None) -> str | None:
    if ref is None or not ref.strip():
        return "" if ref is not None else None
    return absolute(base, ref) or " ".join(ref.split())


@F.pandas_udf(ArrayType(StringType()))
def urls_resolve(base: pd.Series, refs: pd.Series) -> pd.Series:
    """Resolved without fragment; empty stays empty, what is no URL stays text, and null stays null."""
    found = [None if r is None else [_resolved(b, x) for x in r] for b, r in zip(base, refs, strict=True)]
    return pd.Series(found, index=refs.index, dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def hops_plain(urls: pd.Series, locations: pd.Series) -> pd.Series:
    """Each location of a chain of redirects in normal form against the URL that named it."""

    def one(base: str | None, ref: str | None) -> str | None:
        return None if ref is None else absolute(base, ref) or " ".join(ref.split())

    found = [None if u is None else [one(a, b) for a, b in zip(u, r, strict=True)] for u, r in zip(urls, locations, strict=True)]
    return pd.Series(found, index=urls.index, dtype=object)


@F.pandas_udf(StringType())
def url_plain(url: pd.Series) -> pd.Series:
    """Normal form without fragment; what is no URL stays as it is."""
    return url.map(lambda u: u if u is None else absolute(None, u) or u)


@F.pandas_udf(StringType())
def url_for_origin(url: pd.Series, origin_of: pd.Series) -> pd.Series:
    """Path and query on the same origin, else the whole URL with its fragment."""

    def one(u: str | None, o: str | None) -> str | None:
        full = absolute(None, u, True) if u is not None else None
        if full is None:
            return u
        a, b = urlsplit(full), urlsplit(absolute(None, o) or "") if o else urlsplit("")
        return a.path + ("?" + a.query if a.query else "") if (a.scheme, a.netloc) == (b.scheme, b.netloc) else full

    return pd.Series([one(u, o) for u, o in zip(url, origin_of, strict=True)], index=url.index, dtype=object)


def shown_url(url: str | None) -> str | None:
    """A URL as reports may show it: normal, with its fragment, and without a name and password; what is none is not shown."""
    if url is None:
        return None
    full = absolute(None, url, True)
    if full is None:
        return "[invalid URL]"
    parts = urlsplit(full)
    return parts._replace(netloc=parts.netloc.rpartition("@")[2]).geturl() if "@" in parts.netloc else full


def shown_host(url: str | None) -> str | None:
    """Host and port of a URL, or the text itself where it is none."""
    full = absolute(None, url) if url is not None else None
    return url if full is None else urlsplit(full).netloc.rpartition("@")[2]


@F.pandas_udf(StringType())
def report_url(url: pd.Series) -> pd.Series:
    return url.map(shown_url)


@F.pandas_udf(StringType())
def report_host(url: pd.Series) -> pd.Series:
    return url.map(shown_host)


def _is_http_url(u: str | None) -> bool:
    full = absolute(None, u) if u and re.match(r"https?:", u.strip(), re.I) else None
    return bool(full) and "@" not in urlsplit(full).netloc


@F.pandas_udf(BooleanType())
def is_http_url(url: pd.Series) -> pd.Series:
    """An absolute http or https URL without credentials."""
    return url.map(_is_http_url).astype(bool)


@F.pandas_udf(ArrayType(BooleanType()))
def are_http_urls(urls: pd.Series) -> pd.Series:
    """is_http_url for each text of an array; null stays null."""
    found = [None if r is None else [None if x is None else _is_http_url(x) for x in r] for r in urls]
    return pd.Series(found, index=urls.index, dtype=object)


def origin(url):  # type: ignore[no-untyped-def]
    """Scheme and host of a normal URL, in the JVM."""
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def path_and_query(url):  # type: ignore[no-untyped-def]
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(found.startswith("/"), found).otherwise(F.concat(F.lit("/"), found))


def robots_path(text: str) -> str:
    """Non-ASCII percent-encoded, unreserved characters decoded, other escapes in upper case."""
    encoded = "".join(c if ord(c) < 128 else quote(c) for c in text)
    plain = lambda m: c if (c := chr(int(m[1], 16))).isalnum() and ord(c) < 128 or c in "-._~" else m[0].upper()
    return re.sub(r"%([0-9A-Fa-f]{2})", plain, encoded)


_RULE = StructType().add("head", StringType()).add("pattern", StringType()).add("size", IntegerType())


@F.pandas_udf(_RULE)
def robots_rule(pattern: pd.Series) -> pd.DataFrame:
    """(head, pattern, size) of a rule: what a path begins with that it matches, a regular expression where that is not all, and how specific it is.

    Stars at the very end say nothing and count nothing; those in front of a dollar that ends the rule count.
    """

    def one(p: str) -> tuple[str, str | None, int]:
        whole, ends = robots_path(p), p.endswith("$")
        text = (whole[:-1] if ends else whole.rstrip("*")).replace("$", "%24")
        size, parts = len(whole.rstrip("*")), text.split("*")
        if not ends and len(parts) == 1:
            return text, None, size
        return parts[0], "^" + ".*".join(re.sub(r"([^A-Za-z0-9%/_])", r"\\\1", x) for x in parts) + ("$" if ends else ""), size

    return pd.DataFrame([one(p) for p in pattern], columns=["head", "pattern", "size"])


@F.pandas_udf(StringType())
def robots_form(path: pd.Series) -> pd.Series:
    """A path as rules are held against it."""
    return path.map(lambda x: x if x is None else robots_path(x).replace("*", "%2A").replace("$", "%24"))


@F.pandas_udf(StringType())
def url_decode(text: pd.Series) -> pd.Series:
    """Percent escapes only; a plus stays a plus, and malformed text stays as it is."""
    return text.map(lambda t: t if t is None else unquote(t, errors="replace"))
