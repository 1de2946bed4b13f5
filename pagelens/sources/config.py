"""Run configuration from YAML or JSON on the driver: strict keys and bounds, then small tables."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from datetime import date
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from pagelens.functions.urls import absolute
from pagelens.schemas import TARGETS, WAIVERS
from pagelens.sources import agents as agent_source

NAMES = ("pagelens.config.yml", "pagelens.config.yaml", "pagelens.config.json")
# Bounds and defaults of limits, and headers that a request sets itself.
LIMITS = {"timeoutMs": (100, 120_000, 15_000), "maxBytes": (1024, 50 << 20, 10 << 20), "maxRedirects": (0, 20, 10), "repeat": (1, 10, 1), "concurrency": (1, 16, 4)}
FORBIDDEN = ("accept-encoding", "connection", "content-length", "host", "transfer-encoding", "user-agent")
REQUIRE = {"title": True, "description": True, "canonical": True, "h1": True, "mainText": True, "openGraph": False, "twitterCard": False}
_TARGET = {"id", "url", "expectedStatus", "expectedFinalUrl", "require", "maxFirstByteMs", "maxCriticalMs"}
_WAIVER = {"code", "target", "agent", "reason", "until"}
_TOP = {"targets", "agents", "ignore", "headers", *LIMITS}


class ConfigError(ValueError):
    """What is wrong with a configuration; at most five things are told."""


@dataclass
class Config:
    targets: list[dict[str, Any]]
    agents: list[agent_source.Agent]
    waivers: list[dict[str, Any]]
    headers: dict[str, str]
    limits: dict[str, int]
    issues: list[str] = field(default_factory=list)


def header(name: str, value: str) -> tuple[str, str]:
    if not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name) or name.lower() in FORBIDDEN or re.search(r"[\r\n]", value):
        raise ConfigError(f"header {name!r} can't be set")
    return name.lower(), value


def header_option(text: str) -> tuple[str, str]:
    name, colon, value = text.partition(":")
    if not colon:
        raise ConfigError("a header is written as 'Name: value'")
    return header(name.strip(), value.strip())


def interpolate(text: str) -> str:
    """${NAME} from the environment; a name that is not set is an error."""

    def one(m: re.Match[str]) -> str:
        if m[1] not in os.environ:
            raise ConfigError(f"environment variable {m[1]} is not set")
        return os.environ[m[1]]

    return re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}", one, text)


def _real_date(text: str) -> bool:
    try:
        return date.fromisoformat(text).isoformat() == text
    except ValueError:
        return False


def _target(item: str | dict, issues: list[str]) -> dict[str, Any]:
    item = {"url": item} if isinstance(item, str) else item
    issues += [f"unknown target key {k!r}" for k in item.keys() - _TARGET]
    url = absolute(None, str(item.get("url", "")))
    if not url or not url.startswith(("http://", "https://")) or "@" in url.split("/")[2]:
        issues.append(f"target {item.get('url')!r} is no http(s) URL without credentials")
    statuses = item.get("expectedStatus", 200)
    statuses = statuses if isinstance(statuses, list) else [statuses]
    if not statuses or any(not isinstance(s, int) or not 100 <= s <= 599 for s in statuses):
        issues.append("expectedStatus is between 100 and 599")
    if "id" in item and not re.fullmatch(r"(?i)[a-z0-9][a-z0-9._-]{0,63}", str(item["id"])):
        issues.append(f"target id {item['id']!r} is not plain")
    required = item.get("require") or {}
    issues += [f"unknown requirement {k!r}" for k in required.keys() - REQUIRE.keys()]
    return {"id": item.get("id"), "url": url, "statuses": statuses, "final": item.get("expectedFinalUrl"), "require": REQUIRE | required, "first": item.get("maxFirstByteMs"), "critical": item.get("maxCriticalMs")}


def parse(raw: dict[str, Any], extra_urls: tuple[str, ...] = (), discovered: tuple[dict, ...] = ()) -> Config:
    """Listed targets, then extra URLs, then discovered ones (url, id), the first mention of a URL winning."""
    issues = [f"unknown key {k!r}" for k in raw.keys() - _TOP]
    limits = {}
    for name, (low, high, default) in LIMITS.items():
        value = raw.get(name, default)
        if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
            issues.append(f"{name} is between {low} and {high}")
        limits[name] = value
    listed = [_target(t, issues) for t in raw.get("targets") or []]
    targets: dict[str, dict] = {}
    for t in listed:
        if targets.setdefault(t["url"], t) != t:
            issues.append(f"{t['url']} is listed twice with different contracts")
    for t in (_target(u, issues) for u in extra_urls):
        targets.setdefault(t["url"], t)
    taken = {t["id"] for t in targets.values() if t["id"]}
    for t in discovered:
        if t["url"] not in targets:
            targets[t["url"]] = _target(t["url"], issues) | {"id": None if t["id"] in taken else t["id"]}
    ids = [t["id"] for t in targets.values() if t["id"]]
    issues += [f"target id {i!r} is used twice" for i in {i for i in ids if ids.count(i) > 1}]
    found = agent_source.resolve(raw.get("agents"))
    waivers = raw.get("ignore") or []
    names, keys = {x for t in targets.values() for x in (t["id"], t["url"]) if x}, {a.key for a in found}
    for w in waivers:
        issues += [f"unknown waiver key {k!r}" for k in w.keys() - _WAIVER]
        if not re.fullmatch(r"\*|[a-z0-9][a-z0-9-]{0,63}", str(w.get("code", ""))) or not 1 <= len(str(w.get("reason") or "").strip()) <= 500:
            issues.append("a waiver needs a code and a reason of up to 500 characters")
        if w.get("until") is not None and not _real_date(str(w["until"])):
            issues.append(f"until {w['until']!r} is no date")
        if w.get("target") is not None and w["target"] not in names or w.get("agent") is not None and w["agent"] not in keys:
            issues.append(f"the waiver of {w.get('code')} names an unknown target or agent")
    headers = dict(header(k, interpolate(str(v))) for k, v in (raw.get("headers") or {}).items())
    if issues:
        raise ConfigError("; ".join(issues[:5]))
    return Config(list(targets.values()), found, waivers, headers, limits)


def load(
    path: str | None = None, folder: str = ".", extra_urls: tuple[str, ...] = (), discovered: tuple[dict, ...] = (),
    agents: list[str] | None = None, headers: list[str] | None = None, limits: dict[str, int] | None = None,
) -> Config:
    """An explicit path wins; else the first default name there is; else the URLs alone. Options win over the file."""
    chosen = Path(path) if path else next((p for n in NAMES if (p := Path(folder) / n).is_file()), None)
    raw: Any = {}
    if chosen is not None:
        text = chosen.read_text(encoding="utf-8")
        if chosen.suffix == ".json":
            raw = json.loads(text)
        else:
            import yaml

            raw = yaml.safe_load(text)
        if not isinstance(raw, dict):
            raise ConfigError("a configuration is a mapping")
    raw = raw | (limits or {}) | ({"agents": agents} if agents else {})
    found = parse(raw, extra_urls, discovered)
    if not found.targets:
        raise ConfigError("there is no target: list some, or give URLs or a sitemap")
    found.headers |= dict(header_option(h) for h in headers or ())
    return found


def target_frame(spark: SparkSession, config: Config) -> DataFrame:
    rows = [
        (k, t["id"], t["url"], t["statuses"], t["final"], *(bool(t["require"][r]) for r in REQUIRE), *(float(x) if x is not None else None for x in (t["first"], t["critical"])))
        for k, t in enumerate(config.targets)
    ]
    return spark.createDataFrame(rows, TARGETS)


def waiver_frame(spark: SparkSession, config: Config) -> DataFrame:
    rows = [(k, w["code"], w.get("target"), w.get("agent"), w["reason"], str(w["until"]) if w.get("until") else None) for k, w in enumerate(config.waivers)]
    return spark.createDataFrame(rows, WAIVERS)


TEMPLATE = """# Targets and limits of a page-delivery audit.
targets:
  - id: home
    url: https://example.com/
    require: {openGraph: true}
agents: [browser, googlebot, bingbot, twitterbot]
ignore: []
"""


def write_template(path: str = NAMES[0], force: bool = False) -> str:
    target = Path(path)
    if target.exists() and not force:
        raise ConfigError(f"{path} exists; it is only replaced by force")
    target.write_text(TEMPLATE)
    return str(target)
