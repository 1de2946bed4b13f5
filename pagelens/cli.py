"""Command line: check, compare, init. Exit codes: 0 clean, 1 findings or regressions reach the bar, 2 incomplete or wrong use."""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime
from pathlib import Path
from time import monotonic

from pyspark.sql import DataFrame, SparkSession

from pagelens.operators import compare, sitemap
from pagelens.operators import findings as fin
from pagelens.operators.framework import resolve_framework
from pagelens.operators.ingest import planned_probes
from pagelens.plans.audit import audit, release
from pagelens.session import local_session, ship
from pagelens.sinks import reports
from pagelens.sources import agents as agent_source
from pagelens.sources import config as conf
from pagelens.sources import fetch, http, runs

FORMATS = ("terminal", "json", "sarif", "html", "markdown", "junit", "github")
COMPARISONS = ("terminal", "json", "html", "markdown", "github")
BASELINE = "pagelens.baseline.json"


def _say(text: str) -> None:
    print(text, file=sys.stderr)


def _write(document: reports.Document, path: str | None) -> None:
    """To a file or the terminal; a path that ends in a slash is a folder in which Spark writes the document's lines."""
    if path is None:
        sys.stdout.writelines(reports.streamed(document))
    elif path.endswith("/"):
        reports.write_document(document, SparkSession.active(), path)
    else:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.writelines(reports.streamed(document))


def _report(kind: str, out: dict, summary: dict, head: dict, framework: str | None) -> reports.Document:
    f = out["findings"]
    return {
        "terminal": lambda: reports.terminal_document(out, summary | {"repeat": head["repeat"]}), "json": lambda: reports.json_document(out, summary, {k: v for k, v in head.items() if k != "repeat"}),
        "sarif": lambda: reports.sarif_document(f), "html": lambda: reports.html_document(out, summary, framework), "markdown": lambda: reports.markdown_document(out["summary"], f),
        "junit": lambda: reports.junit_document(out["probes"], f, out["targets"], summary), "github": lambda: reports.github_document(f),
    }[kind]()


def _discovered(spark: SparkSession, args: argparse.Namespace) -> list[dict]:
    """Targets of a sitemap with ids of their own; what went wrong on the way is told."""
    if args.sitemap is None:
        return []
    found = sitemap.discover(fetch.sitemap_docs, args.sitemap, urls=args.sitemap_limit, include=tuple(args.sitemap_include), exclude=tuple(args.sitemap_exclude), spark=spark)
    for error in found.errors:
        _say(error)
    if found.truncated:
        _say(f"discovery ended at a limit after {len(found.urls)} URLs")
    # at most as many rows as the limit of URLs
    ids = {r.url: r.id for r in sitemap.target_ids(spark.createDataFrame([(u,) for u in found.urls], "url string")).collect()}
    return [{"url": u, "id": ids[u]} for u in found.urls]


def _comparison(before: dict[str, DataFrame], after: dict[str, DataFrame], args: argparse.Namespace) -> tuple[DataFrame, dict]:
    changes = compare.compare_runs(before, after, args.min_ms, args.min_percent).persist()
    return changes, compare.comparison_summary(changes).first().asDict()


def check(args: argparse.Namespace) -> int:
    baseline = args.baseline or (BASELINE if args.update_baseline else None)
    if baseline and args.output and Path(baseline).resolve() == Path(args.output).resolve():
        raise conf.ConfigError("the report and the baseline are different files")
    began = monotonic()
    spark = ship(local_session())
    stored = runs.read_run(spark, baseline) if baseline and not args.update_baseline else None
    given = {k: v for k, v in (("timeoutMs", args.timeout), ("maxBytes", args.max_bytes), ("maxRedirects", args.max_redirects), ("repeat", args.repeat), ("concurrency", args.concurrency)) if v is not None}
    settings = conf.load(args.config, extra_urls=tuple(args.urls), discovered=tuple(_discovered(spark, args)), agents=args.agent, headers=args.header, limits=given)
    agents, targets = agent_source.frame(spark, settings.agents), conf.target_frame(spark, settings)
    limits = settings.limits
    tasks = planned_probes(targets, agents, limits["repeat"])
    raw = http.requested(tasks, limits["concurrency"], settings.headers, limits).persist()
    asked = tasks.select("probe_id", "target_ord", "agent_ord", "agent", "sample")
    probes = raw.drop("body", "chunk_ends", "chunk_at").join(asked, "probe_id")
    documents = raw.where("size(chunk_ends) > 0").select("probe_id", "body", "chunk_ends", "chunk_at")
    robots = fetch.robots_docs(targets, limits["concurrency"]).persist()
    now = datetime.now(UTC)
    out = audit(
        probes, documents, targets, agents, robots_docs=robots, waiver_rows=conf.waiver_frame(spark, settings), repeat=limits["repeat"],
        now=now.date().isoformat(), secrets=tuple(settings.headers.values()),
    )
    summary = out["summary"].first().asDict()
    head = {"schemaVersion": runs.VERSION, "generatedAt": now.isoformat(), "durationMs": round((monotonic() - began) * 1000), "repeat": limits["repeat"]}
    framework = resolve_framework(args.framework, out["probes"], ".") if args.format == "html" else None
    code = _baseline(stored, out, summary, head, baseline, args)
    code = max(fin.exit_code(summary, args.fail_on), code)
    _write(_report(args.format, out, summary, head, framework), args.output)
    if args.write_run:
        runs.write_run(out, out["summary"], args.write_run, now.isoformat(), baseline=True)
    release(out)
    raw.unpersist()
    robots.unpersist()
    return code


def _baseline(stored: dict | None, out: dict, summary: dict, head: dict, path: str | None, args: argparse.Namespace) -> int:
    """Writes the baseline, or compares with it; the comparison goes to the error stream."""
    if path is None:
        return 0
    if args.update_baseline:
        if summary["incomplete"]:
            _say("the baseline stays as it was: the run is incomplete")
            return 2
        _write(_report("json", out, summary, head, None), path)
        _say(f"{path} is the new baseline")
        return 0
    changes, found = _comparison(stored, out, args)
    sys.stderr.writelines(reports.streamed(reports.comparison_document("terminal", changes, found)))
    changes.unpersist()
    return int(args.fail_on != "never" and found["regressions"] > 0)


def compare_runs(args: argparse.Namespace) -> int:
    spark = ship(local_session())
    before, after = (runs.read_run(spark, p) for p in (args.baseline, args.candidate))
    changes, found = _comparison(before, after, args)
    pairs = compare.timeline_pairs(before, after) if args.format == "html" else None
    _write(reports.comparison_document(args.format, changes, found, pairs), args.output)
    changes.unpersist()
    return int(args.fail_on == "regression" and found["regressions"] > 0)


def _options(c: argparse.ArgumentParser) -> None:
    c.add_argument("urls", nargs="*")
    c.add_argument("-c", "--config", help="configuration file")
    c.add_argument("-a", "--agent", action="append", default=[], help="crawler profile, may be given again")
    c.add_argument("-H", "--header", action="append", default=[], help="'Name: value' for requests on the target's origin, may be given again")
    c.add_argument("--timeout", type=int, help="milliseconds a request may take")
    c.add_argument("--max-bytes", type=int)
    c.add_argument("--max-redirects", type=int)
    c.add_argument("--repeat", type=int, help="samples of each target and profile")
    c.add_argument("--concurrency", type=int, help="requests at a time, 1 to 16")
    c.add_argument("--sitemap", help="URL or file of a sitemap to take targets from")
    c.add_argument("--sitemap-include", action="append", default=[])
    c.add_argument("--sitemap-exclude", action="append", default=[])
    c.add_argument("--sitemap-limit", type=int, default=sitemap.URLS)
    c.add_argument("--baseline", help="JSON report to compare with")
    c.add_argument("--update-baseline", action="store_true", help="write the baseline instead")
    c.add_argument("-f", "--format", choices=FORMATS, default="terminal")
    c.add_argument("-o", "--output")
    c.add_argument("--fail-on", choices=("never", "error", "warning", "info"), default="error")
    c.add_argument("--framework", default="auto", help="auto, none or a name")
    c.add_argument("--no-color", action="store_true", help="output never has colours; taken for scripts that say so")
    c.add_argument("--write-run", help="folder for the run's tables as Parquet")
    c.set_defaults(min_ms=compare.MIN_MS, min_percent=compare.MIN_PERCENT)


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="pagelens")
    sub = top.add_subparsers(dest="command", required=True)
    _options(sub.add_parser("check"))
    d = sub.add_parser("compare")
    d.add_argument("baseline")
    d.add_argument("candidate")
    d.add_argument("-f", "--format", choices=COMPARISONS, default="terminal")
    d.add_argument("-o", "--output")
    d.add_argument("--fail-on", choices=("regression", "never"), default="regression")
    d.add_argument("--min-ms", type=float, default=compare.MIN_MS)
    d.add_argument("--min-percent", type=float, default=compare.MIN_PERCENT)
    d.add_argument("--no-color", action="store_true")
    i = sub.add_parser("init")
    i.add_argument("path", nargs="?", default=conf.NAMES[0])
    i.add_argument("--force", action="store_true")
    given = list(sys.argv[1:] if argv is None else argv)
    if given and given[0] not in ("check", "compare", "init", "-h", "--help"):
        given.insert(0, "check")
    args = top.parse_args(given)
    try:
        if args.command == "init":
            print(conf.write_template(args.path, args.force))
            return 0
        return check(args) if args.command == "check" else compare_runs(args)
    except (conf.ConfigError, runs.RunError, sitemap.SitemapError, ValueError) as error:
        _say(str(error))
        return 2


if __name__ == "__main__":
    sys.exit(main())
