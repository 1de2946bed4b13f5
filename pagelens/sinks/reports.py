"""Report formats as documents: texts, and rows that Spark renders.

What belongs to a row is a column of text; a document is its head, those texts in order and its foot. `streamed` gives a
document out as one text, of which the driver holds one partition of rows at a time. `write_document` has Spark write it as
files that, one after the other, are the document; its rows do not pass the driver.
"""

from __future__ import annotations

import html
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.operators import findings as fin
from pagelens.operators.explain import explained
from pagelens.operators.findings import rank
from pagelens.operators.order_stats import in_order

STABLE_EVIDENCE = ("audience", "completion", "fields", "property")
#: Next steps shown in the terminal and in HTML, and signal arrivals of a target in HTML.
STEPS, HTML_STEPS, ARRIVALS = 5, 6, 60


@dataclass(frozen=True)
class Rows:
    """The column value of a frame, in order; `between` follows every row but the last, which `last` follows."""

    frame: DataFrame
    order: tuple[Column | str, ...]
    between: str = ""
    last: str = ""


Document = Iterator[str | Rows]


def streamed(document: Document) -> Iterator[str]:
    """A document as one text after the other, whole and in order."""
    for part in document:
        if isinstance(part, str):
            yield part
            continue
        held = None
        for row in part.frame.orderBy(*part.order).select("value").toLocalIterator():
            if held is not None:
                yield held + part.between
            held = row.value
        if held is not None:
            yield held + part.last


def write_document(document: Document, spark: SparkSession, path: str) -> None:
    """Writes a document as text files under `path` that are its text, one after the other in the order of their names.

    The rows of all parts are sorted together, by part and by their place in it, and each task writes its range. The writer
    ends each row's line itself, so texts and rows are whole lines.
    """
    tables, text = [], ""

    def add(rows: DataFrame) -> None:
        tables.append(rows.withColumn("_part", F.lit(len(tables))))

    def close() -> None:
        if text:
            if not text.endswith("\n"):
                raise ValueError("the texts of a document are whole lines")
            add(spark.createDataFrame([(text, 0)], "value string, _place bigint"))

    for part in document:
        if isinstance(part, str):
            text += part
            continue
        close()
        text = ""
        keyed = part.frame.select("value", *[(F.col(o) if isinstance(o, str) else o).alias(f"_{n}") for n, o in enumerate(part.order)])
        placed = in_order(keyed, keyed.columns[1:], "_place", "_all")
        end = F.when(F.col("_place") < F.col("_all") - 1, F.lit(part.between)).otherwise(F.lit(part.last))
        add(placed.select(F.concat("value", end).alias("value"), "_place"))
    close()
    lines = reduce(DataFrame.unionByName, tables).orderBy("_part", "_place")
    lines.select(F.regexp_replace("value", r"\n\z", "").alias("value")).write.mode("overwrite").text(path)


def _severity_order() -> list:
    return [rank("severity"), "code", "url", "agent", "sample", "probe_ord", "within"]


def fingerprint() -> Column:
    """A digest of what makes a finding the same one in the next run."""
    stable = F.array_sort(F.filter("evidence", lambda e: e["k"].isin(*STABLE_EVIDENCE)))
    parts = F.array(F.col("code"), F.col("url"), F.coalesce("agent", F.lit("")), F.to_json(stable))
    return F.sha2(F.to_json(parts), 256)


def evidence_json(evidence: Column | str = "evidence") -> Column:
    """Evidence as one JSON object in its order; numbers and booleans without quotes."""
    entry = lambda e: F.concat(T.json_string(e["k"]), F.lit(":"), F.when(e["t"] == "string", T.json_string(e["v"])).otherwise(e["v"]))
    return F.concat(F.lit("{"), F.array_join(F.transform(evidence, entry), ","), F.lit("}"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """rule_id, level (of the gravest), results, urls."""
    level = F.element_at(F.array(F.lit("error"), F.lit("warning"), F.lit("note")), F.min(rank("severity")) + 1)
    return findings.groupBy(F.col("code").alias("rule_id")).agg(level.alias("level"), F.count("*").alias("results"), F.count_distinct("url").alias("urls"))


def github_lines(findings: DataFrame) -> DataFrame:
    """The findings with value, an annotation each."""
    level = F.when(F.col("severity") == "info", "notice").otherwise(F.col("severity"))
    where = F.coalesce(F.concat(F.lit(" ("), "agent", F.lit(")")), F.lit(""))
    line = F.format_string("::%s title=%s::%s %s%s", level, T.annotation_property(F.col("code")), T.annotation_text(F.col("message")), T.annotation_text(F.col("url")), T.annotation_text(where))
    return findings.withColumn("value", F.concat(line, F.lit("\n")))


def github_document(findings: DataFrame) -> Document:
    yield Rows(github_lines(findings), ("target_ord", "sample", "probe_ord", "rule_ord", "within"))


def markdown_lines(findings: DataFrame) -> DataFrame:
    cell = lambda c: T.markdown_cell(F.coalesce(F.col(c), F.lit("")))
    return findings.withColumn("value", F.format_string("| %s | %s | %s | %s | %s |\n", *map(cell, ("severity", "code", "url", "agent", "message"))))


def markdown_document(summary: DataFrame, findings: DataFrame) -> Document:
    s = summary.first()
    yield f"## {s.errors} errors, {s.warnings} warnings, {s.info} notes\n\n| Severity | Code | URL | Agent | Message |\n| --- | --- | --- | --- | --- |\n"
    yield Rows(markdown_lines(findings), tuple(_severity_order()))


def write_json(findings: DataFrame, path: str) -> None:
    """One JSON object a line, distributed."""
    findings.write.json(path)


def json_document(out: dict[str, DataFrame], summary: dict, head: dict) -> Document:
    """A byte-stable report that can be read back: keys in order, a row a line, a final newline."""
    yield "{\n"
    for key, value in sorted((head | {"summary": summary}).items()):
        yield f"  {json.dumps(key)}: {json.dumps(value, sort_keys=True)},\n"
    names = [n for n in ("findings", "json_ld", "probes", "signals", "targets", "waived") if n in out]
    for k, name in enumerate(names):
        yield f"  {json.dumps(name)}: [\n"
        frame = out[name]
        kept = sorted(frame.columns)
        rows = frame.select(F.to_json(F.struct(*kept), {"ignoreNullFields": "true"}).alias("value"), *[F.col(c).alias(f"_{c}") for c in kept if frame.schema[c].dataType.typeName() not in ("map",)])
        order = [c for c in ("target_ord", "sample", "probe_ord", "agent_ord", "rule_ord", "within", "probe_id", "kind", "property", "ord") if c in kept]
        shown = rows.withColumn("value", F.concat(F.lit("    "), "value"))
        yield Rows(shown, (*[f"_{c}" for c in order], "value"), ",\n", "\n")
        yield "  ]" + (",\n" if k + 1 < len(names) else "\n")
    yield "}\n"


def sarif_document(findings: DataFrame, tool: str = "pagelens") -> Document:
    """Rules of the codes, then a result a finding."""
    named = explained(findings)
    titles = {r.code: (r.title, r.remedy) for r in named.groupBy("code").agg(F.min("title").alias("title"), F.min("remedy").alias("remedy")).collect()}
    rules = [
        {"id": r.rule_id, "shortDescription": {"text": titles[r.rule_id][0]}, "help": {"text": titles[r.rule_id][1]}, "defaultConfiguration": {"level": r.level}}
        for r in sarif_rules(findings).orderBy("rule_id").collect()
    ]
    level = F.when(F.col("severity") == "info", "note").otherwise(F.col("severity"))
    result = F.struct(
        F.col("code").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("url").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))).alias("locations"),
        F.struct(fingerprint().alias("finding/v1")).alias("partialFingerprints"),
    )
    driver = json.dumps({"driver": {"name": tool, "rules": rules}})
    yield f'{{"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{{"tool": {driver}, "results": [\n'
    yield Rows(findings.withColumn("value", F.to_json(result)), tuple(_severity_order()), ",\n", "\n")
    yield "]}]}\n"


def _element(found: Column) -> Column:
    """The failing element of a case for findings (rank, code, message, agent, evidence), or nothing."""
    first = found[0]
    tag = F.when(first["rank"] == 0, "error").otherwise("failure")
    line = lambda f: F.concat_ws("\n", F.concat(f["code"], F.lit(": "), f["message"]), F.concat(F.lit("agent: "), f["agent"]), F.concat(F.lit("evidence: "), f["evidence"]))
    body = F.array_join(F.transform(found, line), "\n\n")
    return F.when(F.size(found) == 0, "").otherwise(
        F.format_string('<%s type="%s" message="%s">%s</%s>', tag, T.xml_text(first["code"]), T.xml_text(first["message"]), T.xml_text(body), tag)
    )


def junit_cases(probes: DataFrame, findings: DataFrame) -> DataFrame:
    """(target_ord, agent_ord, sample, value, grave): a case for each probe, and one for findings of a target as a whole.

    A finding belongs to the probes of its agent whose samples it names, or to all of them where it names none; grave is 0 with
    an error, 1 with a warning, else null.
    """
    numbers = F.get(F.filter("evidence", lambda e: e["k"] == "sampleNumbers"), 0)["v"]
    samples = F.when(numbers.isNotNull(), F.split(numbers, ",").cast("array<int>")).when(F.col("sample") < 1 << 20, F.array("sample"))
    shown = F.struct(rank("severity").alias("rank"), "rule_ord", "within", "code", "message", "agent", evidence_json().alias("evidence")).alias("f")
    graver = findings.where("severity <> 'info'").select("target_ord", F.col("agent").alias("case_agent"), samples.alias("samples"), shown)
    asked = probes.select("target_ord", "agent_ord", "agent", "sample", F.coalesce("complete_ms", "first_byte_ms").alias("ms"))
    near = (F.col("c.target_ord") == F.col("f.target_ord")) & (F.col("c.agent") == F.col("f.case_agent")) & (F.col("f.samples").isNull() | F.array_contains("f.samples", F.col("c.sample")))
    # one pass over the findings: those of no agent meet no probe, and make the case of their target
    met = asked.alias("c").join(graver.alias("f"), near, "full").where("c.target_ord IS NOT NULL OR f.case_agent IS NULL")
    case_of = [F.coalesce("c.target_ord", "f.target_ord").alias("target_ord"), *[F.when(F.col("c.target_ord").isNull(), F.lit(v)).otherwise(F.col(f"c.{n}")).alias(n) for n, v in (("agent_ord", 1 << 20), ("agent", "target"), ("sample", 0))], F.col("c.ms").alias("ms")]
    found = F.filter(F.array_sort(F.collect_list("f")), lambda f: f["code"].isNotNull()).alias("found")
    each = met.select(*case_of, F.col("f.f").alias("f")).groupBy("target_ord", "agent_ord", "agent", "sample", "ms").agg(found)
    several = probes.agg(F.max("sample")).first()[0] or 1
    name = F.when((F.col("agent_ord") == 1 << 20) | (F.lit(several) == 1), F.col("agent")).otherwise(F.concat("agent", F.lit("#"), "sample"))
    case = F.format_string('    <testcase classname="%s" name="%s" time="%.3f">%s</testcase>\n', "place", T.xml_text(name), F.coalesce("ms", F.lit(0.0)) / 1000, _element(F.col("found")))
    every = each.withColumn("place", F.concat(F.lit("target "), "target_ord"))
    return every.select("target_ord", "agent_ord", "sample", case.alias("value"), F.get("found", 0)["rank"].alias("grave"))


def junit_document(probes: DataFrame, findings: DataFrame, targets: DataFrame, summary: dict) -> Document:
    """A suite a target; totals are counted over all cases."""
    cases = junit_cases(probes, findings)
    counts = [F.count("*").alias("tests"), F.count_if(F.col("grave") == 1).alias("failures"), F.count_if(F.col("grave") == 0).alias("errors")]
    total = cases.agg(*counts).first()
    head = lambda r: f'tests="{r.tests}" failures="{r.failures}" errors="{r.errors}" skipped="0"'
    yield f'<?xml version="1.0" encoding="UTF-8"?>\n<testsuites name="pagelens" {head(total)}>\n  <properties>\n'
    yield "".join(f'    <property name="{k}" value="{summary[k]}"/>\n' for k in ("waived", "incomplete"))
    yield "  </properties>\n"
    opens = cases.groupBy("target_ord").agg(*counts).join(targets.select("target_ord", "url"), "target_ord").select(
        "target_ord", F.lit(-1).alias("agent_ord"), F.lit(0).alias("sample"),
        F.format_string('  <testsuite name="%s" tests="%d" failures="%d" errors="%d" skipped="0">\n', T.xml_text(F.col("url")), "tests", "failures", "errors").alias("value"),
    )
    notes = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("severity") == "info", F.struct("sample", "probe_ord", "rule_ord", "within", F.concat("code", F.lit(": "), "message").alias("t"))))), lambda x: x["t"]), "\n")
    closes = cases.select("target_ord").distinct().join(findings.groupBy("target_ord").agg(notes.alias("notes")), "target_ord", "left").select(
        "target_ord", F.lit(1 << 21).alias("agent_ord"), F.lit(0).alias("sample"),
        F.concat(F.when(F.col("notes") != "", F.concat(F.lit("    <system-out>"), T.xml_text(F.col("notes")), F.lit("</system-out>\n"))).otherwise(""), F.lit("  </testsuite>\n")).alias("value"),
    )
    yield Rows(opens.unionByName(cases.drop("grave")).unionByName(closes), ("target_ord", "agent_ord", "sample"))
    yield "</testsuites>\n"


def _signal_text(kind: str) -> Column:
    s = F.get(F.filter("signals", lambda s: s["kind"] == kind), 0)
    return F.when(s.isNull(), "-").otherwise(F.concat(T.milliseconds(s["at_ms"]), F.lit("/"), s["location"]))


def terminal_document(out: dict[str, DataFrame], summary: dict) -> Document:
    """Targets with their probes, link previews, stability and findings, then what to do next; control characters are masked."""
    s = summary
    yield f"{s['targets']} targets, {s['probes']} probes: {s['errors']} errors, {s['warnings']} warnings, {s['info']} notes, {s['waived']} waived\n"
    sections = [out["targets"].select("target_ord", F.lit(0).alias("part"), F.lit("").alias("place"), F.col("url").alias("value"))]
    line = lambda *cells: F.concat(F.lit("  "), *[F.rpad(F.coalesce(c.cast("string"), F.lit("-")), n, " ") for c, n in cells])
    place = F.format_string("%06d/%04d", "agent_ord", "sample")
    if "facts" in out:
        from pagelens.operators.timeline import readiness

        row = line(
            (F.col("sample"), 3), (T.shortened(F.col("label"), 16), 18), (F.col("status"), 5), (F.col("completion"), 20), (T.milliseconds(F.col("first_byte_ms")), 10),
            (T.milliseconds(F.col("complete_ms")), 10), (T.size_text(F.col("bytes_read")), 11), *((_signal_text(k), 18) for k in ("title", "description", "canonical", "main")),
        )
        sections.append(out["facts"].select("target_ord", F.lit(1).alias("part"), place.alias("place"), row.alias("value")))
        social = out["facts"].where("open_graph OR twitter_card").select("target_ord", "agent_ord", "sample", "label")
        ready = readiness(out["facts"]).join(social, ["target_ord", "agent_ord", "sample"])
        sections.append(ready.select("target_ord", F.lit(2).alias("part"), place.alias("place"), line((F.col("sample"), 3), (F.col("label"), 18), (F.concat(F.lit("preview "), "open_graph"), 26), (F.concat(F.lit("card "), "twitter_card"), 26)).alias("value")))
    if "stability" in out and s["repeat"] > 1:
        timing = [(F.concat(F.lit(f"{m} "), T.milliseconds(F.col(f"{m}.median")), F.lit(" p95 "), T.milliseconds(F.col(f"{m}.p95"))), 34) for m in ("first_byte_ms", "complete_ms", "required_ms")]
        sections.append(out["stability"].select("target_ord", F.lit(3).alias("part"), F.format_string("%06d", "agent_ord").alias("place"), line((F.col("agent"), 18), (F.concat("completeSamples", F.lit("/"), "samples"), 8), *timing).alias("value")))
    text = line((F.col("severity"), 9), (F.col("code"), 34), (F.col("agent"), 16), (T.shortened(F.col("message"), 120), 120))
    order = F.format_string("%d/%09d/%06d/%04d/%06d", rank("severity"), "sample", "probe_ord", "rule_ord", "within")
    sections.append(out["findings"].select("target_ord", F.lit(4).alias("part"), order.alias("place"), text.alias("value")))
    every = sections[0]
    for part in sections[1:]:
        every = every.unionByName(part)
    yield Rows(every.withColumn("value", F.concat(F.rtrim(T.printable(F.col("value"))), F.lit("\n"))), ("target_ord", "part", "place"))
    steps = fin.next_steps(out["findings"], titles(out["findings"])).limit(STEPS).collect()
    yield "".join(["Next:\n", *(f"  {r.title} ({r.occurrences})\n" for r in steps)]) if steps else ""


def titles(findings: DataFrame) -> DataFrame:
    return explained(findings).groupBy("code").agg(F.min("title").alias("title"))


def preview_cards(facts: DataFrame) -> DataFrame:
    """target_ord with the title, description and image a link preview would show: og, then twitter, then the page's."""
    from pagelens.operators.rules import first_social, kind_values, prepared

    text = lambda p: first_social(p)["value"]
    rows = prepared(facts).select(
        "target_ord", F.struct(F.col("agent") != "browser", "agent_ord", "sample").alias("o"),
        F.struct(
            F.coalesce(text("og:title"), text("twitter:title"), F.get(kind_values("title"), 0)).alias("title"),
            F.coalesce(text("og:description"), text("twitter:description"), F.get(kind_values("description"), 0)).alias("description"),
            F.coalesce(text("og:image"), text("twitter:image")).alias("image"),
        ).alias("card"),
    )
    return rows.groupBy("target_ord").agg(F.min_by("card", "o").alias("card")).select("target_ord", "card.*")


def arrival_rows(facts: DataFrame, limit: int = ARRIVALS) -> DataFrame:
    """(target_ord, place, label, kind, at_ms, location, observed_by_byte, value, n) of a target's first arrivals.

    Five kinds of each probe: the first signal that says something, else the first. n counts all of the target's, of
    which the first `limit` are listed.
    """
    from pyspark.sql import Window

    kinds = ("title", "description", "canonical", "h1", "main")
    of = lambda k: F.filter("signals", lambda s: s["kind"] == k)
    first = lambda k: F.coalesce(F.get(F.filter(of(k), lambda s: F.trim(s["value"]) != ""), 0), F.get(of(k), 0))
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("kind"), first(k).alias("s")) for i, k in enumerate(kinds)])
    rows = facts.select("target_ord", "agent_ord", "sample", "label", F.explode(each).alias("x")).where("x.s IS NOT NULL")
    by_target = Window.partitionBy("target_ord")
    place = F.row_number().over(by_target.orderBy("agent_ord", "sample", "x.i"))
    rows = rows.withColumn("place", place).withColumn("n", F.count("*").over(by_target)).where(F.col("place") <= limit)
    return rows.select("target_ord", "place", "label", "x.kind", "x.s.at_ms", "x.s.location", "x.s.observed_by_byte", T.shortened(F.col("x.s.value"), 120).alias("value"), "n")


def html_document(out: dict[str, DataFrame], summary: dict, framework: str | None = None, title: str = "Page delivery") -> Document:
    """A page with totals and next steps, then each target: its verdict, findings with what to do, arrivals and preview."""
    e = lambda c: T.xml_text(F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit("")))
    steps = fin.next_steps(out["findings"], titles(out["findings"])).limit(HTML_STEPS).collect()
    yield f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>\n<ul>'
    yield "".join(f"<li>{html.escape(k)}: {v}</li>" for k, v in summary.items()) + "</ul>\n<ol>"
    yield "".join(f"<li>{html.escape(r.title)} ({r.occurrences})</li>" for r in steps) + "</ol>\n"
    verdicts = out["targets"].select("target_ord", "url").join(fin.target_verdicts(out["findings"]), "target_ord", "left")
    sections = [verdicts.select("target_ord", F.lit(0).alias("part"), F.lit("").alias("place"), F.format_string("<h2>%s</h2><p>Verdict: %s</p>", e("url"), F.coalesce("verdict", F.lit("clean"))).alias("value"))]
    named = explained(out["findings"], framework)
    order = F.format_string("%d/%s/%09d/%06d/%06d", rank("severity"), "code", "sample", "probe_ord", "within")
    snippet = F.when(F.col("snippet").isNotNull(), F.concat(F.lit("<pre>"), e("snippet"), F.lit("</pre>"))).otherwise("")
    row = F.format_string('<p class="%s"><b>%s</b> %s (%s) %s: %s %s</p>%s', "severity", e("severity"), e("title"), e("code"), e("agent"), e("message"), e("remedy"), snippet)
    sections.append(named.select("target_ord", F.lit(1).alias("part"), order.alias("place"), row.alias("value")))
    if "facts" in out:
        arrivals = arrival_rows(out["facts"])
        cells = F.format_string("<p>%s %s %s %s %d %s</p>", e("label"), e("kind"), T.milliseconds(F.col("at_ms")), "location", "observed_by_byte", e("value"))
        cut = F.when((F.col("place") == ARRIVALS) & (F.col("n") > ARRIVALS), F.format_string("<p>%d of %d arrivals</p>", F.lit(ARRIVALS), "n")).otherwise("")
        sections.append(arrivals.select("target_ord", F.lit(2).alias("part"), F.format_string("%06d", "place").alias("place"), F.concat(cells, cut).alias("value")))
        card = F.format_string("<aside><b>%s</b><p>%s</p>%s</aside>", e("title"), e("description"), e("image"))
        sections.append(preview_cards(out["facts"]).select("target_ord", F.lit(3).alias("part"), F.lit("").alias("place"), card.alias("value")))
    every = sections[0]
    for part in sections[1:]:
        every = every.unionByName(part)
    yield Rows(every.withColumn("value", F.concat("value", F.lit("\n"))), ("target_ord", "part", "place"))
    yield "</html>\n"


def comparison_document(kind: str, changes: DataFrame, summary: dict, pairs: DataFrame | None = None) -> Document:
    """One rendering of a comparison: terminal, json, html, markdown, or github (regressions alone).

    `pairs` are timelines of both runs, whose milestones HTML shows as bars on the scale of the longest.
    """
    from pagelens.operators.compare import change_order

    names = ("kind", "code", "target", "agent", "field", "before", "after")
    text = lambda n: F.coalesce(F.col(n), F.lit(""))
    line = F.concat(text("kind"), F.lit(": "), F.concat_ws(" ", *map(text, names[1:6])), F.lit(" -> "), text("after"))
    if kind == "terminal":
        yield json.dumps(summary) + "\n"
        yield Rows(changes.withColumn("value", F.concat(T.printable(line), F.lit("\n"))), tuple(change_order()))
    elif kind == "json":
        yield f'{{\n  "summary": {json.dumps(summary, sort_keys=True)},\n  "changes": [\n'
        row = F.to_json(F.struct(*sorted(changes.columns)), {"ignoreNullFields": "false"})
        yield Rows(changes.withColumn("value", F.concat(F.lit("    "), row)), tuple(change_order()), ",\n", "\n")
        yield "  ]\n}\n"
    elif kind == "markdown":
        yield "| " + " | ".join(names) + " |\n|" + " --- |" * len(names) + "\n"
        yield Rows(changes.withColumn("value", F.format_string("| %s |\n", F.concat_ws(" | ", *[T.markdown_cell(text(n)) for n in names]))), tuple(change_order()))
    elif kind == "github":
        bad = F.format_string("::error title=%s::%s\n", T.annotation_property(F.col("code")), T.annotation_text(line))
        yield Rows(changes.where("kind = 'regression'").withColumn("value", bad), tuple(change_order()))
    else:
        yield f"<!doctype html><html lang=\"en\"><meta charset=\"utf-8\"><h1>Comparison</h1><p>{html.escape(json.dumps(summary))}</p><table>\n"
        cells = F.concat(*[F.concat(F.lit("<td>"), T.xml_text(text(n)), F.lit("</td>")) for n in names])
        yield Rows(changes.withColumn("value", F.concat(F.lit("<tr>"), cells, F.lit("</tr>\n"))), tuple(change_order()))
        yield "</table>\n"
        if pairs is not None:
            most = pairs.agg(F.max(F.greatest("at_ms_a", "at_ms_b"))).first()[0] or 1.0
            bar = lambda c: F.format_string('<i style="margin-left:%.1f%%">%s</i>', F.coalesce(F.col(c), F.lit(0.0)) / most * 100, T.milliseconds(F.col(c)))
            value = F.format_string("<p>%s %s %s %s %s</p>\n", T.xml_text(F.col("target")), T.xml_text(text("agent")), "milestone", bar("at_ms_a"), bar("at_ms_b"))
            yield Rows(pairs.withColumn("value", value), ("target", "agent", "milestone_ord"))
        yield "</html>\n"
