"""Finding rules: one expression a rule over a probe's facts, evaluated together in one pass.

Signals are gathered once per probe (their number is capped), joined with the probe's target and agent, and every
rule adds its findings to an array; rules that compare agents group by target and sample.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.functions.urls import are_http_urls, url_plain, urls_resolve
from pagelens.operators.ingest import REDIRECTS
from pagelens.schemas import EVIDENCE

OPEN_GRAPH = ("og:title", "og:type", "og:url", "og:image", "og:description")
OPEN_GRAPH_REQUIRED = OPEN_GRAPH[:4]
TWITTER = ("twitter:card", "twitter:title", "twitter:description", "twitter:image")
URL_VALUED = ("og:url", "og:image", "twitter:image")
_FINDING = f"array<struct<rule_ord:int,within:int,code:string,severity:string,message:string,evidence:{EVIDENCE}>>"


def _text(v: Column | str) -> Column:
    return F.lit(v) if isinstance(v, str) else v


def evidence(**items: Column) -> Column:
    """Ordered (key, type, value) entries; a null value leaves its entry out. Names ending in _n are numbers."""
    entries = []
    for name, value in items.items():
        key, kind = (name[:-2], "number") if name.endswith("_n") else (name, "string")
        shown = T.json_number(value.cast("double")) if kind == "number" else value.cast("string")
        entries.append(F.struct(F.lit(key).alias("k"), F.lit(kind).alias("t"), shown.alias("v")))
    return F.filter(F.array(*entries), lambda e: e["v"].isNotNull()) if entries else F.array().cast(EVIDENCE)


def finding(rule: int, code: Column | str, severity: Column | str, when: Column, message: Column | str, within: Column | int = 0, **items: Column) -> Column:
    one = F.struct(
        F.lit(rule).alias("rule_ord"),
        (F.lit(within) if isinstance(within, int) else within).cast("int").alias("within"),
        _text(code).alias("code"),
        _text(severity).alias("severity"),
        _text(message).alias("message"),
        evidence(**items).alias("evidence"),
    )
    return F.when(F.coalesce(when, F.lit(False)), F.array(one)).otherwise(F.array().cast(_FINDING))


def of_kind(kind: str, prop: str | None = None) -> Column:
    return F.filter("signals", lambda s: (s["kind"] == kind) & (F.lit(True) if prop is None else s["property"] == prop))


def _values(signals: Column) -> Column:
    return F.filter(F.transform(signals, lambda s: T.collapse(F.coalesce(s["resolved"], s["value"]))), lambda v: v != "")


def _name(prop: str) -> str:
    return "s_" + prop.replace(":", "_")


KINDS = ("title", "description", "canonical", "h1", "main")
AUDIENCES = ("robots", "googlebot", "bingbot")


@lru_cache(maxsize=1)
def _preparations(application: str) -> tuple[dict[str, Column], ...]:
    """Columns that several rules read, in three layers, built once for an application."""
    audience = lambda a: F.filter(of_kind("robots"), lambda s: s["audience"] == a)
    texts = lambda found: F.filter(F.transform(found, lambda s: T.robots_value(s["value"])), lambda v: v != "")
    own = T.audience_of(F.col("agent"))
    first = {f"v_{k}": _values(of_kind(k)) for k in KINDS}
    first |= {f"r_{a}": texts(audience(a)) for a in AUDIENCES}
    first["r_used"] = texts(F.filter(of_kind("robots"), lambda s: (s["audience"] == "robots") | (s["audience"] == own)))
    first |= {_name(p): F.get(F.filter(of_kind("social", p), lambda s: T.collapse(s["value"]) != ""), 0) for p in (*OPEN_GRAPH, *TWITTER)}
    first["header_items"] = F.filter(
        T.robots_header(F.col("headers")["x-robots-tag"]), lambda i: T.header_applies(i["scope"], F.col("agent"), F.col("user_agent"))
    )
    first["final_plain"], first["expected_plain"] = url_plain("final_url"), url_plain("expected_final_url")
    words = lambda c: F.array_distinct(F.flatten(F.transform(c, lambda v: F.split(v, ","))))
    second = {f"d_{a}": words(F.col(f"r_{a}")) for a in AUDIENCES} | {"d_used": words(F.col("r_used"))}
    second |= {f"t_{f}": F.col(_name(f"twitter:{f}")) if f == "card" else F.coalesce(_name(f"twitter:{f}"), _name(f"og:{f}")) for f in ("card", "title", "description", "image")}
    og = F.when(F.col("open_graph"), T.strings(OPEN_GRAPH)).otherwise(T.strings([]))
    tw = F.when(F.col("twitter_card"), T.strings(TWITTER)).otherwise(T.strings([]))
    backing = [F.when(F.col("twitter_card") & F.col(_name(f"twitter:{f}")).isNull(), F.lit(f"og:{f}")) for f in ("title", "description", "image")]
    second["audited"] = F.filter(F.array_union(F.array_union(og, tw), F.array(*backing)), lambda x: x.isNotNull())
    second["header_names"] = F.array_distinct(F.transform("header_items", lambda i: i["directive"]))
    third = {"effective": T.effective_directives(F.col("d_used"))} | {f"o_{a}": T.has_opposites(F.col(f"d_{a}")) for a in AUDIENCES}
    return first, second, third


def prepared(facts: DataFrame) -> DataFrame:
    """Facts with what several rules read, each computed once: values by kind, directives, social fields, header."""
    for layer in _preparations(facts.sparkSession.sparkContext.applicationId):
        facts = facts.withColumns(layer)
    return facts


def kind_values(kind: str) -> Column:
    return F.col(f"v_{kind}")


def first_social(prop: str) -> Column:
    return F.col(_name(prop))


def effective_twitter(field: str) -> Column:
    """twitter:<field>, or the same og: field; the card has no fallback."""
    return F.col(f"t_{field}")


def probe_facts(probes: DataFrame, documents: DataFrame, targets: DataFrame, agents: DataFrame) -> DataFrame:
    """One row a probe: its own columns, target and agent columns, signals (URLs resolved) and blocks of structured data.

    `documents` are inspected ones; a probe's is that of its document_id where there is such a column, else of its probe_id.
    """
    key = "document_id" if "document_id" in probes.columns else "probe_id"
    found = documents.select(F.col("probe_id").alias(key), F.col("signals").alias("_signals"), F.col("json_ld").alias("_blocks"))
    joined = probes.join(found, key, "left").join(targets.withColumnRenamed("id", "target_id"), "target_ord").join(agents.drop("agent"), "agent_ord")
    kinds = dict(joined.dtypes)
    joined = joined.withColumns({c: F.coalesce(c, F.expr(f"CAST(array() AS {kinds[c]})")) for c in ("_signals", "_blocks")})
    url_valued = lambda s: (s["kind"] == "canonical") | F.coalesce(s["property"].isin(*URL_VALUED), F.lit(False))
    refs = F.transform("_signals", lambda s: F.when(url_valued(s), s["value"]))
    joined = joined.withColumn("_resolved", urls_resolve(F.coalesce("final_url", "requested_url"), refs)).withColumn("_absolute", are_http_urls(refs))
    names = ("ord", "kind", "property", "audience", "value", "location", "at_ms", "observed_by_byte")
    signals = F.transform(
        "_signals",
        lambda s, i: F.struct(*[s[n].alias(n) for n in names], F.get("_resolved", i).alias("resolved"), F.get("_absolute", i).alias("absolute")),
    )
    return joined.withColumn("signals", signals).withColumnRenamed("_blocks", "blocks").drop("_signals", "_resolved", "_absolute")


def _repeats(rule: int, kind: str, name: str, found: Column) -> Column:
    distinct = F.array_distinct(found)
    same = F.size(distinct) == 1
    return finding(
        rule,
        F.when(same, f"duplicate-{name}").otherwise(f"conflicting-{name}"),
        "warning",
        F.size(found) >= 2,
        F.when(same, f"The {kind} is given more than once.").otherwise(f"Several values compete as the {kind}."),
        count_n=F.size(found),
        distinctValues_n=F.size(distinct),
        values=F.array_join(distinct, " | "),
    )


def _robots_rules(rule: int) -> list[Column]:
    """Directives that a general or an agent's own audience is given twice, and own ones that loosen the general ones.

    One element alone never disagrees with itself, and what other agents are told does not count.
    """
    out, reported, own = [], F.lit(False), T.audience_of(F.col("agent"))
    for k, name in enumerate(AUDIENCES):
        found = F.col(f"r_{name}")
        distinct = F.array_distinct(found)
        repeated = (F.size(found) >= 2) & (F.lit(name == "robots") | (own == name))
        opposed = repeated & F.col(f"o_{name}")
        reported = reported | opposed
        code = F.when(opposed, "conflicting-robots").when(F.size(distinct) == 1, "duplicate-robots").otherwise("multiple-robots")
        out.append(
            finding(
                rule, code, "warning", repeated, F.lit(f"Crawler directives for {name} are repeated or disagree."), k,
                audience=F.lit(name), count_n=F.size(found), distinctValues_n=F.size(distinct), values=F.array_join(distinct, " | "),
            )
        )
    generic = T.with_meaning(F.col("d_robots"), "none")
    special = F.when(own == "googlebot", F.col("d_googlebot")).when(own == "bingbot", F.col("d_bingbot")).otherwise(T.strings([]))
    special = T.with_meaning(special, "all")
    both = F.array_sort(F.array_union(generic, special))
    out.append(
        finding(
            rule, "conflicting-robots", "warning", ~reported & T.loosened(generic, special), "A crawler's own directives loosen the general ones.", 3,
            audience=F.lit("effective"), count_n=F.size("r_used"), distinctValues_n=F.size(both), values=F.array_join(both, ","),
        )
    )
    return out


def _header_rules(rule: int) -> list[Column]:
    header, names, effective = F.col("headers")["x-robots-tag"], F.col("header_names"), F.col("effective")
    scoped = F.array_distinct(F.transform(F.filter("header_items", lambda i: i["scope"].isNotNull()), lambda i: i["directive"]))
    blocking, strict = F.arrays_overlap(names, T.strings(T.BLOCKING)), F.arrays_overlap(names, T.strings(T.RESTRICTIVE))
    loose = F.arrays_overlap(names, T.strings(T.PERMISSIVE))
    useless = loose & ~blocking & ~strict & F.array_contains(effective, "noindex")
    code = F.when(blocking, "robots-header-noindex").when(strict, "robots-header-restrictive").when(useless, "robots-header-ineffective")
    severity = F.when(blocking, "error").when(strict, "warning").otherwise("info")
    return [
        finding(
            rule, code, severity, header.isNotNull() & code.isNotNull(), "The response header carries crawler directives.",
            header=F.substring(header, 1, 300), directives=F.array_join(names, ","),
            agentScopedDirectives=F.nullif(F.array_join(scoped, ","), F.lit("")),
            effective=F.when(~blocking & ~strict, F.array_join(effective, ",")),
        )
    ]


def critical_arrival() -> Column:
    """Latest first arrival of the required signals that are present; null with an incomplete social contract."""
    wanted = [("require_title", "title"), ("require_description", "description"), ("require_canonical", "canonical"), ("require_h1", "h1"), ("require_main_text", "main")]
    times = [F.when(F.col(flag), F.get(F.filter(of_kind(k), lambda s: T.collapse(s["value"]) != ""), 0)["at_ms"]) for flag, k in wanted]
    og = [first_social(p)["at_ms"] for p in OPEN_GRAPH_REQUIRED]
    tw = [effective_twitter(p)["at_ms"] for p in ("card", "title", "description", "image")]
    missing = lambda xs: F.exists(F.array(*xs), lambda x: x.isNull())
    broken = (F.col("open_graph") & missing(og)) | (F.col("twitter_card") & missing(tw))
    social = [F.when(F.col("open_graph"), x) for x in og] + [F.when(F.col("twitter_card"), x) for x in tw]
    return F.when(~broken, F.array_max(F.array(*times, *social)))


@lru_cache(maxsize=1)
def _probe_rules(application: str) -> list[Column]:
    """An array of findings for each rule that looks at one probe alone, built once for an application."""
    complete = F.col("completion") == "complete"
    final = F.col("status").isNotNull() & ~F.col("status").isin(*REDIRECTS)
    rules = [
        finding(1, "incomplete-probe", "error", ~complete, F.concat(F.lit("The response ended as "), "completion", F.lit(".")), completion=F.col("completion"), bytesRead_n=F.col("bytes_read"), error=F.col("error")),
        finding(2, "status-mismatch", "error", final & ~F.array_contains("statuses", F.col("status")), "The status is not an expected one.", actual_n=F.col("status"), expected=F.array_join(F.transform("statuses", lambda x: x.cast("string")), ",")),
        finding(3, "final-url-mismatch", "error", final & F.col("expected_final_url").isNotNull() & (F.col("final_plain") != F.col("expected_plain")), "The response came from another URL than expected.", actual=F.col("final_url"), expected=F.col("expected_final_url")),
    ]
    for k, (kind, flag, code, severity) in enumerate(
        (("title", "require_title", "missing-title", "error"), ("description", "require_description", "missing-description", "warning"), ("canonical", "require_canonical", "missing-canonical", "warning"), ("h1", "require_h1", "missing-h1", "warning"), ("main", "require_main_text", "missing-main-text", "warning"))
    ):
        rules.append(finding(4 + k, code, severity, complete & F.col(flag) & (F.size(kind_values(kind)) == 0), f"A required {kind} is missing."))
    for k, kind in enumerate(("title", "description", "canonical")):
        rules.append(_repeats(9 + k, kind, kind, kind_values(kind)))
    rules += _robots_rules(15) + _header_rules(18)
    verdict, meta = F.col("robots_verdict"), F.col("effective")
    rules += [
        finding(21, "robots-txt-unavailable", "info", verdict == "unavailable", "robots.txt could not be read.", robotsTxtUrl=F.col("robots_url"), status_n=F.col("robots_status"), error=F.col("robots_error")),
        finding(22, "robots-txt-disallowed", "error", verdict == "disallowed", "robots.txt disallows this URL for the agent.", robotsTxtUrl=F.col("robots_url"), matched=F.col("robots_matched")),
        finding(23, "robots-txt-conflict", "warning", (verdict == "disallowed") & ~F.array_contains(meta, "noindex"), "robots.txt disallows what the page lets be indexed.", robotsTxtUrl=F.col("robots_url"), effective=F.array_join(meta, ",")),
        finding(24, "content-encoding-ignored", "info", F.lower(F.trim(F.col("headers")["content-encoding"])).isin("", "identity") == F.lit(False), "The response was encoded although it was not asked to be.", contentEncoding=F.col("headers")["content-encoding"]),
    ]
    names = lambda xs: F.filter(F.array(*[F.when(got.isNull(), F.lit(p)) for p, got in xs]), lambda x: x.isNotNull())
    no_og = names([(p, first_social(p)) for p in OPEN_GRAPH_REQUIRED])
    no_tw = names([(f"twitter:{f}", effective_twitter(f)) for f in ("card", "title", "description", "image")])
    rules += [
        finding(25, "missing-open-graph-metadata", "warning", F.col("open_graph") & complete & (F.size(no_og) > 0), "Required Open Graph fields are missing.", fields=F.array_join(no_og, ", ")),
        finding(26, "missing-twitter-card-metadata", "warning", F.col("twitter_card") & complete & (F.size(no_tw) > 0), "Required card fields are missing.", fields=F.array_join(no_tw, ", ")),
    ]
    for k, p in enumerate((*OPEN_GRAPH, *TWITTER)):
        found = _values(of_kind("social", p))
        if p in ("og:type", "twitter:card"):
            found = F.transform(found, lambda v: F.lower(v))
        distinct = F.array_distinct(found)
        code = F.when(F.size(distinct) == 1, "duplicate-social-metadata").otherwise("conflicting-social-metadata")
        rules += [] if p == "og:image" else [
            finding(27, code, "warning", F.array_contains(F.col("audited"), p) & (F.size(found) >= 2), f"{p} is given more than once.", k, property=F.lit(p), count_n=F.size(found), distinctValues_n=F.size(distinct), values=F.array_join(distinct, " | "))
        ]
    bad = F.filter(of_kind("social"), lambda s: s["property"].isin("og:url", "og:image") & F.col("open_graph") & (T.collapse(s["value"]) != "") & ~s["absolute"])
    card = effective_twitter("image")
    bad = F.array_distinct(F.concat(bad, F.filter(F.array(card), lambda s: F.col("twitter_card") & s.isNotNull() & ~s["absolute"])))
    each = F.transform(bad, lambda s, i: F.struct(F.lit(29).alias("rule_ord"), i.cast("int").alias("within"), F.lit("invalid-social-metadata-url").alias("code"), F.lit("warning").alias("severity"), F.concat(s["property"], F.lit(" is no absolute URL.")).alias("message"), evidence(property=s["property"], value=s["value"]).alias("evidence")))
    rules.append(F.coalesce(each, F.array().cast(_FINDING)))
    invalid, limited = F.filter("blocks", lambda b: ~b["valid"]), F.filter("blocks", lambda b: b["valid"].isNull() & b["limit"].isNotNull())
    rules += [
        finding(30, "invalid-json-ld", "warning", complete & (F.size(invalid) > 0), "Structured data could not be parsed.", invalidBlocks_n=F.size(invalid), errors=F.array_join(F.transform(invalid, lambda b: b["error"]), " | ")),
        finding(31, "json-ld-analysis-limit", "warning", F.size(limited) > 0, "Structured data went over the limits of analysis.", blocks_n=F.size(limited), reasons=F.array_join(F.array_distinct(F.transform(limited, lambda b: b["limit"])), ",")),
    ]
    body = lambda xs: F.exists(xs, lambda s: s["location"] == "body")
    own = T.audience_of(F.col("agent"))
    placed = [
        ("title", body(of_kind("title"))), ("description", body(of_kind("description"))), ("canonical", body(of_kind("canonical"))),
        ("robots", body(F.filter(of_kind("robots"), lambda s: (s["audience"] == "robots") | (s["audience"] == own)))),
        *((p, body(of_kind("social", p)) & F.array_contains(F.col("audited"), p)) for p in (*OPEN_GRAPH, *TWITTER)),
    ]
    fields = F.filter(F.array(*[F.when(x, F.lit(n)) for n, x in placed]), lambda x: x.isNotNull())
    arrival = critical_arrival()
    rules += [
        finding(32, "head-metadata-in-body", "error", F.col("requires_head") & (F.size(fields) > 0), "Metadata stands in the body, where this agent does not look.", fields=F.array_join(fields, ", ")),
        finding(33, "slow-first-byte", "warning", F.col("first_byte_ms") > F.col("max_first_byte_ms"), "The first byte came late.", observedMs_n=F.col("first_byte_ms"), limitMs_n=F.col("max_first_byte_ms")),
        finding(34, "slow-critical-signals", "warning", arrival > F.col("max_critical_ms"), "Required signals came late.", observedMs_n=arrival, limitMs_n=F.col("max_critical_ms")),
    ]
    return rules


def probe_findings(facts: DataFrame) -> DataFrame:
    """Findings of every rule that looks at one probe alone (F1 to F34 of the inventory)."""
    have = facts.columns
    blank = {c: "string" for c in ("robots_verdict", "robots_url", "robots_error", "robots_matched")} | {"robots_status": "int"}
    full = facts.withColumns({c: F.lit(None).cast(k) for c, k in blank.items() if c not in have})
    rules = _probe_rules(facts.sparkSession.sparkContext.applicationId)
    found = prepared(full).select("target_ord", "sample", F.col("agent_ord").alias("probe_ord"), "agent", "url", F.explode(F.concat(*rules)).alias("f"))
    return found.select("target_ord", "sample", "probe_ord", "f.rule_ord", "f.within", "f.code", "f.severity", "f.message", "url", "agent", "f.evidence")


def social_value(signal: Column) -> Column:
    """A social signal's value as it is compared: URLs resolved, types and cards in lower case."""
    text = T.collapse(signal["value"])
    return (
        F.when(signal["property"].isin(*URL_VALUED), T.collapse(F.coalesce(signal["resolved"], signal["value"])))
        .when(signal["property"].isin("og:type", "twitter:card"), F.lower(text)).otherwise(text)
    )


def social_values(prop: str) -> Column:
    """Distinct values of a property, in the order in which they came."""
    return F.array_distinct(F.filter(F.transform(of_kind("social", prop), social_value), lambda v: v != ""))


def card_values() -> list[tuple[str, Column]]:
    """The value that a card shows for each of its fields, its own or the preview's."""
    return [(f, F.coalesce(F.nullif(social_value(effective_twitter(f)), F.lit("")), F.lit("<missing>"))) for f in ("card", "title", "description", "image")]


def drift_values() -> dict[str, tuple[int, Column, Column]]:
    """code -> (rule, value compared between agents, whether it applies)."""
    or_missing = lambda v: F.when(v == "", "<missing>").otherwise(v)
    named = lambda pairs: F.concat_ws(", ", *[F.concat(F.lit(f"{name}="), v) for name, v in pairs])
    yes = F.lit(True)
    return {
        "agent-status-drift": (35, F.coalesce(F.col("status").cast("string"), F.lit("missing")), yes),
        "agent-final-url-drift": (36, F.coalesce("final_plain", F.lit("")), yes),
        "agent-title-drift": (37, F.coalesce(F.get(kind_values("title"), 0), F.lit("<missing>")), yes),
        "agent-canonical-drift": (38, or_missing(F.array_join(F.array_sort(F.array_distinct(kind_values("canonical"))), " | ")), yes),
        "agent-robots-drift": (39, or_missing(F.array_join(F.array_sort(F.col("effective")), ",")), yes),
        "agent-open-graph-drift": (40, named([(p, or_missing(F.array_join(social_values(p), " | "))) for p in OPEN_GRAPH]), F.col("open_graph")),
        "agent-twitter-card-drift": (41, named(card_values()), F.col("twitter_card")),
    }


def drift_findings(facts: DataFrame) -> DataFrame:
    """What complete probes of one target and sample disagree on between agents."""
    entries = F.array(*[
        F.struct(F.lit(rule).alias("rule_ord"), F.lit(code).alias("code"), F.when(applies, value).alias("value"))
        for code, (rule, value, applies) in drift_values().items()
    ])
    each = prepared(facts.where("completion = 'complete'"))
    each = each.select("target_ord", "sample", "url", "agent_ord", "agent", F.explode(entries).alias("e")).where("e.value IS NOT NULL")
    return drift(each.select("target_ord", "sample", "url", "agent_ord", "agent", "e.rule_ord", "e.code", "e.value"))


def drift(each: DataFrame) -> DataFrame:
    """Findings of (target_ord, sample, url, agent_ord, agent, rule_ord, code, value) rows whose values differ in a group."""
    ordered = F.array_sort(F.collect_list(F.struct("agent_ord", "agent", "value")))
    grouped = each.groupBy("target_ord", "sample", "rule_ord", "code").agg(
        F.first("url").alias("url"), ordered.alias("seen"), F.count_distinct("value").alias("variants")
    )
    shown = F.array_join(F.transform("seen", lambda s: F.concat(s["agent"], F.lit("="), s["value"])), "; ")
    return grouped.where("variants > 1").select(
        "target_ord", "sample", F.lit(1 << 20).alias("probe_ord"), "rule_ord", F.lit(0).alias("within"), "code", F.lit("warning").alias("severity"),
        F.concat(F.lit("Agents were answered differently: "), F.regexp_replace("code", "^agent-|-drift$", "")).alias("message"), "url",
        F.lit(None).cast("string").alias("agent"), evidence(values=shown).alias("evidence"),
    )
