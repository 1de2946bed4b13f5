"""Timing statistics and response variants of repeated samples, per target and agent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.functions.urls import hops_plain
from pagelens.operators import order_stats as O
from pagelens.operators.ingest import REDIRECTS
from pagelens.operators.rules import OPEN_GRAPH, card_values, critical_arrival, effective_twitter, evidence, of_kind, prepared, social_value

#: Compared per agent, with the probes that each looks at.
VARIANTS = ("completion", "status", "finalUrl", "redirectChain", "bodySha256", "metadataValues", "metadataLocations")
METRICS = ("headers_ms", "first_byte_ms", "complete_ms", "required_ms")


def timing_stats(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, min, median, p95 (nearest rank), max, spread of finite non-negative values; groups without any are absent."""
    ranks = {"_lower": O.LOWER_MIDDLE, "_upper": O.UPPER_MIDDLE, "p95": O.nearest(0.95)}
    found = O.at_ranks(samples.where(F.col(value) >= 0), keys, value, ranks, (F.min("_v").alias("min"), F.max("_v").alias("max")))
    median = 0.5 * F.col("_lower") + 0.5 * F.col("_upper")
    return found.select(*keys, "n", "min", median.alias("median"), "p95", "max", (F.col("max") - F.col("min")).alias("spread"))


def _pairs(signals: Column, value: Callable[[Column], Column] | None = None) -> Column:
    """(value, location) of the signals whose value is not empty, in the order in which they came."""
    shown = value or (lambda s: T.collapse(F.coalesce(s["resolved"], s["value"])))
    each = F.transform(signals, lambda s: F.struct(shown(s).alias("value"), s["location"].alias("location")))
    return F.filter(each, lambda x: x["value"] != "")


def _used_robots() -> Column:
    own = T.audience_of(F.col("agent"))
    return F.filter(of_kind("robots"), lambda s: (s["audience"] == "robots") | (s["audience"] == own))


def _one_value(signal: Column) -> Column:
    """The directives of one element, spelt out and reduced to those that hold, in order."""
    words = F.split(T.robots_value(signal["value"]), ",")
    return F.array_join(F.array_sort(T.effective_directives(F.filter(words, lambda w: w != ""))), ",")


def metadata_signatures() -> tuple[Column, Column]:
    """What a page says, and where it says it, as texts that are equal when two samples agree.

    Titles, descriptions and canonicals are sets of values, directives one effective value; headings and main text do not
    count. Social metadata count under a contract only: preview images keep their order, and a card's fields are those that
    the card shows, its own or the preview's. Places are compared together with the values that stand there.
    """
    ordered = lambda found: F.array_sort(F.array_distinct(found))
    values, places = [], []
    for kind in ("title", "description", "canonical"):
        pairs = _pairs(of_kind(kind))
        values.append(ordered(F.transform(pairs, lambda x: x["value"])).alias(kind))
        places.append(ordered(pairs).alias(kind))
    values.append(F.array_join(F.array_sort(F.col("effective")), ",").alias("robots"))
    places.append(ordered(_pairs(_used_robots(), _one_value)).alias("robots"))
    for p in OPEN_GRAPH:
        pairs = _pairs(of_kind("social", p), social_value)
        found = F.array_distinct(F.transform(pairs, lambda x: x["value"]))
        values.append(F.when(F.col("open_graph"), found if p == "og:image" else F.array_sort(found)).alias(p))
        places.append(F.when(F.col("open_graph"), pairs if p == "og:image" else ordered(pairs)).alias(p))
    for field, value in card_values():
        values.append(F.when(F.col("twitter_card"), value).alias(f"card {field}"))
        places.append(F.when(F.col("twitter_card"), F.struct(value.alias("value"), effective_twitter(field)["location"].alias("location"))).alias(f"card {field}"))
    return F.to_json(F.struct(*values)), F.to_json(F.struct(*places))


def redirect_signature(redirects: Column) -> Column:
    """Status, URL and target of each redirect, URLs in normal form."""
    urls, targets = F.transform(redirects, lambda r: r["url"]), F.transform(redirects, lambda r: r["location"])
    nowhere = F.transform(redirects, lambda r: F.lit(None).cast("string"))
    return F.to_json(F.arrays_zip(F.transform(redirects, lambda r: r["status"]).alias("status"), hops_plain(nowhere, urls).alias("url"), hops_plain(urls, targets).alias("location")))


def all_arrived() -> Column:
    """Latest arrival of the required signals, null unless all of them are there."""
    wanted = [("require_title", "title"), ("require_description", "description"), ("require_canonical", "canonical"), ("require_h1", "h1"), ("require_main_text", "main")]
    gap = F.lit(False)
    for flag, kind in wanted:
        gap = gap | (F.col(flag) & (F.size(F.filter(of_kind(kind), lambda s: T.collapse(s["value"]) != "")) == 0))
    return F.when(~gap, critical_arrival())


def sampled(facts: DataFrame) -> DataFrame:
    """A narrow row a probe of what stability compares: digests of its signatures, and its times.

    Status, final URL and the time of headers are those of final responses, not of redirects; digests, metadata and the
    times of required signals and of completion are those of complete ones.
    """
    complete, final = F.col("completion") == "complete", F.col("status").isNotNull() & ~F.col("status").isin(*REDIRECTS)
    values, places = metadata_signatures()
    shown = (
        F.col("completion"), F.when(final, F.col("status").cast("string")), F.when(final, F.col("final_plain")),
        F.coalesce(redirect_signature(F.col("redirects")), F.lit("[]")), F.when(complete, F.coalesce("body_sha256", F.lit("<missing>"))),
        F.when(complete, values), F.when(complete, places),
    )
    return prepared(facts).select(
        "target_ord", "agent_ord", "agent", "url", complete.alias("whole"), *[F.sha2(c, 256).alias(f"v_{v}") for v, c in zip(VARIANTS, shown, strict=True)],
        F.when(final, F.col("headers_ms")).alias("headers_ms"), "first_byte_ms",
        F.when(complete, F.col("complete_ms")).alias("complete_ms"), F.when(complete, all_arrived()).alias("required_ms"),
    )


def stability(facts: DataFrame) -> DataFrame:
    """Samples, variant counts and timing statistics per target and agent."""
    return stability_of(sampled(facts))


def stability_of(rows: DataFrame) -> DataFrame:
    """`stability` of sampled() rows. They are read several times: give it stored ones where they cost much."""
    keys = ["target_ord", "agent_ord", "agent"]
    # signatures are counted by digest: two rounds of distinct values, none of them held as a set
    each = F.array(*[F.struct(F.lit(v).alias("field"), F.col(f"v_{v}").alias("value")) for v in VARIANTS])
    distinct = rows.select(*keys, F.explode(each).alias("e")).where("e.value IS NOT NULL").select(*keys, "e.field", "e.value").distinct()
    counted = distinct.groupBy(*keys).agg(*[F.count_if(F.col("field") == v).alias(v) for v in VARIANTS])
    times = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("ms")) for m in METRICS])
    timed = timing_stats(rows.select(*keys, F.explode(times).alias("t")).select(*keys, "t.metric", "t.ms"), [*keys, "metric"], "ms")
    stat = F.struct("n", "min", "median", "p95", "max", "spread")
    by_metric = timed.groupBy(*keys).agg(*[F.first(F.when(F.col("metric") == m, stat), ignorenulls=True).alias(m) for m in METRICS])
    whole = rows.groupBy(*keys).agg(
        F.first("url").alias("url"), F.count("*").alias("samples"), F.count_if("whole").alias("completeSamples")
    )
    return whole.join(counted, keys, "left").join(by_metric, keys, "left").select(*keys, "url", "samples", "completeSamples", *VARIANTS, *METRICS)


def stability_findings(stable: DataFrame) -> DataFrame:
    """Instability of responses, and of streams (a digest alone is only worth a note)."""
    response = [v for v in VARIANTS[:4]]
    stream = ["bodySha256", "metadataValues", "metadataLocations"]

    def one(rule: int, code: str, fields: list[str], severity: Column) -> Column:
        several = lambda shown: F.filter(F.array(*[F.when(F.col(v) > 1, shown(v)) for v in fields]), lambda x: x.isNotNull())
        changed = several(F.lit)
        counts = several(lambda v: F.concat(F.lit(v + "="), F.col(v).cast("string")))
        said = evidence(samples_n=F.col("samples"), completeSamples_n=F.col("completeSamples"), fields=F.array_join(changed, ", "), variantCounts=F.array_join(counts, "; "))
        return F.when(F.size(changed) > 0, F.struct(F.lit(rule).alias("rule_ord"), F.lit(code).alias("code"), severity.alias("severity"), said.alias("evidence")))

    meta = (F.col("metadataValues") > 1) | (F.col("metadataLocations") > 1)
    # both in one pass over what is costly to make
    both = F.array(one(42, "response-instability", response, F.lit("warning")), one(43, "stream-instability", stream, F.when(meta, "warning").otherwise("info")))
    return stable.select("target_ord", "agent_ord", "url", "agent", F.explode(both).alias("f")).where("f IS NOT NULL").select(
        "target_ord", F.lit(1 << 20).alias("sample"), F.col("agent_ord").alias("probe_ord"), "f.rule_ord", F.lit(0).alias("within"),
        "f.code", "f.severity", F.lit("Repeated requests were answered differently.").alias("message"), "url", "agent", "f.evidence",
    )
