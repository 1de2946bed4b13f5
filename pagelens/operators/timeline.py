"""When a probe's milestones were reached, and how ready its link previews are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.operators.ingest import REDIRECTS
from pagelens.operators.rules import OPEN_GRAPH_REQUIRED, effective_twitter, first_social, of_kind, prepared
from pagelens.operators.stability import all_arrived

# The milestones in their order.
MILESTONES = ("headers", "first-byte", "title", "description", "canonical", "open-graph", "twitter-card", "required", "main", "complete")
_CARD = ("card", "title", "description", "image")


def _first(kind: str) -> Column:
    return F.get(F.filter(of_kind(kind), lambda s: T.collapse(s["value"]) != ""), 0)


def _worst(places: Column) -> Column:
    return F.when(F.array_contains(places, "body"), "body").when(F.array_contains(places, "document"), "document").otherwise("head")


def _observed(signals: list[Column]) -> Column:
    """(at_ms, byte, location) of signals that must all be there: the latest, and their place or mixed."""
    places = F.array_distinct(F.array(*[s["location"] for s in signals]))
    whole = reduce(lambda a, b: a & b, [s.isNotNull() for s in signals])
    latest = lambda f: F.array_max(F.array(*[s[f] for s in signals]))
    place = F.when(F.size(places) == 1, places[0]).otherwise("mixed")
    return F.when(whole, F.struct(latest("at_ms").alias("at_ms"), latest("observed_by_byte").cast("double").alias("byte"), place.alias("location")))


def _at(value: Column, when: Column | None = None) -> Column:
    none = F.struct(value.alias("at_ms"), F.lit(None).cast("double").alias("byte"), F.lit(None).cast("string").alias("location"))
    return F.when(value.isNotNull() if when is None else value.isNotNull() & when, none)


def milestones(facts: DataFrame) -> DataFrame:
    """(target_ord, agent, sample, milestone_ord, milestone, at_ms, byte, location) of every milestone that a probe reached."""
    complete = F.col("completion") == "complete"
    found = {
        "headers": _at(F.col("headers_ms")),
        "first-byte": _at(F.col("first_byte_ms")),
        "title": _observed([_first("title")]),
        "description": _observed([_first("description")]),
        "canonical": _observed([_first("canonical")]),
        "open-graph": _observed([first_social(p) for p in OPEN_GRAPH_REQUIRED]),
        "twitter-card": _observed([effective_twitter(f) for f in _CARD]),
        "required": _at(all_arrived()),
        "main": _observed([_first("main")]),
        "complete": _at(F.col("complete_ms"), complete),
    }
    each = F.array(*[F.struct(F.lit(k).alias("milestone_ord"), F.lit(n).alias("milestone"), found[n].alias("o")) for k, n in enumerate(MILESTONES)])
    rows = prepared(facts).select("target_ord", "agent", "sample", F.explode(each).alias("m")).where("m.o IS NOT NULL")
    return rows.select("target_ord", "agent", "sample", "m.milestone_ord", "m.milestone", "m.o.*")


def readiness(facts: DataFrame) -> DataFrame:
    """(target_ord, agent_ord, sample, open_graph, twitter_card): present of required fields, or arrival and worst place of all."""

    def shown(signals: list[Column]) -> Column:
        there = F.filter(F.array(*signals), lambda s: s.isNotNull())
        arrival = F.array_max(F.transform(there, lambda s: s["at_ms"]))
        whole = F.concat(T.milliseconds(arrival), F.lit("/"), _worst(F.transform(there, lambda s: s["location"])))
        return F.when(F.size(there) < len(signals), F.concat(F.size(there).cast("string"), F.lit(f"/{len(signals)}"))).otherwise(whole)

    return prepared(facts).select(
        "target_ord", "agent_ord", "sample",
        shown([first_social(p) for p in OPEN_GRAPH_REQUIRED]).alias("open_graph"), shown([effective_twitter(f) for f in _CARD]).alias("twitter_card"),
    )


def timings(facts: DataFrame) -> DataFrame:
    """(target_ord, agent, metric, ms) of every probe, each metric over the probes that it looks at."""
    complete = F.col("completion") == "complete"
    final = F.col("status").isNotNull() & ~F.col("status").isin(*REDIRECTS)
    found = {
        "headers_ms": F.when(final, F.col("headers_ms")), "first_byte_ms": F.col("first_byte_ms"),
        "complete_ms": F.when(complete, F.col("complete_ms")), "required_ms": F.when(complete, F.col("required_ms")),
    }
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("ms")) for m, v in found.items()])).alias("x")
    return facts.select("target_ord", "agent", each).select("target_ord", "agent", "x.*")
