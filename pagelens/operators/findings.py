"""Findings across samples, their totals, verdicts and next steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def rank(severity: Column | str) -> Column:
    value = F.col(severity) if isinstance(severity, str) else severity
    return F.when(value == "error", 0).when(value == "warning", 1).otherwise(2)


def coalesce_findings(findings: DataFrame, total_samples: int) -> DataFrame:
    """One row per (target, code, severity, message, url, agent), first appearance first, evidence merged.

    Distinct values of an evidence key, text and numbers apart, are joined; sampleNumbers, occurrences and
    totalSamples are then set.
    """
    key = ["target_ord", "code", "severity", "message", "url", "agent"]
    order = F.struct("sample", "probe_ord", "rule_ord", "within")
    groups = findings.groupBy(*key).agg(
        F.min(order).alias("first"),
        F.array_sort(F.collect_set("sample")).alias("numbers"),
        F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.struct(order.alias("o"), "evidence"))).alias("parts"),
    )
    every = F.flatten(F.transform("parts", lambda p: p["evidence"]))
    own = F.array(*map(F.lit, ("sampleNumbers", "occurrences", "totalSamples")))
    names = F.array_except(F.array_distinct(F.transform("all", lambda e: e["k"])), own)

    def merged(k: Column) -> Column:
        same = F.array_distinct(F.filter("all", lambda e: e["k"] == k))
        kind = F.when(F.size(same) == 1, same[0]["t"]).otherwise("string")
        return F.struct(k.alias("k"), kind.alias("t"), F.array_join(F.transform(same, lambda e: e["v"]), " | ").alias("v"))

    number = lambda k, v: F.struct(F.lit(k).alias("k"), F.lit("number").alias("t"), v.cast("string").alias("v"))
    listed = F.array_join(F.transform("numbers", lambda x: x.cast("string")), ",")
    added = F.array(
        F.struct(F.lit("sampleNumbers").alias("k"), F.lit("string").alias("t"), listed.alias("v")),
        number("occurrences", F.size("numbers")),
        number("totalSamples", F.lit(total_samples)),
    )
    return groups.withColumn("all", every).select(
        "target_ord", F.col("first.sample").alias("sample"), F.col("first.probe_ord").alias("probe_ord"), F.col("first.rule_ord").alias("rule_ord"),
        F.col("first.within").alias("within"), "code", "severity", "message", "url", "agent", F.concat(F.transform(names, merged), added).alias("evidence"),
    )


def summary(targets: DataFrame, probes: DataFrame, findings: DataFrame, waived: DataFrame | None = None) -> DataFrame:
    """targets, probes, errors, warnings, info, incomplete, waived in one row."""
    counted = findings.agg(*[F.count_if(F.col("severity") == s).alias(n) for s, n in (("error", "errors"), ("warning", "warnings"), ("info", "info"))])
    probed = probes.agg(F.count("*").alias("probes"), F.count_if(F.col("completion") != "complete").alias("incomplete"))
    gone = (targets.where("false") if waived is None else waived).agg(F.count("*").alias("waived"))
    # each side is one row
    return (
        targets.agg(F.count("*").alias("targets")).crossJoin(F.broadcast(probed)).crossJoin(F.broadcast(counted)).crossJoin(F.broadcast(gone))
        .select("targets", "probes", "errors", "warnings", "info", "incomplete", "waived")
    )


def verdict(incomplete: Column, errors: Column, warnings: Column, infos: Column) -> Column:
    return (
        F.when(incomplete > 0, "incomplete").when(errors > 0, "errors").when(warnings > 0, "warnings").when(infos > 0, "notes").otherwise("clean")
    )


def target_verdicts(findings: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("severity") == s)
    return findings.groupBy("target_ord").agg(
        verdict(F.count_if(F.col("code") == "incomplete-probe"), count("error"), count("warning"), count("info")).alias("verdict")
    )


def next_steps(findings: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """code, severity, occurrences, title; gravest first, then most frequent, then by title."""
    from pagelens.functions.text import title_of

    grouped = findings.groupBy("code").agg(F.min(rank("severity")).alias("rank"), F.count("*").alias("occurrences"))
    named = grouped if titles is None else grouped.join(titles.select("code", "title"), "code", "left")
    title = F.coalesce(F.col("title"), title_of(F.col("code"))) if titles is not None else title_of(F.col("code"))
    severity = F.element_at(F.array(F.lit("error"), F.lit("warning"), F.lit("info")), F.col("rank") + 1)
    return named.select("code", severity.alias("severity"), "occurrences", title.alias("title"), "rank").orderBy("rank", F.desc("occurrences"), "title").drop("rank")


def exit_code(row: dict[str, int], fail_on: str = "error") -> int:
    """2 for anything incomplete, whatever fail_on says; 1 when findings reach it; else 0."""
    if row["incomplete"]:
        return 2
    reached = {"never": 0, "error": row["errors"], "warning": row["errors"] + row["warnings"], "info": row["errors"] + row["warnings"] + row["info"]}
    return int(reached[fail_on] > 0)
