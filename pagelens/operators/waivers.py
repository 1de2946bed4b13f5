"""Waivers: the first active match takes a finding away; spent and unused ones are reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.operators.rules import evidence


def expired(until: Column, now: str) -> Column:
    """The until date is the last day that counts."""
    return until.isNotNull() & (until < now)


#: Which of code, target and agent a waiver names.
_SHAPES = tuple((code, target, agent) for code in (True, False) for target in (True, False) for agent in (True, False))


def first_waiver(findings: DataFrame, waivers: DataFrame) -> DataFrame:
    """`findings` (with target_id) and waiver_ord, the first of the waivers that match each, null where none does.

    A waiver that leaves the code, the target or the agent open is one of eight shapes. Waivers of one shape are told apart
    by what they name, so each shape is one join by equality against the first waiver of each name, twice where a target
    may be named by id or by URL; Spark broadcasts these while they are small, and findings are then not shuffled.
    """
    named = (F.col("code") != "*", F.col("target").isNotNull(), F.col("agent").isNotNull())
    there = {tuple(r) for r in waivers.select(*[c.alias(f"s{k}") for k, c in enumerate(named)]).distinct().collect()}
    out, hits = findings, []
    for shape in (s for s in _SHAPES if s in there):
        fields = [f for f, given in zip(("code", "target", "agent"), shape) if given]
        one = waivers.where(named[0] == shape[0]).where(named[1] == shape[1]).where(named[2] == shape[2])
        least = one.groupBy(*fields).agg(F.min("waiver_ord").alias("_ord"))
        for target in ("target_id", "url") if shape[1] else (None,):
            hit, name = f"_hit{len(hits)}", {"target": target}
            side = least.select(*[F.col(f).alias(f"_{f}") for f in fields], F.col("_ord").alias(hit))
            on = [F.col(name.get(f, f)) == F.col(f"_{f}") for f in fields]
            out = (out.join(side, on, "left") if fields else out.crossJoin(side)).drop(*[f"_{f}" for f in fields])
            hits.append(F.col(hit))
    first = F.array_min(F.array(*hits)) if hits else F.lit(None).cast("int")
    return out.select(*findings.columns, first.alias("waiver_ord"))


def apply_waivers(findings: DataFrame, waivers: DataFrame, targets: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept findings, waived findings with waiver_ord, diagnostics about waivers)."""
    ids = targets.select("target_ord", F.col("id").alias("target_id"))
    active = waivers.where(~expired(F.col("until"), now))
    judged = first_waiver(findings.join(ids, "target_ord", "left"), active)
    kept = judged.where("waiver_ord IS NULL").select(*findings.columns)
    waived = judged.where("waiver_ord IS NOT NULL").select(*findings.columns, "waiver_ord")
    used = waived.groupBy("waiver_ord").agg(F.count("*").alias("used"))
    state = waivers.join(used, "waiver_ord", "left")
    anchors = _anchors(waivers, targets)
    gone, idle = expired(F.col("until"), now), F.col("used").isNull()
    notes = state.join(anchors, "waiver_ord").where(gone | idle).select(
        F.col("anchor_ord").alias("target_ord"), F.lit(1 << 21).alias("sample"), F.lit(0).alias("probe_ord"),
        F.when(gone, 44).otherwise(45).alias("rule_ord"), F.col("waiver_ord").alias("within"),
        F.when(gone, "waiver-expired").otherwise("waiver-unused").alias("code"), F.when(gone, "warning").otherwise("info").alias("severity"),
        F.when(gone, "A waiver is past its date.").otherwise("A waiver matched nothing.").alias("message"), F.col("anchor_url").alias("url"), "agent",
        evidence(waiverCode=F.col("code"), target=F.col("target"), until=F.when(gone, F.col("until")), reason=F.col("reason")).alias("evidence"),
    )
    return kept, waived, notes


def _anchors(waivers: DataFrame, targets: DataFrame) -> DataFrame:
    """The target a diagnostic hangs on: that of the id, else of the URL, else (unscoped) the first without an id, else the first."""
    t = targets.select(F.col("target_ord").alias("anchor_ord"), "id", F.col("url").alias("anchor_url"))
    grade = (
        F.when(F.col("target") == F.col("id"), 0)
        .when(F.col("target") == F.col("anchor_url"), 1)
        .when(F.col("target").isNull() & F.col("id").isNull(), 2)
        .otherwise(3)
    )
    ends = t.agg(F.min_by(F.struct("anchor_ord", "id", "anchor_url"), "anchor_ord").alias("a"), F.min(F.when(F.col("id").isNull(), F.struct("anchor_ord", "id", "anchor_url"))).alias("b"))
    some = ends.select(F.explode(F.filter(F.array("a", "b"), lambda x: x.isNotNull())).alias("x")).select("x.*").distinct()
    # scoped waivers meet their target by equality; the fallback is at most two rows
    scoped = waivers.select("waiver_ord", "target")
    by_id = scoped.join(t, F.col("target") == F.col("id")).unionByName(scoped.join(t, F.col("target") == F.col("anchor_url")))
    rest = waivers.select("waiver_ord", "target").crossJoin(F.broadcast(some))
    both = by_id.unionByName(rest).withColumn("grade", grade)
    return both.groupBy("waiver_ord").agg(F.min(F.struct("grade", "anchor_ord", "anchor_url")).alias("m")).select("waiver_ord", "m.anchor_ord", "m.anchor_url")


def unmatched_waivers(waivers: DataFrame, targets: DataFrame, agents: DataFrame) -> DataFrame:
    """Waivers that name a target or an agent that does not exist."""
    ids = targets.select(F.col("id").alias("target")).unionByName(targets.select(F.col("url").alias("target")))
    lost = waivers.where("target IS NOT NULL").join(ids, "target", "left_anti")
    return lost.unionByName(waivers.where("agent IS NOT NULL").join(agents.select("agent"), "agent", "left_anti").select(*lost.columns)).distinct()
