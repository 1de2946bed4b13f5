"""Two runs side by side: changes of findings, responses, metadata, timings, policies, agents and targets.

Every grain is one full outer join of the two runs after grouping, keyed by the target's id or URL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.functions.urls import url_for_origin
from pagelens.operators.findings import rank
from pagelens.operators.order_stats import medians
from pagelens.operators.rules import probe_facts
from pagelens.operators.timeline import milestones, timings

CHANGES = "kind string, target string, agent string, field string, code string, before string, after string, detail string"
# Floors below which a change of median timing is no regression.
MIN_MS, MIN_PERCENT = 250.0, 25.0
POLICY = (
    "statuses", "expected_final_url", "require_title", "require_description", "require_canonical", "require_h1",
    "require_main_text", "open_graph", "twitter_card", "max_first_byte_ms", "max_critical_ms",
)
REQUIREMENTS = ("require_title", "require_description", "require_canonical", "require_h1", "require_main_text", "open_graph", "twitter_card")


def target_key(frame: DataFrame) -> DataFrame:
    return frame.withColumn("target", F.coalesce(F.concat(F.lit("id:"), "id"), F.concat(F.lit("url:"), "url")))


def keyed(frame: DataFrame, targets: DataFrame) -> DataFrame:
    """`frame` with its target's key in place of target_ord."""
    return frame.join(target_key(targets).select("target_ord", "target"), "target_ord").drop("target_ord")


def repeated_targets(targets: DataFrame) -> DataFrame:
    """Keys that name more than one target of a run; a comparison of such a run is refused."""
    return target_key(targets).groupBy("target").agg(F.count("*").alias("n")).where("n > 1").select("target")


def _sides(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    a, b = before.alias("a"), after.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) if k == "agent" else F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    joined = a.join(b, on, "full_outer")
    values = [c for c in before.columns if c not in keys]
    return joined.select(
        *[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys],
        *[F.col(f"a.{c}").alias(f"{c}_a") for c in values],
        *[F.col(f"b.{c}").alias(f"{c}_b") for c in values],
        F.col(f"a.{keys[0]}").isNotNull().alias("in_a"),
        F.col(f"b.{keys[0]}").isNotNull().alias("in_b"),
    )


def _change(frame: DataFrame, kind: Column | str, code: Column | str, field: Column | None = None, before: Column | None = None, after: Column | None = None, detail: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    agent = F.col("agent") if "agent" in frame.columns else none
    or_none = lambda x: none if x is None else x
    return frame.select(
        lit(kind).alias("kind"), "target", agent.alias("agent"), or_none(field).alias("field"), lit(code).alias("code"),
        or_none(before).alias("before"), or_none(after).alias("after"), or_none(detail).alias("detail"),
    )


def evidence_text(evidence: Column) -> Column:
    return F.to_json(F.array_sort(evidence))


def finding_changes(before: DataFrame, after: DataFrame, ignored: tuple[str, ...] = ("incomplete-probe",), matched: DataFrame | None = None) -> DataFrame:
    """Findings (target, code, agent, severity, evidence) gained, lost, moved in severity or changed in evidence.

    The gravest of a key stands for it, the first of equals in the order of findings (sample, probe_ord, rule_ord,
    within, as far as the columns are there, then by evidence). Codes in `ignored` do not count on targets that both
    runs have (`matched`); an added target counts all.
    """

    def top(df: DataFrame) -> DataFrame:
        order = [c for c in ("sample", "probe_ord", "rule_ord", "within") if c in df.columns]
        first = F.min(F.struct(rank("severity").alias("r"), *order, evidence_text(F.col("evidence")).alias("e"), "severity"))
        return df.groupBy("target", "code", "agent").agg(first.alias("f")).select("target", "code", "agent", "f.r", "f.severity", "f.e")

    both = _sides(top(before), top(after), ["target", "code", "agent"])
    if matched is not None:
        known = matched.select("target", F.lit(True).alias("known"))
        both = both.join(known, "target", "left").where(~(F.coalesce("known", F.lit(False)) & F.col("code").isin(*ignored)))
    new = F.when(F.col("severity_b") == "info", "changed").otherwise("regression")
    kind = (
        F.when(~F.col("in_a"), new).when(~F.col("in_b"), "fixed").when(F.col("r_b") < F.col("r_a"), "regression").when(F.col("r_b") > F.col("r_a"), "fixed")
        .when(F.col("e_a") != F.col("e_b"), "changed")
    )
    code = F.when(F.col("in_a") & F.col("in_b") & (F.col("r_a") == F.col("r_b")), "finding-evidence-changed").otherwise(F.col("code"))
    return _change(both.withColumn("k", kind).where("k IS NOT NULL"), F.col("k"), code, F.col("code"), F.coalesce("severity_a", F.lit("none")), F.coalesce("severity_b", F.lit("none")))


def _sets(probes: DataFrame) -> DataFrame:
    """Sorted distinct response facts per target and agent; probes have target and target_url."""
    listed = lambda c: F.array_sort(F.collect_set(c))
    hop = F.transform("redirects", lambda r: F.concat(r["status"].cast("string"), F.lit(" "), F.coalesce(r["location"], F.lit(""))))
    chain = F.when(F.size("redirects") > 0, F.array_join(hop, " > ")).otherwise("<none>")
    return probes.withColumn("short", url_for_origin("final_url", "target_url")).groupBy("target", "agent").agg(
        listed("completion").alias("completion"),
        listed(F.coalesce(F.col("status").cast("string"), F.lit("missing"))).alias("status"),
        listed("short").alias("final"),
        listed(chain).alias("chain"),
    )


def response_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    both = _sides(_sets(before), _sets(after), ["target", "agent"]).where("in_a AND in_b")
    out = None
    for c, code in (("completion", "probe-completion-changed"), ("status", "http-status-changed"), ("final", "final-url-changed"), ("chain", "redirect-chain-changed")):
        a, b = F.col(f"{c}_a"), F.col(f"{c}_b")
        whole = F.array(F.lit("complete"))
        kind = F.when(a == whole, "regression").when(b == whole, "fixed").otherwise("changed") if c == "completion" else F.lit("changed")
        part = _change(both.where(a != b), kind, code, F.lit(c), T.first_values(a), T.first_values(b))
        out = part if out is None else out.unionByName(part)
    return out


def metadata_changes(before: DataFrame, after: DataFrame, complete: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Changes of (target, agent, field, value, location) rows from complete probes; values are compared as written, URLs and directives too.

    `complete` has the (target, agent) rows of each run's complete probes, with signals or without; where it is not
    given, those that have signals.
    """
    pair_of = lambda df: df.select("target", "agent").distinct()
    first, second = complete or (before, after)
    both_have = pair_of(first).join(pair_of(second), ["target", "agent"])
    sets = lambda df: df.withColumn("text", T.collapse(F.col("value"))).where("text <> ''").groupBy("target", "agent", "field").agg(F.array_sort(F.collect_set("text")).alias("values"), F.array_sort(F.collect_set("location")).alias("places"))
    both = _sides(sets(before), sets(after), ["target", "agent", "field"]).join(both_have, ["target", "agent"], "left_semi")
    none = F.array().cast("array<string>")
    va, vb = F.coalesce("values_a", none), F.coalesce("values_b", none)
    pa_, pb = F.coalesce("places_a", none), F.coalesce("places_b", none)
    return _change(both.where(va != vb), "changed", "metadata-value-changed", F.col("field"), T.first_values(va), T.first_values(vb)).unionByName(
        _change(both.where(pa_ != pb), "changed", "metadata-location-changed", F.col("field"), T.first_values(pa_), T.first_values(pb))
    )


def timing_changes(
    before: DataFrame, after: DataFrame, min_ms: float = MIN_MS, min_percent: float = MIN_PERCENT, other_policy: DataFrame | None = None
) -> DataFrame:
    """Medians of (target, agent, metric, ms) rows that moved by more than both floors.

    The required signals' arrival is not compared on targets (`other_policy`) that require others than before.
    """
    if not (0 <= min_ms < float("inf") and 0 <= min_percent < float("inf")):
        raise ValueError("timing floors must be finite and not negative")
    keys = ["target", "agent", "metric"]
    both = _sides(medians(before, keys, "ms", "ms"), medians(after, keys, "ms", "ms"), keys).where("in_a AND in_b")
    if other_policy is not None:
        skipped = other_policy.select("target", F.lit("required_ms").alias("metric")).distinct()
        both = both.join(skipped, ["target", "metric"], "left_anti")
    delta = F.col("ms_b") - F.col("ms_a")
    percent = F.when(F.col("ms_a") == 0, F.lit(float("inf"))).otherwise(F.abs(delta) / F.col("ms_a") * 100)
    moved = both.where((F.abs(delta) > min_ms) & (percent > min_percent))
    shown = lambda c: T.json_number(T.rounded(F.col(c)))
    slower = F.when(delta > 0, "regression").otherwise("fixed")
    code = F.when(delta > 0, "timing-regression").otherwise("timing-improvement")
    return _change(moved, slower, code, F.col("metric"), shown("ms_a"), shown("ms_b"), T.json_number(T.rounded(delta)))


def policy_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    shape = lambda df: target_key(df).select("target", *[F.to_json(F.struct(F.col(c).alias("v"))).alias(c) for c in POLICY])
    both = _sides(shape(before), shape(after), ["target"]).where("in_a AND in_b")
    fields = F.filter(F.array(*[F.when(F.col(f"{c}_a") != F.col(f"{c}_b"), F.struct(F.lit(c).alias("f"), F.col(f"{c}_a").alias("a"), F.col(f"{c}_b").alias("b"))) for c in POLICY]), lambda x: x.isNotNull())
    each = both.select("target", F.explode(fields).alias("x"))
    return _change(each, "changed", "target-policy-changed", F.col("x.f"), F.col("x.a"), F.col("x.b"))


def membership_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Targets and agents that only one run has, from probes (target, agent)."""
    agents = _sides(before.select("target", "agent").distinct(), after.select("target", "agent").distinct(), ["target", "agent"])
    targets = _sides(before.select("target").distinct(), after.select("target").distinct(), ["target"])
    whole = targets.where("in_a AND in_b").select("target")
    agents = agents.join(whole, "target", "left_semi")
    return (
        _change(agents.where("NOT in_a"), "changed", "agent-added").unionByName(_change(agents.where("NOT in_b"), "changed", "agent-removed"))
        .unionByName(_change(targets.where("NOT in_a"), "changed", "target-added")).unionByName(_change(targets.where("NOT in_b"), "changed", "target-removed"))
    )


def timelines(arrivals: DataFrame) -> DataFrame:
    """Median time and byte and the shared location of (target, agent, milestone_ord, milestone, at_ms, byte, location) rows."""
    keys = ["target", "agent", "milestone_ord", "milestone"]
    place = F.when(F.min("location") != F.max("location"), "mixed").otherwise(F.min("location"))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("name"), F.col(m).cast("double").alias("value")) for m in ("at_ms", "byte")]))
    middle = medians(arrivals.select(*keys, each.alias("m")).select(*keys, "m.name", "m.value"), [*keys, "name"], "value", "value")
    of = lambda m: F.max(F.when(F.col("name") == m, F.col("value"))).alias(m)
    wide = middle.groupBy(*keys).agg(of("at_ms"), of("byte"))
    return arrivals.groupBy(*keys).agg(place.alias("location")).join(wide, keys, "left").select(*keys, "at_ms", "byte", "location")


def stored_facts(run: dict[str, DataFrame]) -> DataFrame:
    """The facts of a stored run's probes, from its tables."""
    item = F.struct("ord", "kind", "property", "audience", "value", "location", "at_ms", "observed_by_byte")
    block = F.struct("ord", "valid", "limit", "error")
    documents = run["signals"].groupBy("probe_id").agg(F.array_sort(F.collect_list(item)).alias("signals"))
    documents = documents.join(run["json_ld"].groupBy("probe_id").agg(F.array_sort(F.collect_list(block)).alias("json_ld")), "probe_id", "full_outer")
    agents = run["probes"].select("agent_ord", "agent").distinct().withColumns({"label": F.col("agent"), "user_agent": F.col("agent"), "requires_head": F.lit(False)})
    return probe_facts(run["probes"].drop("required_ms"), documents, run["targets"], agents)


def timeline_pairs(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """The milestones of two stored runs side by side, per target and agent."""
    of = lambda run: timelines(keyed(milestones(stored_facts(run)), run["targets"]))
    return _sides(of(before), of(after), ["target", "agent", "milestone_ord", "milestone"])


def compare_runs(before: dict[str, DataFrame], after: dict[str, DataFrame], min_ms: float = MIN_MS, min_percent: float = MIN_PERCENT) -> DataFrame:
    """All changes between two runs (tables targets, probes, signals, findings); targets named twice are an error."""
    for side in (before, after):
        if not repeated_targets(side["targets"]).isEmpty():
            raise ValueError("a target is named twice in one run")
    urls = lambda r: target_key(r["targets"]).select("target", F.col("url").alias("target_url"))
    probes = lambda r: keyed(r["probes"], r["targets"]).join(urls(r), "target")
    pa, pb = probes(before), probes(after)
    complete = lambda p: p.where("completion = 'complete'").select("probe_id", "target", "agent")
    meta = lambda r, p: r["signals"].join(complete(p), "probe_id").select("target", "agent", F.coalesce("property", "kind").alias("field"), "value", "location")
    timed = lambda r: keyed(timings(r["probes"]), r["targets"])
    matched = pa.select("target").distinct().join(pb.select("target").distinct(), "target")
    policies = policy_changes(before["targets"], after["targets"])
    parts = (
        finding_changes(keyed(before["findings"], before["targets"]), keyed(after["findings"], after["targets"]), matched=matched),
        response_changes(pa, pb),
        metadata_changes(meta(before, pa), meta(after, pb), (complete(pa), complete(pb))),
        timing_changes(timed(before), timed(after), min_ms, min_percent, policies.where(F.col("field").isin(*REQUIREMENTS))),
        policies,
        membership_changes(pa, pb),
    )
    return reduce(DataFrame.unionByName, parts)


def change_order() -> list[Column]:
    """By target, then kind (regressions, fixes, changes), then agent, field and code in dictionary order."""
    kind = F.when(F.col("kind") == "regression", 0).when(F.col("kind") == "fixed", 1).otherwise(2)
    word = lambda c: F.collate(F.coalesce(c, F.lit("")), "UNICODE")
    return [F.col("target"), kind, word("agent"), word("field"), word("code")]


def comparison_summary(changes: DataFrame) -> DataFrame:
    return changes.agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("regression", "regressions"), ("fixed", "fixed"), ("changed", "changed"))])


def expect_no_regressions(changes: DataFrame) -> None:
    """Raises with the first five regressions, if there are any."""
    bad = changes.where("kind = 'regression'").orderBy(*change_order()).limit(6).collect()
    if bad:
        lines = [f"{r.code} {r.target} {r.agent or ''} {r.field or ''}: {r.before} -> {r.after}" for r in bad[:5]]
        raise AssertionError("regressions:\n" + "\n".join(lines))
