"""The whole audit over captured probes and documents: signals, findings, waivers, summary, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.operators import findings as fin
from pagelens.operators import redaction, rules, stability, waivers
from pagelens.operators.ingest import charset_parameter
from pagelens.operators.inspector import inspected, json_ld_of, signals_of
from pagelens.operators.robots import robots_verdicts


def audit(
    probes: DataFrame, documents: DataFrame, targets: DataFrame, agents: DataFrame, *, robots_docs: DataFrame | None = None,
    waiver_rows: DataFrame | None = None, repeat: int = 1, now: str, secrets: tuple[str, ...] = (),
) -> dict[str, DataFrame]:
    """findings, waived, summary, signals, json_ld, stability, probes, targets, facts.

    `documents` has probe_id, body, chunk_ends, chunk_at. Redaction comes last, after everything was analysed. What
    several results read is kept: release() it once they are written.
    """
    charset = probes.select("probe_id", charset_parameter(F.col("headers")["content-type"]).alias("charset"))
    # read for the facts, the signals and the structured data
    pages = inspected(documents.join(charset, "probe_id")).persist()
    signals, json_ld = signals_of(pages), json_ld_of(pages)
    facts = rules.probe_facts(probes, pages, targets, agents)
    if robots_docs is not None:
        checks = probes.join(agents.select("agent_ord", "user_agent"), "agent_ord").selectExpr("probe_id", "requested_url AS url", "agent", "user_agent")
        facts = facts.join(robots_verdicts(checks, robots_docs), "probe_id", "left")
    facts = facts.persist()
    found = rules.probe_findings(facts).unionByName(rules.drift_findings(facts))
    stable = stability.stability(facts)
    required = F.when(F.col("completion") == "complete", stability.all_arrived()).alias("required_ms")
    timed = rules.prepared(facts).select(*probes.columns, required)
    if repeat > 1:
        found = fin.coalesce_findings(found, repeat).unionByName(stability.stability_findings(stable))
    waived, notes = None, None
    if waiver_rows is not None and not waiver_rows.isEmpty():
        found, waived, notes = waivers.apply_waivers(found, waiver_rows, targets, now)
        found = found.unionByName(notes)
    found = found.persist()
    out = {"findings": found, "summary": fin.summary(targets, probes, found, waived), "signals": signals, "json_ld": json_ld, "stability": stable, "probes": timed, "targets": targets, "facts": facts}
    if waived is not None:
        out["waived"] = waived
    if secrets:
        masks = {"findings": ["message", "url", "evidence"], "signals": ["value"], "probes": ["final_url", "requested_url", "error", "headers", "redirects"], "targets": ["url"], "facts": ["final_url", "requested_url", "error", "headers", "redirects", "signals", "url"]}
        out |= {name: redaction.redact_table(out[name], list(secrets), columns) for name, columns in masks.items()}
    out["kept"] = (pages, facts, found)
    return out


def release(out: dict) -> None:
    """Give back what audit() kept for its results."""
    for frame in out.pop("kept", ()):
        frame.unpersist()
