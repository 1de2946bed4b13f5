"""Registered queries against their SQL on pages that the smallest tables do not have."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.test_queries import rows

PAGE = "<!doctype html><html><head><title>{0}</title></head><body><h1>{0}</h1><footer>f</footer></body></html>"


def compared(spark, folder, name, titles):
    """The rows of a query and of its SQL over pages of given numbers and titles."""
    pages = [(k, f"https://a.example/en/{k}", PAGE.format(title)) for k, title in titles.items()]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    known = duckdb.connect()
    known.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    return rows(entry.queries()[name](spark, str(folder)).toPandas()), rows(known.sql(entry.oracle_sql()[name]).df())


#: Titles that were cut inside an entity, and one that was not.
CUT = {1: "a&amp;&amp;b", 2: "and&amp;&amp", 4: "a&amp b", 5: "x &lt; &l", 6: "x&ampy &#39;&#3", 8: "&amp;amp &amp;lt;"}


def test_entities_cut_short(spark, tmp_path):
    got, known = compared(spark, tmp_path, "inspector_signals", CUT)
    assert got == known and len(got) == 2 * len(CUT)


def test_previews_of_entities_cut_short(spark, tmp_path):
    got, known = compared(spark, tmp_path, "link_previews", CUT)
    assert got == known and len(got) == len(CUT)


def test_code_waived_for_two_audiences(spark, tmp_path):
    # page 877 tells both the general and the agent's own audience twice
    got, known = compared(spark, tmp_path, "waived_findings", {k: "t" for k in (4, 9, 876, 877, 878)})
    assert got == known and any("multiple-robots" in r and "waived" in r for r in got)


def test_each_page_is_inspected_once(spark, tmp_path):
    """Stability keeps what one pass over the pages gave; cases of a report read the findings once, in small batches."""
    from pagelens.operators import rules, stability
    from pagelens.plans.derived import tables
    from pagelens.sinks import reports
    from pagelens.storage import BATCH_BYTES

    pages = [(k, f"https://a.example/en/{k}", PAGE.format(k)) for k in range(30)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    passes = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    found = {n: entry.queries()[n](spark, str(tmp_path)) for n in ("stability_signatures", "stability_rules", "stability_variants")}
    assert {n: passes(df) for n, df in found.items()} == dict.fromkeys(found, 0)
    t = tables(spark, str(tmp_path))
    assert passes(stability.stability_findings(stability.sampled(t["facts"]).withColumns({v: F.lit(1) for v in (*stability.VARIANTS, "samples", "completeSamples")}))) == 1
    assert passes(reports.junit_cases(t["probes"], rules.probe_findings(t["facts"]))) == 1
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(BATCH_BYTES)


def test_junit_cases_of_targets_and_agents(spark):
    from pagelens.schemas import EVIDENCE
    from pagelens.sinks import reports

    probes = spark.createDataFrame([(0, 0, "x", 1, 1.0, 1.0), (1, 0, "x", 1, 1.0, 1.0)], "target_ord int, agent_ord int, agent string, sample int, complete_ms double, first_byte_ms double")
    rows = [(0, 1, 1, 0, "a", "error", "m", "x"), (0, 1, 2, 0, "b", "warning", "m", None), (0, 2, 3, 0, "c", "error", "m", "x"), (7, 1, 4, 0, "d", "error", "m", None), (0, 1, 5, 0, "e", "error", "m", "y")]
    found = spark.createDataFrame(rows, "target_ord int, sample int, rule_ord int, within int, code string, severity string, message string, agent string")
    found = found.withColumn("evidence", F.expr(f"CAST(array() AS {EVIDENCE})"))
    got = sorted((r.target_ord, r.agent_ord, r.sample, r.grave) for r in reports.junit_cases(probes, found).collect())
    # the finding of a sample or an agent that was not asked has no case; a target's own one has, asked or not
    assert got == [(0, 0, 1, 0), (0, 1 << 20, 0, 1), (1, 0, 1, None), (7, 1 << 20, 0, 0)]
