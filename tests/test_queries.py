"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from pagelens.plans import catalog, parts  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    tidy = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 6) if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    return sorted(repr([tidy(v) for v in r]) for r in frame.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, name):
    known = duckdb.connect()
    for f in os.listdir(FOLDER):
        known.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
    assert rows(entry.queries()[name](spark, FOLDER).toPandas()) == rows(known.sql(catalog.SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).columns == ["host", "pages", "titles", "headings", "without_description"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_table_queries_read_every_row(spark):
    run = lambda name: entry.queries()[name](spark, FOLDER)
    table = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
    assert sum(r.occurrences_raw for r in run("coalesced_findings").collect()) == table("events").count()
    listed, merged = {r.url for r in table("pages").collect()}, {r.url: r.source_ord for r in run("merged_targets").collect()}
    assert {u for u, k in merged.items() if k == 0} == listed and any(k == 1 for k in merged.values())
    kinds = lambda name, c: {r[c] for r in run(name).collect()}
    assert kinds("finding_changes", "kind") == {"regression", "fixed", "changed"}
    assert kinds("metadata_changes", "code") == {"metadata-value-changed", "metadata-location-changed"}
    assert kinds("membership_changes", "code") == {"agent-added", "agent-removed", "target-added", "target-removed"}
