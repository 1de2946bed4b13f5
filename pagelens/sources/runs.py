"""Audit runs as Parquet tables in one folder, and strict reading of their manifest."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from pagelens import schemas

TABLES = {"targets": schemas.TARGETS, "probes": schemas.PROBES + ", required_ms double", "signals": schemas.SIGNALS, "json_ld": schemas.JSON_LD, "findings": schemas.FINDINGS}
VERSION = 2
_MANIFEST = {"schemaVersion", "generatedAt", "durationMs", "summary"}
_REPORT = _MANIFEST | set(TABLES) | {"waived"}
# How a probe may end.
COMPLETIONS = ("complete", "timeout", "max-bytes-exceeded", "redirect-limit", "invalid-response", "network-error")


class RunError(ValueError):
    """A run that can't be read or must not be written."""


def write_run(tables: dict[str, DataFrame], summary: DataFrame, path: str, generated_at: str, duration_ms: float = 0.0, baseline: bool = False) -> None:
    """Tables and a manifest; a baseline is refused while any probe is incomplete."""
    row = summary.first().asDict()
    if baseline and row["incomplete"]:
        raise RunError("an incomplete run can't be a baseline")
    for name in TABLES:
        if name in tables:
            tables[name].write.mode("overwrite").parquet(f"{path}/{name}")
    manifest = {"schemaVersion": VERSION, "generatedAt": generated_at, "durationMs": duration_ms, "summary": row}
    spark = summary.sparkSession
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def _refuse_version(version: object) -> None:
    if isinstance(version, bool) or not isinstance(version, int) or version > VERSION:
        raise RunError(f"schema version {version!r} is not known here")
    if version < 1:
        raise RunError(f"schema version {version} is none")


def upgraded(manifest: dict) -> dict:
    """A manifest of the present version: the first one knew no waivers."""
    if manifest["schemaVersion"] == 1:
        if "waived" in manifest or "waived" in (manifest.get("summary") or {}):
            raise RunError("a run of version 1 has no waivers")
        manifest = manifest | {"schemaVersion": VERSION, "summary": {"waived": 0} | (manifest.get("summary") or {})}
    return manifest


def unknown_keys(text: Column, kind: DataType) -> Column:
    """Whether a JSON text has a key, at any depth, that its type does not know; maps may have any.

    The check follows the type down: each nested object is taken out as a text and held against its own part of it.
    """
    if isinstance(kind, ArrayType):
        if not isinstance(kind.elementType, (ArrayType, StructType)):
            return F.lit(False)
        return F.coalesce(F.exists(F.from_json(text, "array<string>"), lambda x: unknown_keys(x, kind.elementType)), F.lit(False))
    if not isinstance(kind, StructType):
        return F.lit(False)
    held = F.from_json(text, "map<string,string>")
    known = F.array(*[F.lit(f.name) for f in kind.fields])
    bad = F.size(F.array_except(F.map_keys(held), known)) > 0
    for f in kind.fields:
        if isinstance(f.dataType, (ArrayType, StructType)):
            bad = bad | unknown_keys(held[f.name], f.dataType)
    return F.coalesce(bad, F.lit(False))


def read_manifest(spark: SparkSession, path: str) -> dict:
    lines = [r[0] for r in spark.read.text(f"{path}/manifest").limit(2).collect()]
    if len(lines) != 1:
        raise RunError("a run has one manifest")
    manifest = json.loads(lines[0])
    _refuse_version(manifest.get("schemaVersion"))
    if manifest.keys() - _MANIFEST:
        raise RunError("the manifest has unknown entries")
    return upgraded(manifest)


def _refuse_values(found: dict[str, DataFrame]) -> None:
    bad = found["probes"].where((F.col("status") < 100) | (F.col("status") > 599) | (F.col("bytes_read") < 0) | (F.col("sample") < 1) | ~F.col("completion").isin(*COMPLETIONS))
    if not bad.isEmpty() or not found["findings"].where(~F.col("severity").isin("error", "warning", "info")).isEmpty():
        raise RunError("the run holds values out of range")


def read_report(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a JSON report: one document, refused where its version is newer or anything in it is unknown."""
    text = spark.read.text(path, wholetext=True)
    top = "map<string,string>"
    head = text.select(F.from_json("value", top).alias("m")).first()
    if head is None or head.m is None:
        raise RunError(f"{path} is no JSON report")
    version = json.loads(head.m.get("schemaVersion") or "null")
    _refuse_version(version)
    if unknown := set(head.m) - _REPORT:
        raise RunError(f"the report has unknown entries {sorted(unknown)}")
    upgraded({k: json.loads(v) for k, v in head.m.items() if k in ("schemaVersion", "summary") and v is not None} | ({"waived": True} if "waived" in head.m else {}))
    found = {}
    for name, schema in TABLES.items():
        if name not in head.m:
            raise RunError(f"the report has no {name}")
        part = text.select(F.from_json("value", f"struct<{name}:array<string>>").getField(name).alias("rows"))
        rows = part.select(F.explode("rows").alias("row"))
        # a row's keys are looked at before it is read
        known = spark.createDataFrame([], schema)
        if not rows.where(unknown_keys(F.col("row"), known.schema)).isEmpty():
            raise RunError(f"{name} has unknown entries")
        read = F.from_json("row", known.schema.simpleString(), {"mode": "FAILFAST"})
        found[name] = rows.select(read.alias("r")).select("r.*").persist()
    try:
        _refuse_values(found)
    except Exception as error:
        if isinstance(error, RunError):
            raise
        raise RunError(f"{path} does not hold what a report holds") from error
    return found


def read_run(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a run, a folder of Parquet tables or a JSON report; unknown columns and values out of range are refused."""
    if path.endswith(".json"):
        return read_report(spark, path)
    read_manifest(spark, path)
    found = {}
    for name, schema in TABLES.items():
        df = spark.read.parquet(f"{path}/{name}")
        known = spark.createDataFrame([], schema).columns
        if set(df.columns) - set(known):
            raise RunError(f"{name} has unknown columns {sorted(set(df.columns) - set(known))}")
        # runs written before the required signals' arrival was kept lack it
        found[name] = df.withColumn("required_ms", F.lit(None).cast("double")) if name == "probes" and "required_ms" not in df.columns else df
    _refuse_values(found)
    return found
