"""Captured response chunks to probe facts: byte cap, stream shape, digest, decoding, header projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Response headers that are kept.
HEADERS = (
    "age", "cache-control", "cf-cache-status", "content-encoding", "content-language", "content-length", "content-type",
    "date", "etag", "expires", "last-modified", "server", "vary", "x-cache", "x-cache-hits", "x-nextjs-cache",
    "x-powered-by", "x-robots-tag", "x-vercel-cache",
)
# Statuses that redirect.
REDIRECTS = (301, 302, 303, 307, 308)


def stream_shape(chunks: DataFrame, key: str = "probe_id") -> DataFrame:
    """chunks, spanned_ms, max_gap_ms, idle_ms per key of (key, seq, at_ms)."""
    gap = F.col("at_ms") - F.lag("at_ms").over(Window.partitionBy(key).orderBy("seq"))
    return (
        chunks.withColumn("gap", gap)
        .groupBy(key)
        .agg(
            F.count("*").alias("chunks"),
            (F.max("at_ms") - F.min("at_ms")).alias("spanned_ms"),
            F.coalesce(F.max("gap"), F.lit(0.0)).alias("max_gap_ms"),
            F.coalesce(F.sum("gap"), F.lit(0.0)).alias("idle_ms"),
        )
    )


def byte_capped(chunks: DataFrame, limit: int) -> DataFrame:
    """(probe_id, seq, at_ms, bytes) up to `limit` bytes a probe: the crossing chunk is cut, later ones go; over tells it."""
    before = Window.partitionBy("probe_id").orderBy("seq")
    total = F.sum(F.octet_length("bytes")).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    start = F.col("_total") - F.octet_length("bytes")
    every = Window.partitionBy("probe_id")
    return (
        chunks.withColumn("_total", total)
        .withColumn("over", F.max("_total").over(every) > limit)
        .where(start < limit)
        .withColumn("bytes", F.expr(f"substring(bytes, 1, cast({limit} - (_total - octet_length(bytes)) AS int))"))
        .drop("_total")
    )


def bodies(chunks: DataFrame) -> DataFrame:
    """One row a probe: body, chunk_ends, chunk_at, bytes_read, body_sha256 (null when the body was cut)."""
    so_far = Window.partitionBy("probe_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = chunks.where("octet_length(bytes) > 0").withColumn("end", F.sum(F.octet_length("bytes")).over(so_far).cast("bigint"))
    at = F.greatest(F.coalesce(F.nanvl(F.col("at_ms"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    whole = ended.groupBy("probe_id").agg(
        F.expr("listagg(bytes) WITHIN GROUP (ORDER BY seq)").alias("body"), F.array_sort(F.collect_list(F.struct("seq", "end", at.alias("at")))).alias("c"), F.max("over").alias("over"), F.max("end").alias("bytes_read")
    )
    pick = lambda n: F.transform("c", lambda x: x[n]).alias(f"chunk_{n}s" if n == "end" else f"chunk_{n}")
    return whole.select("probe_id", "body", pick("end"), pick("at"), "over", "bytes_read", F.when(~F.col("over"), F.sha2("body", 256)).alias("body_sha256"))


def charset_parameter(content_type: Column) -> Column:
    """The charset of a media type; other parameters, quoted ones too, are passed over."""
    other = r"""(?:;\s*+(?!charset\s*+=)(?:[^;"]|"(?:[^"\\]|\\.)*+")*+)*+"""
    found = lambda k: F.regexp_extract(content_type, rf"""(?i)^[^;"]*+{other};\s*+charset\s*+=\s*+(?:"([^"\\]*+)"|'?([^;\s"']++))""", k)
    return F.nullif(F.lower(F.concat(found(1), found(2))), F.lit(""))


def is_html(content_type: Column) -> Column:
    return F.trim(F.split_part(F.lower(content_type), F.lit(";"), F.lit(1))).isin("text/html", "application/xhtml+xml")


def planned_probes(targets: DataFrame, agents: DataFrame, repeat: int) -> DataFrame:
    """Every target for every agent and sample, in stable order columns."""
    # agents are a short list that people write; Spark broadcasts it while it is small
    pairs = targets.select("target_ord", F.col("url").alias("requested_url")).crossJoin(agents.select("agent_ord", "agent", "user_agent"))
    sample = F.explode(F.sequence(F.lit(1), F.lit(repeat)))
    return pairs.select("*", sample.alias("sample")).withColumn("probe_id", F.concat_ws("/", "target_ord", "agent_ord", "sample"))
