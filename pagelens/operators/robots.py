"""robots.txt as tables: parsed groups and rules, and verdicts for agents and URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.urls import origin, path_and_query, robots_form, robots_rule


def parse_robots(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(agents, rules, sitemaps) of docs (origin, body); agents carry the last crawl delay of their group in delay_ms.

    Consecutive user-agent lines share a group; an allow or disallow line, even an empty one, ends the collection of
    agents; sitemap, crawl-delay and unknown lines do not. Rules before any agent are dropped.
    """
    lines = docs.select("origin", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("n", "raw"))
    bare = F.trim(F.regexp_replace(F.regexp_replace("raw", r"#.*$", ""), r"^\uFEFF", ""))
    lines = lines.withColumn("line", bare).where(F.contains("line", F.lit(":")))
    lines = lines.select("origin", "n", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"), F.trim(F.regexp_replace("line", r"^[^:]*:", "")).alias("value"))
    within = Window.partitionBy("origin").orderBy("n")
    so_far = within.rowsBetween(Window.unboundedPreceding, -1)
    marked = F.when(F.col("field") == "user-agent", "agent").when(F.col("field").isin("allow", "disallow"), "rule")
    last = F.last(marked, ignorenulls=True).over(so_far)
    starts = ((F.col("field") == "user-agent") & (F.coalesce(last, F.lit("rule")) == "rule")).cast("int")
    grouped = lines.withColumn("group_ord", F.sum(starts).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    delays = grouped.where("field = 'crawl-delay' AND value RLIKE '^[0-9]+([.][0-9]+)?$'").groupBy("origin", "group_ord").agg(F.max_by(F.round(F.col("value").cast("double") * 1000), "n").alias("delay_ms"))
    agents = grouped.where("field = 'user-agent' AND value <> ''").select("origin", "group_ord", F.lower("value").alias("token")).join(delays, ["origin", "group_ord"], "left")
    rules = grouped.where("group_ord > 0 AND field IN ('allow', 'disallow') AND value <> ''").select(
        "origin", "group_ord", F.col("n").alias("rule_ord"), (F.col("field") == "allow").alias("allow"), F.col("value").alias("path")
    )
    sitemaps = grouped.where("field = 'sitemap' AND value <> ''").select("origin", F.col("n").alias("ord"), F.col("value").alias("url"))
    return agents, rules, sitemaps


def selected_groups(checks: DataFrame, agents: DataFrame) -> DataFrame:
    """(origin, agent, group_ord): all groups whose longest token in the agent's name ties for the longest; '*' counts 0."""
    names = checks.select("origin", "agent", F.lower("user_agent").alias("ua")).distinct()
    size = F.when(F.col("token") == "*", 0).when(F.contains("ua", F.col("token")), F.length("token"))
    hits = names.join(agents, "origin").withColumn("size", size).where("size IS NOT NULL")
    place = F.rank().over(Window.partitionBy("origin", "agent").orderBy(F.desc("size")))
    return hits.withColumn("place", place).where("place = 1").select("origin", "agent", "group_ord").distinct()


def rule_matches(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """`paths` (origin, group_ord, form and others) with every rule of their group that matches, by equality of what rules begin with.

    A group's rules begin with texts of a few lengths. A path is cut at each of these lengths and meets only the rules that
    begin with the cut; those with wildcards or an end are then held against the whole path.
    """
    formed = rules.withColumn("r", robots_rule("path")).select("origin", "group_ord", "rule_ord", "allow", F.col("path").alias("rule"), "r.*")
    lengths = formed.groupBy("origin", "group_ord").agg(F.collect_set(F.length("head")).alias("lengths"))
    fitting = F.filter("lengths", lambda n: n <= F.length("form"))
    cut = paths.join(lengths, ["origin", "group_ord"]).withColumn("head", F.explode(F.transform(fitting, lambda n: F.substring(F.col("form"), F.lit(1), n)))).drop("lengths")
    return cut.join(formed, ["origin", "group_ord", "head"]).where(F.col("pattern").isNull() | F.rlike("form", F.col("pattern")))


def robots_verdicts(checks: DataFrame, docs: DataFrame) -> DataFrame:
    """checks (probe_id, url, agent, user_agent) with robots_verdict, robots_matched, robots_url, robots_status, robots_error.

    The most specific matching rule decides, Allow on a tie, then the earlier one. No document: no verdict.
    """
    asked = checks.withColumn("origin", origin(F.col("url"))).withColumn("path", path_and_query(F.col("url")))
    agents, rules, _ = parse_robots(docs.where("state = 'fetched' AND body IS NOT NULL"))
    chosen = selected_groups(asked, agents)
    formed = asked.select("probe_id", "origin", "agent", robots_form("path").alias("form"))
    hits = rule_matches(formed.join(chosen, ["origin", "agent"]), rules)
    best = hits.groupBy("probe_id").agg(
        F.max_by(F.struct("allow", "rule"), F.struct("size", "allow", -F.col("rule_ord"))).alias("best")
    )
    joined = asked.join(docs.select("origin", "state", "status", "error"), "origin", "left").join(best, "probe_id", "left")
    verdict = (
        F.when(F.col("state").isNull(), F.lit(None).cast("string"))
        .when(F.col("state") != "fetched", "unavailable")
        .when(F.col("path") == "/robots.txt", "allowed")
        .when(F.col("best.allow") == F.lit(False), "disallowed")
        .otherwise("allowed")
    )
    return joined.select(
        "probe_id", verdict.alias("robots_verdict"), F.when(verdict == "disallowed", F.col("best.rule")).alias("robots_matched"),
        F.concat("origin", F.lit("/robots.txt")).alias("robots_url"), F.col("status").alias("robots_status"), F.col("error").alias("robots_error"),
    )
