"""Probes, targets and agents derived from the `pages` table by one SQL text that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.operators.inspector import fixed_chunks, inspected, json_ld_of, signals_of
from pagelens.operators.rules import probe_facts

_OWN_TITLE = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
#: (condition, SQL text that is put before the end of the head).
_CASES = (
    ("page_id % 3 = 0", "'<meta name=\"description\" content=\"About\">'"),
    ("page_id % 6 = 0", "'<meta name=\"description\" content=\"Other\">'"),
    ("page_id % 15 = 9", "'<meta name=\"description\" content=\"About\">'"),
    ("page_id % 14 = 5", f"concat('<title>', {_OWN_TITLE}, '</title>')"),
    ("page_id % 14 = 6", "'<title>Other</title>'"),
    ("page_id % 4 = 1", "'<link rel=\"canonical\" href=\"/c\">'"),
    ("page_id % 8 = 1", "'<link rel=\"canonical\" href=\"/c#x\">'"),
    ("page_id % 16 = 9", "'<link rel=\"canonical\" href=\"/d\">'"),
    ("page_id % 7 = 3", "'<meta property=\"og:title\" content=\"T\"><meta property=\"og:image\" content=\"rel.png\">'"),
    ("page_id % 18 = 1", "'<meta property=\"og:type\" content=\"article\"><meta property=\"og:type\" content=\"Article\">'"),
    ("page_id % 18 = 5", "'<meta property=\"og:description\" content=\"a\"><meta property=\"og:description\" content=\"b\">'"),
    ("page_id % 11 = 4", "'<script type=\"application/ld+json\">{\"@type\":\"Article\"}</script>'"),
    ("page_id % 11 = 5", "'<script type=\"application/ld+json\">{bad}</script>'"),
    ("page_id % 35 = 13", "'<meta property=\"og:image\" content=\"https://img.example/one.png\"><meta property=\"og:image\" content=\"https://img.example/two.png\">'"),
    ("page_id % 70 = 23", "'<meta property=\"og:url\" content=\"/p\">'"),
    ("page_id % 51 = 50", "repeat('<script type=\"application/ld+json\">{}</script>', 65)"),
)
#: (condition, audience, content) of elements with crawler directives, in the order in which they are sent.
_ROBOTS = (
    ("page_id % 5 = 2", "robots", "noindex, follow"),
    ("page_id % 10 = 2", "robots", "index"),
    ("page_id % 20 = 7", "robots", "follow; noindex"),
    ("page_id % 20 = 17", "robots", "noarchive"),
    ("page_id % 25 = 8", "robots", "index, NOINDEX"),
    ("page_id % 16 = 6", "robots", "none"),
    ("page_id % 16 = 14", "robots", " "),
    ("page_id % 19 = 3", "bingbot", "nosnippet"),
    ("page_id % 23 = 4", "bingbot", "nosnippet;nosnippet"),
    ("page_id % 46 = 4", "bingbot", "Nosnippet , nosnippet"),
    ("page_id % 29 = 7", "bingbot", "all"),
    ("page_id % 22 = 9", "googlebot", "noindex"),
    ("page_id % 44 = 9", "googlebot", "index"),
)
_CASES += tuple((condition, f"'<meta name=\"{audience}\" content=\"{content}\">'") for condition, audience, content in _ROBOTS)
INJECTED = "concat(" + ", ".join(f"CASE WHEN {c} THEN {t} ELSE '' END" for c, t in _CASES) + ")"
_BODY = "CASE WHEN page_id % 69 = 4 THEN '<meta name=\"description\" content=\"Late\">' ELSE '' END"
HTML = f"replace(replace(html, '</head>', concat({INJECTED}, '</head>')), '</footer>', concat({_BODY}, '</footer>'))"
#: What the second agent is sent instead on some pages.
OTHER_AGENT = "page_id % 5 = 3 AND agent_ord = 1"
ALTERED = "html"
for _old, _new in (("<title>", "<title>Alt "), ("rel.png", "alt.png"), ("two.png", "three.png"), ('content="Article"', 'content="ARTICLE"'), ('content="/p"', 'content="/p#part"')):
    ALTERED = f"replace({ALTERED}, '{_old}', '{_new}')"
STATUS = "CASE WHEN page_id % 9 = 0 THEN 500 WHEN page_id % 21 = 0 AND agent_ord = 1 THEN 404 ELSE 200 END"


def tables(spark: SparkSession, sf_dir: str, chunk: int = 1024, closed: bool = False) -> dict[str, DataFrame]:
    """pages, agents, targets, probes, documents, signals, json_ld and facts, for two agents and one sample a page; `closed` is that of `inspected`."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id", "url", f"{HTML} AS html")
    agents = spark.createDataFrame(
        [(0, "browser", "Browser", "Mozilla/5.0", False), (1, "bingbot", "Bingbot", "Mozilla/5.0 (compatible; bingbot/2.0)", True)],
        "agent_ord int, agent string, label string, user_agent string, requires_head boolean",
    )
    targets = pages.selectExpr(
        "cast(page_id AS int) AS target_ord", "CASE WHEN page_id % 2 = 0 THEN concat('p', page_id) END AS id", "url", "array(200) AS statuses",
        "CASE WHEN page_id % 2 = 0 THEN url END AS expected_final_url", "true AS require_title", "true AS require_description",
        "true AS require_canonical", "true AS require_h1", "true AS require_main_text", "page_id % 2 = 1 AS open_graph",
        "page_id % 3 = 2 AS twitter_card", "CAST(500 AS double) AS max_first_byte_ms", "CAST(CASE WHEN page_id % 10 = 4 THEN 1 END AS double) AS max_critical_ms",
    )
    asked = pages.select("page_id", "url").crossJoin(agents.select("agent_ord", "agent"))  # two agents
    probes = asked.selectExpr(
        "concat(page_id, '/', agent_ord, '/1') AS probe_id", f"concat(page_id, CASE WHEN {OTHER_AGENT} THEN '/other' ELSE '' END) AS document_id", "cast(page_id AS int) AS target_ord", "agent_ord", "agent", "1 AS sample",
        "url AS requested_url", "CASE WHEN page_id % 17 = 0 AND agent_ord = 1 THEN 'https://other.example.net/moved' ELSE url END AS final_url",
        f"{STATUS} AS status", "CASE WHEN page_id % 13 = 0 THEN 'timeout' ELSE 'complete' END AS completion",
        "CAST(NULL AS string) AS error", "page_id * 10 AS bytes_read", "sha2(concat(page_id, agent_ord), 256) AS body_sha256",
        """map_filter(map('x-robots-tag', CASE page_id % 12 WHEN 6 THEN 'noindex' WHEN 7 THEN 'bingbot: nofollow' WHEN 8 THEN 'index' END,
            'content-encoding', CASE WHEN page_id % 3 = 1 THEN 'gzip' END), (k, v) -> v IS NOT NULL) AS headers""",
        "CAST(array() AS array<struct<url:string,status:int,location:string,duration_ms:double>>) AS redirects",
        "CAST(page_id AS double) AS headers_ms", "CAST(page_id * 7 % 1000 AS double) AS first_byte_ms", "CAST(page_id * 9 % 2000 AS double) AS complete_ms",
    )
    # where both agents get the same document it is inspected once
    sent = F.array(F.struct(F.lit("").alias("suffix"), F.col("html").alias("html")), F.expr(f"CASE WHEN page_id % 5 = 3 THEN named_struct('suffix', '/other', 'html', {ALTERED}) END"))
    each = pages.select("page_id", F.explode(sent).alias("d")).where("d IS NOT NULL").select(F.concat("page_id", "d.suffix").alias("probe_id"), "d.html")
    documents = inspected(fixed_chunks(each, chunk), closed)
    facts = probe_facts(probes, documents, targets, agents)
    return {"pages": pages, "agents": agents, "targets": targets, "probes": probes, "documents": documents, "signals": signals_of(documents), "json_ld": json_ld_of(documents), "facts": facts}


#: DuckDB: the pages as they are sent, and agents.
PROBES_SQL = f"""pages_ AS (SELECT *, {HTML} AS sent FROM pages),
probes AS (SELECT page_id::INTEGER AS target_ord, page_id, url, html, sent, a.agent_ord, a.agent FROM pages_, (VALUES (0, 'browser'), (1, 'bingbot')) a(agent_ord, agent)),
tags AS ({" UNION ALL ".join(f"SELECT page_id, {k} AS tag, '{audience}' AS audience, '{content}' AS content FROM pages_ WHERE {condition}" for k, (condition, audience, content) in enumerate(_ROBOTS))}),
told AS (SELECT p.page_id, p.agent, t.audience, t.tag, list_filter(list_transform(string_split_regex(lower(t.content), '[;,]'), lambda x: trim(x)), lambda x: x <> '') AS words
  FROM probes p JOIN tags t ON t.page_id = p.page_id AND t.audience IN ('robots', p.agent)),
said AS (SELECT DISTINCT page_id, agent, audience, unnest(words) AS word FROM told),
meant AS (SELECT page_id, agent, audience, word FROM said WHERE word NOT IN ('none', 'all') UNION SELECT page_id, agent, audience, m FROM said JOIN (VALUES ('none', 'noindex'), ('none', 'nofollow'), ('all', 'index'), ('all', 'follow')) v(w, m) ON w = word),
effective AS (SELECT page_id, agent, string_agg(DISTINCT word, ',' ORDER BY word) AS directives FROM meant m
  WHERE NOT EXISTS (SELECT 1 FROM meant o WHERE o.page_id = m.page_id AND o.agent = m.agent AND o.word = 'no' || m.word) GROUP BY ALL),
repeated AS (SELECT page_id, agent, audience, count(*) AS n, count(DISTINCT list_sort(words)) AS variants FROM told WHERE len(words) > 0 GROUP BY ALL HAVING count(*) > 1),
judged AS (SELECT r.*, EXISTS (SELECT 1 FROM meant a JOIN meant b USING (page_id, agent, audience) WHERE a.page_id = r.page_id AND a.agent = r.agent AND a.audience = r.audience AND b.word = 'no' || a.word) AS opposed FROM repeated r),
robots_found AS (SELECT page_id, agent, audience, CASE WHEN opposed THEN 'conflicting-robots' WHEN variants = 1 THEN 'duplicate-robots' ELSE 'multiple-robots' END AS code FROM judged
  UNION ALL SELECT DISTINCT g.page_id, g.agent, 'effective', 'conflicting-robots' FROM meant g JOIN meant s ON s.page_id = g.page_id AND s.agent = g.agent AND g.audience = 'robots' AND s.audience = g.agent AND g.word = 'no' || s.word
    WHERE NOT EXISTS (SELECT 1 FROM judged j WHERE j.page_id = g.page_id AND j.agent = g.agent AND opposed))"""
_EFFECTIVE = "EXISTS (SELECT 1 FROM effective e WHERE e.page_id = {t}.page_id AND e.agent = {t}.agent AND list_contains(string_split(e.directives, ','), 'noindex'))"


def noindex_sql(table: str) -> str:
    """Whether the page tells the agent not to index it, for a row of `table` (page_id, agent)."""
    return _EFFECTIVE.format(t=table)


_OK = "page_id % 13 <> 0"
_HAS_H1 = "regexp_matches(html, '<h1>[^<]')"
#: The chunk of 1024 bytes that completes the last of the signals that are required: the heading, or a late description.
_LAST_CHUNK = "ceil(strlen(substr(sent, 1, CASE WHEN page_id % 69 = 4 THEN position('\"Late\">' IN sent) + 6 ELSE position('</h1>' IN sent) + 4 END)) / 1024.0)"
#: For each rule of a single probe the condition under which it fires, and its severity.
RULE_CONDITIONS = {
    ("incomplete-probe", "error"): "page_id % 13 = 0",
    ("status-mismatch", "error"): f"{STATUS} <> 200",
    ("final-url-mismatch", "error"): "page_id % 34 = 0 AND agent_ord = 1",
    ("missing-title", "error"): f"{_OK} AND NOT regexp_matches(html, '<title>[^<]') AND page_id % 14 <> 6",
    ("missing-description", "warning"): f"{_OK} AND page_id % 3 <> 0 AND page_id % 69 <> 4",
    ("missing-canonical", "warning"): f"{_OK} AND page_id % 4 <> 1",
    ("missing-h1", "warning"): f"{_OK} AND NOT {_HAS_H1}",
    ("missing-main-text", "warning"): f"{_OK} AND NOT contains(html, '<main')",
    ("duplicate-title", "warning"): "page_id % 14 = 5 AND regexp_matches(html, '<title>[^<]')",
    ("conflicting-title", "warning"): "page_id % 14 = 6 AND regexp_matches(html, '<title>[^<]')",
    ("duplicate-description", "warning"): "page_id % 15 = 9 AND page_id % 6 <> 0",
    ("conflicting-description", "warning"): "page_id % 6 = 0",
    ("duplicate-canonical", "warning"): "page_id % 8 = 1 AND page_id % 16 <> 9",
    ("conflicting-canonical", "warning"): "page_id % 16 = 9",
    ("robots-header-noindex", "error"): "page_id % 12 = 6",
    ("robots-header-restrictive", "warning"): "page_id % 12 = 7 AND agent_ord = 1",
    ("robots-header-ineffective", "info"): f"page_id % 12 = 8 AND {noindex_sql('probes')}",
    ("content-encoding-ignored", "info"): "page_id % 3 = 1",
    ("missing-open-graph-metadata", "warning"): f"{_OK} AND page_id % 2 = 1",
    ("missing-twitter-card-metadata", "warning"): f"{_OK} AND page_id % 3 = 2",
    ("duplicate-social-metadata", "warning"): "page_id % 18 = 1",
    ("conflicting-social-metadata", "warning"): "page_id % 18 = 5",
    ("invalid-social-metadata-url", "warning"): "page_id % 7 = 3 AND (page_id % 2 = 1 OR page_id % 3 = 2) OR page_id % 70 = 23",
    ("invalid-json-ld", "warning"): f"{_OK} AND page_id % 11 = 5",
    ("json-ld-analysis-limit", "warning"): "page_id % 51 = 50",
    ("head-metadata-in-body", "error"): "page_id % 69 = 4 AND agent_ord = 1",
    ("slow-first-byte", "warning"): "page_id * 7 % 1000 > 500",
    ("slow-critical-signals", "warning"): f"page_id % 10 = 4 AND page_id % 3 <> 2 AND {_HAS_H1} AND {_LAST_CHUNK} > 1",
}
FINDINGS_SQL = PROBES_SQL + ",\nfindings AS (" + "\nUNION ALL ".join(
    f"SELECT target_ord, url, agent, '{code}' AS code, '{severity}' AS severity FROM probes WHERE {condition}" for (code, severity), condition in RULE_CONDITIONS.items()
) + "\nUNION ALL SELECT p.target_ord, p.url, p.agent, r.code, 'warning' FROM robots_found r JOIN probes p USING (page_id, agent))"
