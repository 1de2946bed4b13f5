"""Scalar functions and table operators on literal rows."""

import pytest
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.functions import urls
from pagelens.operators import compare, framework, redaction, robots, sitemap, stability, waivers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text(spark):
    assert one(spark, T.collapse(F.lit("  a \tb ﻿"))) == "a b"
    assert one(spark, T.robots_value(F.lit("NoIndex; follow,,"))) == "follow,noindex"
    assert one(spark, T.effective_directives(F.array(F.lit("none"), F.lit("index")))) == ["noindex", "nofollow"]
    assert one(spark, T.has_opposites(F.array(F.lit("all"), F.lit("noindex"))))
    items = one(spark, T.robots_header(F.lit("noindex, googlebot: nofollow, max-snippet: 3, x")))
    assert [(i.scope, i.directive) for i in items] == [(None, "noindex"), ("googlebot", "nofollow"), ("googlebot", "max-snippet"), ("googlebot", "x")]
    assert one(spark, T.rounded(F.lit(1.005))) == 1.0
    assert one(spark, T.first_values(F.array(*map(F.lit, "abcde")))) == "a, b, c, +2 more"
    assert one(spark, T.real_date(F.lit("2026-02-31"))) is False
    assert one(spark, T.json_number(F.lit(250.0))) == "250"
    assert one(spark, T.title_of(F.lit("missing-main-text"))) == "Missing main text"
    assert T.glob_pattern("/a*") == "^/a.*$" and T.glob_pattern("blog") == "blog"


@pytest.mark.parametrize(
    ("base", "ref", "want"),
    [
        ("http://A.com/x/y", "/c/../d#x", "http://a.com/d"), ("http://a.com", "?q=é", "http://a.com/?q=%C3%A9"), ("https://a.com:443/", "../z", "https://a.com/z"),
        (None, "notaurl", None), ("http://a.com/b/", "c", "http://a.com/b/c"),
    ],
)
def test_urls(base, ref, want):
    assert urls.absolute(base, ref) == want


def test_url_columns(spark):
    frame = spark.createDataFrame([("http://a.com/x?y#z", "http://a.com/"), ("http://b.com/x#z", "http://a.com/"), (None, "http://a.com/")], "u string, o string")
    assert [r[0] for r in frame.select(urls.url_for_origin("u", "o")).collect()] == ["/x?y", "http://b.com/x#z", None]
    assert [r[0] for r in frame.select(urls.is_http_url("u")).collect()] == [True, True, False]


def test_robots(spark):
    body = "User-agent: a\nUser-agent: bot\nCrawl-delay: 2\nDisallow: /x\nAllow: /x\nDisallow:\n\nUser-agent: *\nDisallow: /y*z$ # end\nSitemap: http://s/m.xml"
    docs = spark.createDataFrame([("http://h.com", "fetched", 200, None, body), ("http://u.com", "unavailable", 503, "x", None)], "origin string, state string, status int, error string, body string")
    asks = [("1", "http://h.com/x", "Mybot"), ("2", "http://h.com/yqz", "Mybot"), ("3", "http://h.com/yqz", "other"), ("4", "http://h.com/yqzq", "other"), ("5", "http://u.com/", "other"), ("6", "http://n.com/", "other"), ("7", "http://h.com/robots.txt", "other")]
    checks = spark.createDataFrame([(i, u, a, a) for i, u, a in asks], "probe_id string, url string, agent string, user_agent string")
    got = {r.probe_id: r.robots_verdict for r in robots.robots_verdicts(checks, docs).collect()}
    assert got == {"1": "allowed", "2": "allowed", "3": "disallowed", "4": "allowed", "5": "unavailable", "6": None, "7": "allowed"}
    assert robots.parse_robots(docs)[2].first().url == "http://s/m.xml"
    assert {r.token: r.delay_ms for r in robots.parse_robots(docs)[0].collect()} == {"a": 2000.0, "bot": 2000.0, "*": None}


def test_robots_rules_in_form(spark):
    """Wildcards, ends, escapes and tied groups, as the most specific rule in bytes decides."""
    body = "User-agent: one\nDisallow: /é\nDisallow: /a%2fb\nDisallow: /q?x=*&y\nDisallow: /d$\nDisallow: /s**\nAllow: /s/ok\nDisallow: /m.(x)\n\nUser-agent: one\nDisallow: /second\n\nUser-agent: on\nDisallow: /\n"
    docs = spark.createDataFrame([("http://h.com", "fetched", 200, None, body)], "origin string, state string, status int, error string, body string")
    paths = {"/%C3%A9x": "disallowed", "/a%2Fb": "disallowed", "/a/b": "allowed", "/q?x=1&y": "disallowed", "/d": "disallowed", "/dd": "allowed", "/s1": "disallowed", "/s/ok1": "allowed", "/second": "disallowed", "/m.(x)": "disallowed", "/mA(x)": "allowed", "/x": "allowed"}
    checks = spark.createDataFrame([(p, "http://h.com" + p, "a", "oneBot/1") for p in paths], "probe_id string, url string, agent string, user_agent string")
    assert {r.probe_id: r.robots_verdict for r in robots.robots_verdicts(checks, docs).collect()} == paths


def test_sitemap(spark):
    index = "<sitemapindex><sitemap><loc> http://a.com/1.xml </loc></sitemap><sitemap><loc>http://b.com/2.xml</loc></sitemap></sitemapindex>"
    page = "<urlset><url><loc><![CDATA[http://a.com/p?a&b]]></loc></url><url><loc>http://a.com/q&amp;r</loc></url><url><x:loc>no</x:loc></url></urlset>"
    docs = spark.createDataFrame([("http://a.com/s.xml", index), ("http://a.com/1.xml", page), ("http://b.com/2.xml", page)], "source string, xml string")
    found = sitemap.discover(docs, "http://a.com/s.xml")
    assert found.urls == ["http://a.com/p?a&b", "http://a.com/q&r"] and found.sitemaps == ["http://a.com/s.xml", "http://a.com/1.xml"]
    assert not found.truncated and len(found.errors) == 1 and "http://b.com/2.xml" in found.errors[0]
    ids = {r.url: r.id for r in sitemap.target_ids(spark.createDataFrame([("http://a.com/",), ("http://a.com/Über/x",), ("http://a.com/b",), ("http://c.com/b",)], "url string")).collect()}
    assert ids["http://a.com/"] == "home" and ids["http://a.com/b"].startswith("b-") and ids["http://c.com/b"] == ids["http://a.com/b"] + "-2"


def test_sitemap_budgets(spark):
    locs = lambda kind, urls: f"<{kind}index>" * 0 + "".join(f"<{kind}><loc>{u}</loc></{kind}>" for u in urls)
    index = locs("sitemap", ["http://a.com/s.xml", "http://b.com/x.xml"] * 20 + [f"http://a.com/{k}.xml" for k in range(3)] + ["http://a.com/gone.xml"])
    docs = [("http://a.com/s.xml", index)] + [(f"http://a.com/{k}.xml", locs("url", [f"http://a.com/{w}/{k}" for w in ("en", "de") for _ in range(2)])) for k in range(3)]
    frame = spark.createDataFrame(docs, "source string, xml string")
    # entries that are repeated, foreign or left out cost nothing of the budgets
    found = sitemap.discover(frame, "http://a.com/s.xml", documents=5, urls=3, include=("/en/*",))
    assert found.urls == ["http://a.com/en/0", "http://a.com/en/1", "http://a.com/en/2"] and not found.truncated
    assert any("gone.xml" in e for e in found.errors)
    assert sitemap.discover(frame, "http://a.com/s.xml", urls=4, exclude=("/x*",)).truncated
    assert sitemap.discover(frame, "http://a.com/s.xml", documents=2).sitemaps == ["http://a.com/s.xml", "http://a.com/0.xml"]
    for bad in (lambda: sitemap.discover(frame, "http://a.com/none.xml"), lambda: sitemap.discover(frame, "http://a.com/s.xml", include=("/zz*",)), lambda: sitemap.discover(frame, "x", urls=0)):
        with pytest.raises(sitemap.SitemapError):
            bad()


def test_waivers(spark):
    targets = spark.createDataFrame([(0, None, "http://a"), (1, "b", "http://b")], "target_ord int, id string, url string")
    rows = [(0, 1, 0, 5, 0, "missing-h1", "warning", "m", "http://a", "x"), (1, 1, 0, 5, 0, "missing-h1", "warning", "m", "http://b", "x")]
    from pagelens.schemas import EVIDENCE

    found = spark.createDataFrame(rows, "target_ord int, sample int, probe_ord int, rule_ord int, within int, code string, severity string, message string, url string, agent string")
    found = found.withColumn("evidence", F.array().cast(EVIDENCE))
    w = spark.createDataFrame([(0, "missing-h1", "b", None, "r", "2026-10-06"), (1, "missing-h1", "b", "x", "shadowed", None), (2, "*", None, None, "old", "2026-10-05")], "waiver_ord int, code string, target string, agent string, reason string, until string")
    kept, waived, notes = waivers.apply_waivers(found, w, targets, "2026-10-06")
    assert [r.target_ord for r in kept.collect()] == [0] and [r.waiver_ord for r in waived.collect()] == [0]
    assert sorted((r.code, r.target_ord) for r in notes.collect()) == [("waiver-expired", 0), ("waiver-unused", 1)]


def test_redaction(spark):
    secret = "s3cr&t value"
    frame = spark.createDataFrame([("a s3cr&t value b s3cr%26t%20value", ["s3cr&t value"], {"k": "x s3cr&t value"})], "t string, a array<string>, m map<string,string>")
    r = redaction.redact_table(frame, [secret], ["t", "a", "m"]).first()
    assert r.t == "a [redacted] b [redacted]" and r.a == ["[redacted]"] and r.m == {"k": "x [redacted]"}
    assert "dXNlcjpwdw==" in redaction.variants("Basic dXNlcjpwdw==") and "user:pw" in redaction.variants("Basic dXNlcjpwdw==")


def test_timing_stats(spark):
    frame = spark.createDataFrame([("a", float(v)) for v in range(1, 21)] + [("a", float("nan")), ("a", -1.0), ("b", None)], "k string, v double")
    rows = stability.timing_stats(frame, ["k"], "v").collect()
    assert len(rows) == 1 and tuple(rows[0]) == ("a", 20, 1.0, 10.5, 19.0, 20.0, 19.0)


def test_ties_of_findings_go_by_their_order(spark):
    from pagelens.schemas import EVIDENCE

    rows = [("t", "c", "x", "warning", s, 0, 1, 0, [("k", "string", v)]) for s, v in ((1, "b"), (2, "a"))]
    schema = f"target string, code string, agent string, severity string, sample int, probe_ord int, rule_ord int, within int, evidence {EVIDENCE}"
    before, after = spark.createDataFrame(rows, schema), spark.createDataFrame(rows[::-1], schema)
    assert compare.finding_changes(before, after, ()).count() == 0
    other = spark.createDataFrame([rows[0][:4] + (3,) + rows[0][5:], rows[1]], schema)
    assert [(r.code, r.kind) for r in compare.finding_changes(before, other, ()).collect()] == [("finding-evidence-changed", "changed")]


def test_readiness_and_arrivals(spark):
    from pagelens.operators.inspector import fixed_chunks, inspected
    from pagelens.operators.rules import probe_facts
    from pagelens.operators.timeline import milestones, readiness
    from pagelens.schemas import AGENTS, PROBES, TARGETS
    from pagelens.sinks.reports import arrival_rows, preview_cards

    html = "<html><head><title>T</title><meta property=og:title content=O><meta property=og:type content=a><meta property=og:url content=http://a/></head><body><meta property=og:image content=http://a/i></body></html>"
    targets = spark.createDataFrame([(0, None, "http://a/", [200], None, True, False, False, False, False, True, True, None, None)], TARGETS)
    agents = spark.createDataFrame([(0, "browser", "Browser", "M", False), (1, "x", "X", "M", False)], AGENTS)
    rows = [(f"0/{a}/1", 0, a, name, 1, "http://a/", "http://a/", 200, "complete", None, 9, "s", {}, [], 1.0, 2.0, 9.0) for a, name in ((0, "browser"), (1, "x"))]
    pages = spark.createDataFrame([("0/0/1", html), ("0/1/1", "<title>U</title>")], "probe_id string, html string")
    facts = probe_facts(spark.createDataFrame(rows, PROBES), inspected(fixed_chunks(pages, 50)), targets, agents)
    ready = {r.agent_ord: (r.open_graph, r.twitter_card) for r in readiness(facts).collect()}
    assert ready == {0: ("4 ms/body", "2/4"), 1: ("0/4", "0/4")}
    reached = {(r.agent, r.milestone): (r.at_ms, r.location) for r in milestones(facts).collect()}
    assert reached["browser", "open-graph"] == (4.0, "mixed") and reached["x", "title"] == (1.0, "document") and ("x", "open-graph") not in reached
    assert [(r.label, r.kind, r.n) for r in arrival_rows(facts, 1).collect()] == [("Browser", "title", 2)]
    assert [(r.title, r.image) for r in preview_cards(facts).collect()] == [("O", "http://a/i")]


def test_both_timing_floors_are_needed(spark):
    side = lambda a, b, c: spark.createDataFrame([("t", "x", "m", a), ("t", "y", "m", b), ("t", "z", "m", c)], "target string, agent string, metric string, ms double")
    got = compare.timing_changes(side(100.0, 2000.0, 0.0), side(400.0, 2400.0, 251.0)).collect()
    assert sorted((r.agent, r.code) for r in got) == [("x", "timing-regression"), ("z", "timing-regression")]
    with pytest.raises(ValueError):
        compare.timing_changes(side(1.0, 1.0, 1.0), side(1.0, 1.0, 1.0), min_ms=-1)


def test_framework(spark, tmp_path):
    (tmp_path / "package.json").write_text('{"devDependencies": {"nuxt": "1"}}')
    assert framework.framework_of_project(str(tmp_path)) == "nuxt"
    rows = [(0, 0, 1, {"x-powered-by": "PHP/8"}), (0, 1, 1, {"x-powered-by": "Next.js"})]
    frame = spark.createDataFrame(rows, "target_ord int, agent_ord int, sample int, headers map<string,string>")
    assert framework.framework_of_probes(frame).first().framework == "php"


def many_findings(spark, n):
    from pagelens.schemas import EVIDENCE

    probes = spark.range(n).selectExpr("cast(id AS int) AS target_ord", "0 AS agent_ord", "'x' AS agent", "1 AS sample", "1.0D AS complete_ms", "1.0D AS first_byte_ms")
    targets = probes.selectExpr("target_ord", "concat('http://a/', target_ord) AS url")
    found = probes.selectExpr("target_ord", "sample", "0 AS probe_ord", "1 AS rule_ord", "0 AS within", "'missing-h1' AS code", "'error' AS severity", "'m' AS message", "concat('http://a/', target_ord) AS url", "agent")
    return probes, targets, found.withColumn("evidence", F.array().cast(EVIDENCE))


def test_documents_hold_every_row(spark):
    import json
    from xml.etree import ElementTree

    from pagelens.sinks import reports

    whole, n = (lambda document: "".join(reports.streamed(document))), 5003
    probes, targets, found = many_findings(spark, n)
    summary = {"targets": n, "probes": n, "errors": n, "warnings": 0, "info": 0, "incomplete": 0, "waived": 0}
    junit = ElementTree.fromstring(whole(reports.junit_document(probes, found, targets, summary)))
    assert junit.get("tests") == junit.get("errors") == str(n) and len(junit.findall("testsuite/testcase/error")) == n
    sarif = json.loads(whole(reports.sarif_document(found)))
    assert len(sarif["runs"][0]["results"]) == n and [r["id"] for r in sarif["runs"][0]["tool"]["driver"]["rules"]] == ["missing-h1"]
    report = json.loads(whole(reports.json_document({"findings": found, "targets": targets}, summary, {"schemaVersion": 2})))
    assert len(report["findings"]) == n and [f["target_ord"] for f in report["findings"]] == list(range(n))
    row = spark.createDataFrame([tuple(summary.values())], ", ".join(f"{k} int" for k in summary))
    assert whole(reports.markdown_document(row, found)).count("| missing-h1 |") == n
    assert whole(reports.github_document(found)).count("::error") == n
    assert whole(reports.html_document({"findings": found, "targets": targets}, summary)).count("missing-h1") == n
    changes = probes.selectExpr("'regression' AS kind", "cast(target_ord AS string) AS target", "agent", "'f' AS field", "'code' AS code", "'a' AS before", "'b' AS after", "'' AS detail")
    for kind, mark in (("github", "::error"), ("html", "<tr>"), ("markdown", "| regression"), ("terminal", "regression:"), ("json", '"kind":"regression"')):
        assert whole(reports.comparison_document(kind, changes, {"regressions": n})).count(mark) == n


def test_documents_written_by_tasks_are_the_streamed_ones(spark, tmp_path, request):
    from pagelens.sinks import reports

    probes, targets, found = many_findings(spark, 37)
    probes, targets, found = (df.repartition(3) for df in (probes, targets, found))
    summary = {"targets": 37, "probes": 37, "errors": 37, "warnings": 0, "info": 0, "incomplete": 0, "waived": 0}
    row = spark.createDataFrame([tuple(summary.values())], ", ".join(f"{k} int" for k in summary))
    changes = probes.selectExpr("'regression' AS kind", "cast(target_ord AS string) AS target", "agent", "'f' AS field", "'code' AS code", "'a' AS before", "'b' AS after", "'' AS detail")
    made = {
        "json": lambda f: reports.json_document({"findings": f, "targets": targets}, summary, {"schemaVersion": 2}), "sarif": reports.sarif_document, "github": reports.github_document,
        "markdown": lambda f: reports.markdown_document(row, f), "junit": lambda f: reports.junit_document(probes, f, targets, summary),
        "comparison": lambda f: reports.comparison_document("json", changes, {"regressions": 37}),
    }
    # so that small tasks stay apart
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    for name, document in made.items():
        for kind, frame in (("all", found), ("none", found.limit(0))):
            path = tmp_path / f"{name}-{kind}"
            reports.write_document(document(frame), spark, str(path))
            files = sorted(path.glob("part-*"))
            assert "".join(f.read_text() for f in files) == "".join(reports.streamed(document(frame)))
            # the rows lie in more than one task's file
            assert kind == "none" or len([f for f in files if f.stat().st_size]) > 1
    with pytest.raises(ValueError):
        reports.write_document(iter(["no line"]), spark, str(tmp_path / "bad"))


def test_junit_samples_and_characters(spark):
    from xml.etree import ElementTree

    from pagelens.schemas import FINDINGS
    from pagelens.sinks import reports

    targets = spark.createDataFrame([(0, "http://a/?x=1&y")], "target_ord int, url string")
    probes = spark.createDataFrame([(0, 0, "x", s, 10.0, 5.0) for s in (1, 2, 3)] + [(0, 1, "y", 1, None, 5.0)], "target_ord int, agent_ord int, agent string, sample int, complete_ms double, first_byte_ms double")
    some = [("sampleNumbers", "string", "1,3")]
    rows = [
        (0, 1, 0, 1, 0, "bad-one", "warning", "m \x01 <&> \ud83d\ude00", "u", "x", some), (0, 1 << 20, 0, 42, 0, "whole-agent", "error", "m", "u", "y", []),
        (0, 1 << 20, 1 << 20, 35, 0, "drift", "warning", "m", "u", None, []), (0, 1, 0, 24, 0, "note", "info", "seen", "u", "x", []),
    ]
    text = "".join(reports.streamed(reports.junit_document(probes, spark.createDataFrame(rows, FINDINGS), targets, {"waived": 0, "incomplete": 0})))
    suite = ElementTree.fromstring(text).find("testsuite")
    kinds = {c.get("name"): [e.tag for e in c] for c in suite.findall("testcase")}
    assert kinds == {"x#1": ["failure"], "x#2": [], "x#3": ["failure"], "y#1": ["error"], "target": ["failure"]}
    assert (suite.get("tests"), suite.get("failures"), suite.get("errors")) == ("5", "3", "1")
    assert suite.find("system-out").text == "note: seen" and "\x01" not in text
    fixed = spark.createDataFrame([("fixed", "t", None, "f", "c", "a", "b", None), ("changed", "t", None, "f", "c", "a", "b", None)], "kind string, target string, agent string, field string, code string, before string, after string, detail string")
    assert "".join(reports.streamed(reports.comparison_document("github", fixed, {}))) == ""
