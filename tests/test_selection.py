"""Order statistics, rule matching, waivers and directives against plain versions; strict reading; addresses in reports."""

import json
import random
import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from pagelens import schemas


def test_order_statistics(spark):
    from pagelens.operators.order_stats import at_ranks, medians, nearest, value_range

    rng = random.Random(4)
    rows = [(None if k % 5 == 0 else f"g{k % 4}", rng.choice([rng.uniform(-5, 5), rng.gauss(1000, 0.01), 0.0, -0.0, 7.25])) for k in range(900)]
    rows += [("one", 3.5), ("none", None), ("none", float("nan")), ("none", float("inf")), ("two", 1e-300), ("two", -1e300)] + [("hot", 250.0)] * 500 + [("hot", 250.0 + k / 1000) for k in range(301)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(3)
    groups = {}
    for k, v in rows:
        if v is not None and v == v and abs(v) < float("inf"):
            groups.setdefault(k, []).append(v)
    got = {r.k: r for r in at_ranks(frame, ["k"], "v", {"third": lambda n: F.least(n, F.lit(3)), "p95": nearest(0.95)}, (F.max("_v").alias("top"),)).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        values.sort()
        r = got[k]
        assert (r.n, r.third, r.p95, r.top) == (len(values), values[min(3, len(values)) - 1], values[-(-len(values) * 95 // 100) - 1], values[-1])
    middle = {r.k: r.m for r in medians(frame, ["k"], "v", "m").collect()}
    for k, values in groups.items():
        n = len(values)
        assert middle[k] == pytest.approx((values[(n - 1) // 2] + values[n // 2]) / 2, rel=1e-12)
    ranges = [r[0] for r in spark.createDataFrame([(v,) for v in sorted(x for g in groups.values() for x in g)], "v double").coalesce(1).select(value_range(F.col("v"))).collect()]
    assert ranges == sorted(ranges)


def test_robots_rules_against_every_rule(spark):
    """The prefix join finds what holding every rule of a group against every path finds."""
    from pagelens.operators.robots import rule_matches

    rng = random.Random(9)
    pieces = ["/", "a", "b", "*", "$", "/a", ".html", "?", "%2f", "é"]
    rules = [(g, n, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 6)))) for g in range(3) for n in range(60)]
    rules += [(0, 100, "/a*$"), (0, 101, "/*b*$"), (1, 102, "/a**")]
    paths = [(k, k % 3, "/" + "".join(rng.choice(["a", "b", "/", ".html", "%2F", "%C3%A9", "?"]) for _ in range(rng.randint(0, 6)))) for k in range(150)]

    def plain(text):
        encoded = "".join(c if ord(c) < 128 else "".join(f"%{b:02X}" for b in c.encode()) for c in text)
        return re.sub("%[0-9a-fA-F]{2}", lambda m: m[0].upper(), encoded)

    want = set()
    for k, g, path in paths:
        for h, n, rule in rules:
            ends = rule.endswith("$")
            body = plain(rule[:-1] if ends else rule).replace("$", "%24")
            if g == h and re.match("^" + ".*".join(map(re.escape, body.split("*"))) + ("$" if ends else ""), path):
                want.add((k, n, len(plain(rule).rstrip("*"))))
    left = spark.createDataFrame([("o", g, p, k) for k, g, p in paths], "origin string, group_ord int, form string, k int")
    right = spark.createDataFrame([("o", g, n, True, r) for g, n, r in rules], "origin string, group_ord int, rule_ord int, allow boolean, path string")
    got = [(r.k, r.rule_ord, r.size) for r in rule_matches(left, right).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(rule.endswith("*$") for _, _, rule in rules)


def test_first_waiver(spark):
    from pagelens.operators.waivers import first_waiver

    rng = random.Random(6)
    codes, targets, agents = ["a", "b", "c"], ["t0", "t1", "u1", "u2", "zz"], ["x", "y"]
    waivers = [(n, rng.choice([*codes, "*"]), rng.choice([*targets, None]), rng.choice([*agents, None])) for n in range(40)]
    findings = [(c, i, u, g) for c, (i, u), g in product([*codes, "d"], [("t0", "u0"), ("t1", "u1"), (None, "u2"), ("t3", "u3")], [*agents, "z", None])] * 2
    for some in (waivers, waivers[:3], waivers[:1], [(5, "*", None, None)], []):
        want = []
        for c, i, u, g in findings:
            hit = [n for n, wc, wt, wa in some if wc in ("*", c) and (wt is None or wt in (i, u)) and (wa is None or wa == g)]
            want.append((c, i, u, g, min(hit, default=None)))
        frame = spark.createDataFrame(findings, "code string, target_id string, url string, agent string")
        got = first_waiver(frame, spark.createDataFrame(some, "waiver_ord int, code string, target string, agent string")).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def facts_of(spark, robots, agent="browser", contract=False, social=()):
    """Facts of one complete probe with the given (audience, content) directives and (property, content) social metadata."""
    from pagelens.operators.inspector import fixed_chunks, inspected
    from pagelens.operators.rules import probe_facts

    page = "<html><head><title>T</title>" + "".join(f'<meta name="{a}" content="{c}">' for a, c in robots) + "".join(f'<meta property="{p}" content="{c}">' for p, c in social) + "</head><body></body></html>"
    row = ("p", 0, 0, agent, 1, "http://a.example/x/", "http://a.example/x/", 200, "complete", None, 1, "d", {}, [], 1.0, 2.0, 3.0)
    target = (0, None, "http://a.example/x/", [200], None, *[False] * 5, contract, contract, None, None)
    agents = spark.createDataFrame([(0, agent, agent, agent, False)], schemas.AGENTS)
    documents = inspected(fixed_chunks(spark.createDataFrame([("p", page)], "probe_id string, html string"), 50))
    return probe_facts(spark.createDataFrame([row], schemas.PROBES), documents, spark.createDataFrame([target], schemas.TARGETS), agents)


@pytest.mark.parametrize(
    "agent,robots,want",
    [
        ("browser", [("googlebot", "noindex"), ("googlebot", "index")], {}),
        ("Googlebot", [("googlebot", "noindex"), ("googlebot", "index")], {"conflicting-robots": ("googlebot", "2", "2")}),
        ("browser", [("robots", "index, noindex")], {}),
        ("browser", [("robots", "index, noindex"), ("robots", " ")], {}),
        ("browser", [("robots", "none"), ("robots", "Follow")], {"conflicting-robots": ("robots", "2", "2")}),
        ("browser", [("robots", "a; B"), ("robots", "b,A")], {"duplicate-robots": ("robots", "2", "1")}),
        ("googlebot", [("robots", "index, follow"), ("googlebot", "noindex"), ("googlebot", "nofollow"), ("bingbot", "none")], {"multiple-robots": ("googlebot", "2", "2")}),
        ("googlebot", [("robots", "noindex"), ("googlebot", "all")], {"conflicting-robots": ("effective", "2", "4")}),
        ("bingbot", [("robots", "noindex"), ("googlebot", "all")], {}),
    ],
)
def test_directives_by_audience(spark, agent, robots, want):
    from pagelens.operators.rules import probe_findings

    found = probe_findings(facts_of(spark, robots, agent)).where("code LIKE '%-robots'").collect()
    got = {r.code: tuple({e.k: e.v for e in r.evidence}[k] for k in ("audience", "count", "distinctValues")) for r in found}
    assert got == want


def test_signatures_ignore_spelling_and_headings(spark):
    from pagelens.operators.rules import prepared
    from pagelens.operators.stability import metadata_signatures

    def of(robots, social, agent="browser"):
        values, places = metadata_signatures()
        return tuple(prepared(facts_of(spark, robots, agent, True, social)).select(values.alias("v"), places.alias("p")).first())

    plain = of([("robots", "noindex, follow")], [("og:type", "article"), ("og:url", "/p"), ("og:image", "a.png"), ("og:image", "b.png")])
    assert plain == of([("robots", "follow;NOINDEX")], [("og:type", "ARTICLE"), ("og:url", "http://a.example/p#x"), ("og:image", "/x/a.png"), ("og:image", "b.png")])
    swapped = of([("robots", "noindex, follow")], [("og:type", "article"), ("og:url", "/p"), ("og:image", "b.png"), ("og:image", "a.png")])
    assert swapped[0] != plain[0] and swapped[1] != plain[1]
    # another crawler's directives do not count
    assert plain[0] == of([("robots", "noindex, follow"), ("bingbot", "none")], [("og:type", "article"), ("og:url", "/p"), ("og:image", "a.png"), ("og:image", "b.png")])[0]


def test_keys_at_every_depth(spark):
    from pagelens.sources.runs import RunError, unknown_keys, upgraded

    kind = spark.createDataFrame([], "a int, m map<string,string>, r array<struct<u:string,s:struct<x:int>>>, n array<array<int>>").schema
    good = ["{}", '{"a": 1, "m": {"any": "x"}, "r": [{"u": "q", "s": {"x": 1}}, {}], "n": [[1]]}', '{"r": null, "a": null}', '{"r": []}']
    bad = ['{"b": 1}', '{"r": [{"u": "q"}, {"v": 1}]}', '{"r": [{"s": {"x": 1, "y": 2}}]}']
    frame = spark.createDataFrame([(t,) for t in good + bad], "t string").coalesce(1)
    assert [r[0] for r in frame.select(unknown_keys(F.col("t"), kind)).collect()] == [False] * len(good) + [True] * len(bad)
    assert upgraded({"schemaVersion": 1, "summary": {"errors": 2}}) == {"schemaVersion": 2, "summary": {"errors": 2, "waived": 0}}
    assert upgraded({"schemaVersion": 2, "summary": {"waived": 3}})["summary"] == {"waived": 3}
    with pytest.raises(RunError):
        upgraded({"schemaVersion": 1, "summary": {"waived": 3}})


def test_addresses_in_reports():
    from pagelens.functions.urls import shown_host, shown_url
    from pagelens.sources.fetch import site

    assert shown_url("http://me:secret@A.example:80/x?q#f") == "http://a.example/x?q#f"
    assert (shown_url("no url"), shown_url(None), shown_url("https://b.example:444")) == ("[invalid URL]", None, "https://b.example:444/")
    assert (shown_host("http://me:secret@A.example:8080/x"), shown_host("no url")) == ("a.example:8080", "no url")
    assert site("https://A.example:443/x") == site("https://a.example/y") != site("http://a.example/y")


def test_json_ld_types_within_limits():
    from pagelens.operators.inspector import NODE_CAP, TYPE_CAP, json_types

    assert json_types({"@type": ["B", " A ", "", 3], "x": [{"@type": "C"}, "s"]}) == ["A", "B", "C"]
    # the types of one list come in their order, so the first ones stay
    assert json_types({"@type": [f"t{k:04}" for k in range(TYPE_CAP + 50)]}) == [f"t{k:04}" for k in range(TYPE_CAP)]
    # values that wait count as much as those looked at: the first of a long list are kept, and looked at from the last
    many = [{"@type": "first"}] + [0] * (NODE_CAP - 2) + [{"@type": "last"}]
    assert json_types(many) == ["first"]
    assert json_types(json.loads("[" * 500 + '{"@type": "deep"}' + "]" * 500)) == ["deep"]


def test_declared_encodings():
    from pagelens.functions.encodings import declared, parameter

    assert parameter("text/html; Charset = 'a b' ; charset=c", "charset") == "a b"
    assert (parameter("charset=utf-8 x", "charset"), parameter("x; charset", "charset"), parameter('charset="utf-8', "charset")) == ("utf-8", None, '"utf-8')
    assert declared(b'<meta http-equiv="Content-Type" content="text/html; charset=latin1">') == "cp1252"
    assert declared(b'<meta charset="nope"><meta charset="utf-16">') == "utf-8"
    assert declared(b'<!-- <meta charset="latin1"> --><meta charset="koi8-r"') is None
