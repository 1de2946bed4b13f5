"""Signals of small documents, chunk by chunk."""

import pytest

from pagelens.functions.encodings import encoding_of
from pagelens.operators.ingest import bodies, byte_capped, charset_parameter, stream_shape
from pagelens.operators.inspector import Page, fixed_chunks, inspect_page, inspected, json_ld_of, signals_of

PAGE = """<!DOCTYPE html><html><head><meta charset=utf-8><title> A &amp; <b>B  </title><meta name="description" content="">
<meta name='robots' content="index, NoFollow"><link rel="x canonical" href="/c/../d#x"><meta property="og:title" content="T é">
<script type="application/ld+json">{"@graph":[{"@type":["Article"," Thing "]}]}</script><script type="application/ld+json">{bad</script>
</head><body><title>two</title><svg><title>no</title></svg><!-- <h1>no</h1> --><h1>Hi <em>there</em></h1>
<main><script>x</script> <noscript>q</noscript><p>Main &lt;text&gt;</p> more</main></body></html>"""


@pytest.mark.parametrize("size", [1, 7, 1024])
def test_signals(spark, size):
    frame = spark.createDataFrame([("p", PAGE), ("none", None), ("empty", "")], "probe_id string, html string")
    documents = inspected(fixed_chunks(frame, size))
    got = {(r.kind, r.ord): r for r in signals_of(documents).collect()}
    assert {k: r.value for k, r in got.items()} == {
        ("title", 1): "A & <b>B", ("title", 2): "two", ("description", 1): "", ("robots", 1): "index, NoFollow", ("canonical", 1): "/c/../d#x",
        ("social", 1): "T é", ("h1", 1): "Hi there", ("main", 1): "Main <text> more",
    }
    raw = PAGE.encode()
    seen = lambda mark: min(len(raw), -(-(raw.index(mark) + len(mark)) // size) * size)
    assert got["title", 1].observed_by_byte == seen(b"</title>")
    assert (got["title", 1].location, got["title", 2].location, got["h1", 1].location) == ("head", "body", "body")
    assert [(r.valid, list(r.types)) for r in json_ld_of(documents).orderBy("ord").collect()] == [(True, ["Article", "Thing"]), (False, [])]
    m = documents.where("probe_id = 'p'").first()
    assert m.head_close.observed_by_byte == seen(b"</head>") and m.document_close.observed_by_byte == len(raw)


def test_one_tokenisation_a_document(spark):
    frame = spark.createDataFrame([("p", PAGE)], "probe_id string, html string")
    plan = signals_of(inspected(fixed_chunks(frame, 64)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


def values(html, size=1 << 20, charset=None):
    raw = html if isinstance(html, bytes) else html.encode()
    ends = [*range(size, len(raw), size), len(raw)]
    page = inspect_page(raw, charset, ends, [float(k) for k in range(len(ends))])
    return [(s["kind"], s["value"]) for s in page.signals], page


def test_huge_and_broken_markup():
    big = "<head><meta " + "a" * 1_000_000 + " name=description content='x>y'><title>T</title>"
    assert values(big, 1024)[0] == [("description", "x>y"), ("title", "T")]
    assert values("<title>T</title><meta content=\"" + "a>" * 300_000, 1024)[0] == [("title", "T")]
    assert values("<body>" + "<div>" * 50_000 + "</p>" * 50_000 + "<main>x")[0] == [("main", "x")]
    assert values("<meta name=description content=" + "x" * 6000 + ">")[0] == [("description", "x" * 4096)]
    assert values("<h1>a < b &copy; 1<2</h1>")[0] == [("h1", "a < b © 1<2")]


@pytest.mark.parametrize("size", [1, 3, 50])
def test_markup(size):
    got = lambda html: values(html, size)[0]
    # names without a semicolon before '=' are no entities in attributes
    assert got("<link rel=canonical href=/?a=1&copy=2&amp;b>") == [("canonical", "/?a=1&copy=2&b")]
    # an end tag ends what was opened since, and nothing without a start
    assert got("<div><h1>one</div>x</h1><h1>two</h1>") == [("h1", "one"), ("h1", "two")]
    assert got("<template><title>no</title></template><svg/><title>yes</title>") == [("title", "yes")]
    assert got("<!-- <title>no</title> --><!doctype html><?x <title>?><script>'<title>no</title>'</script><TITLE>yes</TITLE >") == [("title", "yes")]
    assert got("<title>a &am") == [("title", "a &am")] and got("<title>a<") == [("title", "a<")]
    assert got("<main><script>a</script><noscript>b</noscript> <p>c</p></main>") == [("main", "c")]
    assert got('<meta property="og:title" name=description content=x><meta name="OG:TITLE" content=y>') == [("description", "x"), ("social", "x"), ("social", "y")]
    head = values("<html><head><title>t</title><body><title>u</title></body>", size)[1]
    assert [s["location"] for s in head.signals] == ["head", "body"] and "document_close" not in head.marks and "head_close" in head.marks


def test_limits_of_signals():
    many = "".join(f"<meta name=description content=d{k}><meta property=og:title content=o{k}><meta property=og:type content=t{k}>" for k in range(300))
    page = values(many)[1]
    kinds = [(s["kind"], s["property"]) for s in page.signals]
    assert kinds.count(("description", None)) == kinds.count(("social", "og:title")) == kinds.count(("social", "og:type")) == 256
    script = "<script type='application/ld+json; charset=x'>{}</script>"
    page = values(script * 70 + script.replace("{}", '"' + "x" * 1_100_000 + '"'))[1]
    assert len(page.blocks) == 65 and page.blocks[-1]["limit"] == "blocks"
    page = values(script.replace("{}", '"' + "x" * 1_100_000 + '"') + script.replace("{}", "NaN") + script.replace("{}", "[" * 100_000))[1]
    assert [(b["limit"], b["valid"]) for b in page.blocks] == [("size", None), (None, False), (None, False)]


def test_a_page_goes_on_from_its_state():
    raw = ("é" + PAGE).encode("latin-1", "ignore")
    whole = values(raw, 10, "latin1")[0]
    got, page = [], Page(decoder={"charset": "latin1"})
    for k in range(0, len(raw), 10):
        page = Page(**page.state())
        page.feed(raw[k : k + 10], 0.0)
        got += page.signals
    page = Page(**page.state())
    page.feed(b"", 0.0, last=True)
    assert [(s["kind"], s["value"]) for s in got + page.signals] == whole


def test_ingest(spark):
    chunks = spark.createDataFrame([("a", 0, 5.0, b"abc"), ("a", 1, 9.0, b""), ("a", 2, 15.0, b"defg"), ("b", 0, float("nan"), b"xy")], "probe_id string, seq int, at_ms double, bytes binary")
    shape = stream_shape(chunks).where("probe_id = 'a'").first()
    assert (shape.chunks, shape.spanned_ms, shape.max_gap_ms, shape.idle_ms) == (3, 10.0, 6.0, 10.0)
    cut = {r.probe_id: r for r in bodies(byte_capped(chunks, 5)).collect()}
    assert bytes(cut["a"].body) == b"abcde" and cut["a"].body_sha256 is None and list(cut["a"].chunk_ends) == [3, 5]
    assert bytes(cut["b"].body) == b"xy" and cut["b"].body_sha256 is not None and list(cut["b"].chunk_at) == [0.0]


def test_encodings():
    assert encoding_of(b"\xef\xbb\xbfx", "latin1") == "utf-8"
    assert encoding_of(b"x", "ISO-8859-1") == "cp1252"
    assert encoding_of(b'<meta charset="shift_jis">', "no such") == "cp932"
    assert encoding_of(b'<meta charset="utf-16">', None) == "utf-8"
    assert encoding_of(b'<!-- <meta charset="latin1"> --><meta http-equiv=Content-Type content="text/html; charset=koi8-r">', None) == "koi8-r"
    # codecs that are no character encodings of the web are passed over
    for label in ("base64", "hex", "rot13", "undefined", "idna", "utf-7", "unicode_escape"):
        assert encoding_of(b"plain", label) is None
        assert values(f"<meta charset={label}><title>caf\u00e9</title>".encode(), 7, label)[0] == [("title", "café")]
    assert values(b"<title>\x93q\x94</title>", 2, "windows-1252")[0] == [("title", "“q”")]
    assert values("﻿<title>é</title>".encode("utf-16-le"), 3)[0] == [("title", "é")]
    assert values("<title>日本</title>".encode("shift_jis"), 1, "sjis")[0] == [("title", "日本")]


def test_charset_parameter(spark):
    given = {"text/html; charset=UTF-8": "utf-8", 'text/html; x="a; charset=no"; charset="latin1"': "latin1", "text/html;charset='koi8-r'": "koi8-r", "text/html": None, None: None}
    frame = spark.createDataFrame([(g,) for g in given], "c string")
    assert {r.c: r.f for r in frame.select("c", charset_parameter(frame["c"]).alias("f")).collect()} == given
