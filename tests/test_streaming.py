"""A chunk feed as a stream: assembled, inspected, late chunks set aside."""

import time

from pagelens.streaming.chunks import CHUNKS, start


def wait(query, rows, seconds=60):
    """Until the batches done have read `rows` chunks."""
    until = time.monotonic() + seconds
    while sum(p.numInputRows for p in query.recentProgress) < rows:
        assert query.isActive and time.monotonic() < until
        time.sleep(0.2)


def test_stream(spark, tmp_path):
    html = b"<html><head><title>T</title></head><body><h1>H\xe9</h1><script type='application/ld+json'>{\"@type\":\"A\"}</script></body></html>"
    feed = str(tmp_path / "feed")
    part = lambda rows: spark.createDataFrame(rows, CHUNKS).coalesce(1).write.mode("append").parquet(feed)
    # a's charset comes with its first chunk only, and its third chunk before its second
    part([("a", 0, 1.0, html[:30], "latin1", False), ("b", 0, 1.0, html, "latin1", True), ("c", 0, 1.0, html, None, False)])
    chunks = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).parquet(feed)
    query = start(chunks, str(tmp_path / "out"), str(tmp_path / "cp"), max_bytes=10_000, timeout_ms=600_000)
    wait(query, 3)
    read = lambda t: spark.read.parquet(str(tmp_path / "out" / t))
    early = {(r.probe_id, r.kind, r.value) for r in read("signals").collect()}
    assert ("a", "title", "T") in early and not any(p == "a" and k == "h1" for p, k, _ in early)
    part([("a", 2, 9.0, html[55:], None, True), ("b", 1, 2.0, b"x", None, False)])
    wait(query, 5)
    assert read("signals").where("probe_id = 'a' AND kind = 'h1'").count() == 0
    part([("a", 1, 5.0, html[30:55], None, False)])
    wait(query, 6)
    query.stop()
    got = {(r.probe_id, r.kind): (r.value, r.at_ms) for r in read("signals").collect()}
    assert got["a", "title"] == ("T", 1.0) and got["a", "h1"] == ("Hé", 5.0) and got["b", "h1"] == ("Hé", 1.0)
    assert [(r.probe_id, list(r.types)) for r in read("json_ld").where("probe_id = 'a'").collect()] == [("a", ["A"])]
    assert [r.probe_id for r in read("late").collect()] == ["b"]
    assert sorted((r.probe_id, r.completion, r.bytes_read) for r in read("probes").collect()) == [("a", "complete", len(html)), ("b", "complete", len(html))]


def test_cut_and_timeout(spark, tmp_path):
    feed = str(tmp_path / "feed")
    spark.createDataFrame([("a", 0, 1.0, b"<title>T</title>", None, False), ("b", 0, 1.0, b"<h1>" + b"x" * 200, None, False)], CHUNKS).write.parquet(feed)
    query = start(spark.readStream.schema(CHUNKS).parquet(feed), str(tmp_path / "out"), str(tmp_path / "cp"), max_bytes=50, timeout_ms=500)
    until, found = time.monotonic() + 60, []
    while len(found) < 2 and time.monotonic() < until:
        time.sleep(1)
        if list((tmp_path / "out" / "probes").glob("batch=*/_SUCCESS")):
            found = sorted((r.probe_id, r.completion, r.bytes_read) for r in spark.read.parquet(*[str(f.parent) for f in (tmp_path / "out" / "probes").glob("batch=*/_SUCCESS")]).collect())
    query.stop()
    assert found == [("a", "timeout", 16), ("b", "max-bytes-exceeded", 50)]


def test_chunks_in_any_order_over_a_restart(spark, tmp_path):
    """What comes of shuffled chunks, half of them before the query is stopped and half after, is what comes of whole documents."""
    import random

    from pagelens.operators.inspector import inspect_page

    rng, feed = random.Random(8), str(tmp_path / "feed")
    pages = {f"p{k}": b"<html><head><title>T%d</title><meta name=description content=d></head><body><h1>H%d \xc3\xa9</h1><main>text %s</main></body></html>" % (k, k, b"x" * rng.randint(0, 90)) for k in range(12)}
    chunks, want = [], {}
    for name, body in pages.items():
        ends = sorted(rng.sample(range(1, len(body)), 6)) + [len(body)]
        cuts = list(zip([0, *ends], ends))
        chunks += [(name, n, float(n), body[a:b], "utf-8", b == len(body)) for n, (a, b) in enumerate(cuts)]
        found = inspect_page(body, "utf-8", ends, [float(n) for n in range(len(ends))])
        want |= {(name, s["kind"], s["ord"]): (s["value"], s["at_ms"], s["observed_by_byte"]) for s in found.signals}
    rng.shuffle(chunks)
    read = 0
    for part in (chunks[:20], chunks[20:42], chunks[42:]):
        spark.createDataFrame(part, CHUNKS).coalesce(1).write.mode("append").parquet(feed)
        query = start(spark.readStream.schema(CHUNKS).parquet(feed), str(tmp_path / "out"), str(tmp_path / "cp"), timeout_ms=600_000)
        wait(query, len(part))
        query.stop()
        read += len(part)
    assert read == len(chunks)
    got = {(r.probe_id, r.kind, r.ord): (r.value, r.at_ms, r.observed_by_byte) for r in spark.read.parquet(str(tmp_path / "out" / "signals")).collect()}
    assert got == want
    ends = spark.read.parquet(str(tmp_path / "out" / "probes")).collect()
    assert sorted((r.probe_id, r.completion, r.bytes_read) for r in ends) == sorted((n, "complete", len(b)) for n, b in pages.items())
    assert spark.read.parquet(str(tmp_path / "out" / "late")).count() == 0
