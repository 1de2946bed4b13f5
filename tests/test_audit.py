"""From a loopback server through the data source, audit, storage, comparison and the command line."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from pagelens import cli
from pagelens.sources import agents, config, http


class Site(BaseHTTPRequestHandler):
    def do_GET(self):
        if self.path == "/old":
            self.send_response(301)
            self.send_header("Location", "/")
            self.end_headers()
            return
        if self.path == "/robots.txt":
            body = b"User-agent: *\nDisallow: /gone\n"
        elif self.path == "/map.xml":
            import gzip

            body = gzip.compress(b"<urlset><url><loc>" + self.server.site.encode() + b"/en/a</loc></url><url><loc>" + self.server.site.encode() + b"/de/a</loc></url></urlset>")
        if self.path in ("/robots.txt", "/map.xml"):
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)
            return
        body = b"<html><head><title>Home</title></head><body><h1>Hi</h1><main>Text</main></body></html>"
        self.send_response(404 if self.path == "/gone" else 200)
        self.send_header("Content-Type", "application/json" if self.path == "/data" else "text/html; charset=utf-8")
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    server.site = f"http://127.0.0.1:{server.server_port}"
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_probe(site):
    ask = lambda path, **more: http.probe({"probe_id": "p", "url": site + path, "user_agent": "x"} | more)
    names = [f.split()[0] for f in ("probe_id r", "requested_url r", "final_url r", "status r", "completion r", "error r", "bytes_read r")]
    row = dict(zip(names, ask("/old")))
    assert row["completion"] == "complete" and row["final_url"] == site + "/" and row["status"] == 200
    assert ask("/data")[4] == "invalid-response"
    assert ask("/", max_bytes=10)[4] == "max-bytes-exceeded" and len(ask("/", max_bytes=10)[13]) == 10
    assert ask("/old", max_redirects=0)[4] == "redirect-limit"
    assert http.probe({"probe_id": "p", "url": "ftp://x", "user_agent": "x"})[4] == "invalid-response"
    assert http.probe({"probe_id": "p", "url": "http://127.0.0.1:9/", "user_agent": "x"})[4] == "network-error"


def test_check_and_compare(spark, site, tmp_path, capsys):
    setting = {"targets": [{"id": "home", "url": site + "/", "require": {"description": False, "canonical": False}}, site + "/gone"], "agents": ["chrome"]}
    path = tmp_path / "c.json"
    path.write_text(json.dumps(setting))
    assert cli.main(["check", "--config", str(path), "--format", "json", "--write-run", str(tmp_path / "a")]) == 1
    document = json.loads(capsys.readouterr().out)
    assert sorted((f["code"], f["target_ord"]) for f in document["findings"]) == [("missing-canonical", 1), ("missing-description", 1), ("robots-txt-conflict", 1), ("robots-txt-disallowed", 1), ("status-mismatch", 1)]
    assert document["summary"]["probes"] == 2
    setting["targets"][0]["require"]["description"] = True
    path.write_text(json.dumps(setting))
    assert cli.main(["check", "--config", str(path), "--format", "github", "--fail-on", "never", "--write-run", str(tmp_path / "b")]) == 0
    assert "::error title=status-mismatch::" in capsys.readouterr().out
    assert cli.main(["compare", str(tmp_path / "a"), str(tmp_path / "b"), "--format", "json"]) == 1
    changes = {(c["kind"], c["code"]) for c in json.loads(capsys.readouterr().out)["changes"]}
    assert ("regression", "missing-description") in changes and ("changed", "target-policy-changed") in changes


def test_baseline_sitemap_and_options(spark, site, tmp_path, capsys):
    base, out = str(tmp_path / "base.json"), str(tmp_path / "r" / "report.html")
    args = ["check", "--sitemap", site + "/map.xml", "--sitemap-include", "/en/*", "-a", "chrome", "-H", "X-Y: z", "--timeout", "5000", "--fail-on", "never", "--baseline", base]
    assert cli.main([*args, "--update-baseline", "-f", "markdown"]) == 0
    assert "missing-description" in capsys.readouterr().out
    report = json.loads(open(base).read())
    assert [t["url"] for t in report["targets"]] == [site + "/en/a"] and report["targets"][0]["id"] == "en-a"
    assert cli.main([*args, "-f", "html", "-o", out, "--framework", "nextjs"]) == 0
    said = capsys.readouterr().err
    assert '"regressions": 0' in said and "export const metadata" in open(out).read()
    assert cli.main([*args[:-2], "-f", "terminal", "--repeat", "2"]) == 0
    assert "missing-canonical" in capsys.readouterr().out
    assert cli.main(["compare", base, base, "-f", "html", "-o", str(tmp_path / "c.html")]) == 0
    # a report that is newer, or holds something unknown, is refused
    for change in ({"schemaVersion": 9}, {"more": 1}, {"probes": [{"nope": 1}]}, {"findings": [{"severity": "fatal"}]}):
        bad = tmp_path / "bad.json"
        bad.write_text(json.dumps(report | change))
        assert cli.main(["compare", base, str(bad)]) == 2
    for wrong in (["check"], ["check", site, "--sitemap", site + "/none.xml"], ["check", site, "--timeout", "1"], ["check", site, "-H", "Host: x"], ["check", site, "--baseline", base, "-o", base]):
        assert cli.main(wrong) == 2


def test_custom_headers_stay_on_their_origin(site):
    seen = []

    class Other(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((self.path, self.headers.get("X-Secret")))
            self.send_response(302 if self.path == "/go" else 200)
            self.send_header("Location", site + "/")
            self.send_header("Content-Type", "text/html")
            self.end_headers()

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Other)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    row = http.probe({"probe_id": "p", "url": f"http://127.0.0.1:{server.server_port}/go", "user_agent": "x", "headers": {"X-Secret": "s"}})
    server.shutdown()
    assert seen == [("/go", "s")] and row[2] == site + "/" and row[4] == "complete"


def test_fetch(site, tmp_path):
    from pagelens.sources import fetch

    assert fetch.robots_document(site)["state"] == "fetched" and "Disallow" in fetch.robots_document(site)["body"]
    assert fetch.robots_document(site, max_bytes=3)["state"] == "unavailable"
    assert fetch.robots_document("http://127.0.0.1:9")["error"]
    assert "<loc>" in fetch.sitemap_document(site + "/map.xml")["xml"]
    for bad in (site + "/gone", str(tmp_path / "none.xml")):
        assert fetch.sitemap_document(bad)["xml"] is None and fetch.sitemap_document(bad)["error"]
    # what unpacks to more than allowed is refused, not cut
    import gzip

    (tmp_path / "big.xml.gz").write_bytes(gzip.compress(b"x" * 100_000))
    assert fetch.sitemap_document(str(tmp_path / "big.xml.gz"), max_bytes=50_000)["xml"] is None
    assert fetch.sitemap_document(str(tmp_path / "big.xml.gz"))["xml"] == "x" * 100_000


def test_compare_sees_lost_signals_and_required_arrival(spark, tmp_path, capsys):
    from pagelens import schemas
    from pagelens.operators.findings import summary
    from pagelens.plans.audit import audit
    from pagelens.sources import runs

    targets = spark.createDataFrame([(0, "x", "http://x/", [200], None, True, False, False, False, False, False, False, None, None)], schemas.TARGETS)
    agents_ = spark.createDataFrame([(0, "browser", "Browser", "Mozilla", False)], schemas.AGENTS)
    probe = ("0/0/1", 0, 0, "browser", 1, "http://x/", "http://x/", 200, "complete", None, 9, "s", {"content-type": "text/html"}, [], 1.0, 2.0, 5000.0)
    probes = spark.createDataFrame([probe], schemas.PROBES)

    def write(name, html, at, targets=targets):
        page = spark.createDataFrame([("0/0/1", html.encode(), [len(html)], [at])], "probe_id string, body binary, chunk_ends array<bigint>, chunk_at array<double>")
        out = audit(probes, page, targets, agents_, now="2026-10-06")
        runs.write_run(out, summary(out["targets"], out["probes"], out["findings"]), str(tmp_path / name), "2026-10-06")

    strict = targets.withColumn("require_h1", targets["require_title"])

    write("early", "<html><head><title>Home</title></head></html>", 10.0)
    write("late", "<html><head><title>Home</title></head></html>", 4000.0)
    write("shell", "<html></html>", 10.0)

    def changes(name):
        cli.main(["compare", str(tmp_path / "early"), str(tmp_path / name), "--format", "json"])
        return {(c["code"], c["field"]) for c in json.loads(capsys.readouterr().out)["changes"]}

    assert ("timing-regression", "required_ms") in changes("late")
    # the arrival of other requirements than before is no regression
    write("other", "<html><head><title>Home</title></head><h1>H</h1></html>", 4000.0, strict)
    assert ("target-policy-changed", "require_h1") in changes("other") and ("timing-regression", "required_ms") not in changes("other")
    assert ("metadata-value-changed", "title") in changes("shell")


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("TOKEN", "t")
    parsed = config.parse({"targets": ["http://a.com/x"], "headers": {"X-A": "${TOKEN}"}}, ("http://a.com/x", "http://b.com/"))
    assert [t["url"] for t in parsed.targets] == ["http://a.com/x", "http://b.com/"] and parsed.headers == {"x-a": "t"}
    for bad in ({"nope": 1}, {"timeoutMs": 5}, {"targets": ["ftp://x"]}, {"headers": {"Host": "x"}}, {"ignore": [{"code": "x", "reason": "r", "until": "2026-02-31"}]}):
        with pytest.raises(config.ConfigError):
            config.parse(bad)
    assert cli.main(["init", str(tmp_path / "n.yml")]) == 0 and cli.main(["init", str(tmp_path / "n.yml")]) == 2
    assert config.load(str(tmp_path / "n.yml")).targets[0]["id"] == "home"


def test_agents():
    assert [a.key for a in agents.resolve(["Chrome", "x", {"key": "Own", "userAgent": "u"}])] == ["browser", "twitterbot", "Own"]
    for bad in (["nobody"], ["google", "googlebot"], [{"key": "a", "userAgent": "x\ny"}]):
        with pytest.raises(ValueError):
            agents.resolve(bad)
