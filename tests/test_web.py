"""Fetching from a server on this machine."""

import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from quire.sources.web import Fetcher, WebSource, fetch


class Site(BaseHTTPRequestHandler):
    seen, now, most, lock = Counter(), 0, 0, threading.Lock()

    def do_GET(self):
        with Site.lock:
            Site.seen[self.path] += 1
            Site.now += 1
            Site.most = max(Site.most, Site.now)
        try:
            self.answer()
        finally:
            with Site.lock:
                Site.now -= 1

    def answer(self):
        path, n = self.path, Site.seen[self.path]
        if path.startswith("/slow"):
            time.sleep(0.05)
        if path == "/busy" and n < 3:
            return self.say(503, b"", {"Retry-After": "0"})
        if path == "/down":
            return self.say(502, b"")
        if path == "/drop" and n < 2:
            return self.connection.close()
        if path.startswith("/hop"):
            k = int(path[4:])
            return self.say(302, b"", {"Location": f"/hop{k - 1}" if k else "/page?x=1"})
        if path == "/loop":
            return self.say(301, b"", {"Location": "/loop"})
        if path == "/out":
            return self.say(302, b"", {"Location": "ftp://a.example/x"})
        if path == "/missing":
            return self.say(404, b"no")
        self.say(200, b"x" * 5000 if path == "/large" else f"body of {path}".encode())

    def say(self, status, body, headers=None):
        self.send_response(status)
        for k, v in {"Content-Type": "text/html", "Content-Length": str(len(body)), **(headers or {})}.items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


PATHS = ("/page?x=1", "/busy", "/down", "/drop", "/hop3", "/hop9", "/hop10", "/loop", "/out", "/missing", "/large")


def judge(rows, site):
    got = {r.url.removeprefix(site): r for r in rows}
    assert set(got) == {*PATHS, "not an address"}
    assert bytes(got["/page?x=1"].body) == b"body of /page?x=1" and got["/page?x=1"].tries == 1 and got["/page?x=1"].content_type == "text/html"
    assert (got["/busy"].status, got["/busy"].error) == (200, None) and got["/drop"].status == 200
    assert (got["/down"].status, got["/down"].tries, got["/down"].error) == (502, 3, "HTTP 502")
    for k in ("/hop3", "/hop9"):
        assert got[k].final_url == f"{site}/page?x=1" and bytes(got[k].body) == b"body of /page?x=1"
    for k in ("/hop10", "/loop"):
        assert "redirects" in got[k].error and got[k].body is None
    assert "not an address of the web" in got["/out"].error and got["/missing"].error == "HTTP 404"
    assert "larger than 4000" in got["/large"].error and got["not an address"].error


def test_data_source(spark, site):
    Site.seen.clear()
    spark.dataSource.register(WebSource)
    urls = "\n".join([*(site + p for p in PATHS), "", "not an address", site + "/busy"])
    rows = spark.read.format("quire_web").option("urls", urls).option("private", "true").option("waits", "0,0").option("size_cap", "4000").load()
    judge(rows.collect(), site)
    assert Site.seen["/busy"] == 3 and Site.seen["/drop"] == 2


def test_table_of_addresses(spark, site):
    Site.seen.clear()
    pages = spark.createDataFrame([(site + p,) for p in PATHS] + [("not an address",), (site + "/busy",)], "address string")
    judge(fetch(pages, "address", private="true", waits="0,0", size_cap=4000).collect(), site)


def test_limit_by_host(spark, site):
    Site.most = 0
    pages = spark.createDataFrame([(f"{site}/slow{i}",) for i in range(40)], "url string")
    assert fetch(pages, private="true").filter("status = 200").count() == 40
    assert 1 < Site.most <= 4


def test_private_networks_are_refused():
    for url in ("http://127.0.0.1/", "http://10.0.0.8/x", "http://[::1]/", "http://169.254.169.254/latest", "http://localhost:1/"):
        assert "private network" in Fetcher().row(url)["error"]
    assert Fetcher().row(None)["error"] and Fetcher().row("file:///etc/passwd")["error"]
