"""Runs that load pages, against a server of their own; every address and hop is vetted."""

import json
import os
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from pagewright import cli
from pagewright.operators import robots
from pagewright.plans import book
from pagewright.sources import live, state
from pagewright.sources.profile import Settings

CHAPTER = '<h1 class="title">Chapter {0}</h1><article class="reader"><p>Body {0}.</article>'


class Site(BaseHTTPRequestHandler):
    asked: Counter = Counter()
    times: list = []
    agents: set = set()
    fail: dict = {}
    chapters = 4
    robots = "User-agent: *\nDisallow: /chapter/4\n"

    def log_message(self, *args):
        pass

    def answer(self, status, body=b"", **headers):
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        site, path = type(self), self.path
        site.asked[path] += 1
        site.times.append(time.time())
        site.agents.add(self.headers["User-Agent"])
        if path == "/robots.txt":
            return self.answer(200, site.robots.encode()) if site.robots is not None else self.answer(404)
        if path == "/toc":
            return self.answer(302, Location="/book/toc")
        if path == "/book/toc":
            items = "".join(f'<li><a href="chapter/{k}">C{k}</a>' for k in range(1, site.chapters + 1))
            return self.answer(200, f'<base href="/"><ol class="toc">{items}<li><a href="javascript:x">b</a></ol>'.encode(), Content_Type="text/html; charset=utf-8")
        if path.startswith("/moved/"):
            return self.answer(302, Location={"private": "http://169.254.169.254/latest", "file": "file:///etc/passwd", "loop": "/moved/loop", "ok": "/chapter/2"}[path[7:]])
        if path == "/slow":
            time.sleep(3)
            return self.answer(200, b"late")
        if path == "/long":
            return self.answer(200, b"<p>" + b"x" * 25_000_000)
        left = site.fail.get(path, 0)
        if left:
            site.fail[path] = left - 1
            self.close_connection = True
            return self.connection.close()
        return self.answer(200, CHAPTER.format(path.rsplit("/", 1)[1]).encode("latin-1"), Content_Type="text/html; charset=latin-1")


@pytest.fixture
def site():
    Site.asked, Site.times, Site.agents, Site.fail, Site.chapters, Site.robots = Counter(), [], set(), {}, 4, "User-agent: *\nDisallow: /chapter/4\n"
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


QUICK = live.Manners(min_delay=0.0, max_delay=0.0, settle=0.0, timeout=2.0, retries=1, concurrency=2, allow_private_hosts=True)


def load(spark, urls, manners=QUICK, **how):
    rows = spark.createDataFrame([(u, k) for k, u in enumerate(urls)], "url string, idx int")
    return {r.url: r for r in live.fetched(rows, manners, **how).collect()}


def test_the_guard_judges_addresses_and_hops():
    names = {"good.example": ["93.184.216.34"], "evil.example": ["93.184.216.34", "10.0.0.1"]}
    screen = live.Screen(lookup=lambda h: names.get(h, [h] if h[0].isdigit() else []))
    assert screen.addresses("https://good.example/x") == ["93.184.216.34"]
    for url, reason in [
        ("", "empty"), ("http://[::1", "malformed"), ("http://e:x/", "malformed"), ("file:///etc/passwd", "disallowed_scheme"), ("//x", "disallowed_scheme"), ("http:///x", "missing_host"),
        ("http://none.example/", "unresolvable_host"), ("http://evil.example/", "private_address"), ("http://127.0.0.1/", "private_address"),
    ]:
        with pytest.raises(live.Refused) as refused:
            screen.addresses(url)
        assert refused.value.reason == reason
    assert live.Screen(allow_private_hosts=True, lookup=lambda h: ["127.0.0.1"]).addresses("http://x/") == ["127.0.0.1"]


def test_nothing_private_is_asked(spark, site):
    got = load(spark, [f"{site}/chapter/1"], live.Manners(min_delay=0, settle=0))
    assert got[f"{site}/chapter/1"].error == "private_address" and not Site.asked and got[f"{site}/chapter/1"].attempts == 1


def test_redirects_are_followed_by_hand(spark, site):
    got = {u.rsplit("/", 1)[1]: r for u, r in load(spark, [f"{site}/moved/{k}" for k in ("private", "file", "loop", "ok")]).items()}
    # The server itself is private here, so only the scheme can be refused; the private hop has no answer to give.
    assert got["file"].error == "disallowed_scheme" and "file:///etc/passwd" in got["file"].detail and got["file"].attempts == 1
    assert got["loop"].error == "too_many_redirects" and got["loop"].attempts == 1 and Site.asked["/moved/loop"] == live.HOPS + 1
    assert got["ok"].final_url == f"{site}/chapter/2" and got["ok"].html == CHAPTER.format(2)
    port = site.rsplit(":", 1)[1]
    names = lambda h: ["127.0.0.1"] if h == "site.example" else [h]
    screen = live.Screen(allow_private_hosts=False, lookup=names)
    screen.known["site.example"] = ["127.0.0.1"]
    with pytest.raises(live.Refused) as refused:
        live.get(f"http://site.example:{port}/moved/private", screen, "a", 5)
    assert refused.value.reason == "private_address" and "169.254.169.254" in refused.value.detail


def test_failures_are_rows(spark, site):
    Site.fail = {"/chapter/1": 1, "/chapter/2": 5}
    got = load(spark, [f"{site}/chapter/1", f"{site}/chapter/2", f"{site}/slow", "http://127.0.0.1:9/none"], live.Manners(min_delay=0, max_delay=0, settle=0, timeout=1, retries=1, allow_private_hosts=True))
    assert got[f"{site}/chapter/1"].error is None and got[f"{site}/chapter/1"].attempts == 2
    assert got[f"{site}/chapter/2"].error == "error" and got[f"{site}/chapter/2"].attempts == 2
    assert got[f"{site}/slow"].error == "timeout" and got["http://127.0.0.1:9/none"].error == "error"


def test_pages_are_read_whole(spark, site):
    assert len(load(spark, [f"{site}/long"], live.Manners(min_delay=0, settle=0, allow_private_hosts=True))[f"{site}/long"].html) == 25_000_003


def test_requests_keep_their_distance(spark, site):
    manners = live.Manners(min_delay=0.1, max_delay=0.1, settle=0.0, concurrency=3, allow_private_hosts=True)
    delays = spark.createDataFrame([("127.0.0.1", 0.3)], "host string, crawl_delay double")
    began = time.time()
    since = spark.createDataFrame([("127.0.0.1", began + 1.0)], "host string, started_at double")
    load(spark, [f"{site}/chapter/{k}" for k in range(4)], manners, delays=delays, since=since)
    assert all(b - a >= 0.29 for a, b in zip(Site.times, Site.times[1:])) and len(Site.times) == 4 and Site.times[0] >= began + 1.29


def test_robots_are_asked_for(spark, site):
    origins = spark.createDataFrame([(site,), ("http://127.0.0.1:9",)], "origin string")
    got = live.fetched_robots(origins, QUICK).collect()
    texts = robots.documents(spark.createDataFrame(got, "origin string, status int, body binary, detail string")).collect()
    assert [(r.origin, r.content) for r in texts] == [(site, Site.robots)]
    assert {r.origin: bool(r.detail) for r in got} == {site: False, "http://127.0.0.1:9": True}
    Site.robots = "#" + "x" * 600_000
    assert len(live.fetched_robots(origins.limit(1), QUICK).first().body) == 512_000
    Site.robots = None
    none = live.fetched_robots(origins.limit(1), QUICK).first()
    assert none.status == 404 and none.detail == ""


def test_a_run_loads_its_pages(spark, site, tmp_path):
    out = f"{tmp_path}/out"
    args = ["--toc", f"{site}/toc", "--link", "ol.toc a", "--title", "h1.title", "--content", "article.reader", "--out", out, "--format", "text", "--format", "jsonl"]
    quick = ["--min-delay", "0.01", "--max-delay", "0.02", "--wait-after-load", "0", "--retries", "1", "--concurrency", "2", "--timeout", "4000", "--ua", "Reader/1.0"]
    assert cli.run(spark, [*args, *quick]) == 2 and not Site.asked
    args += [*quick, "--allow-private-hosts"]
    Site.fail = {"/chapter/2": 1, "/chapter/3": 9}
    assert cli.run(spark, args) == 1
    assert Site.agents == {"Reader/1.0"} and "/chapter/4" not in Site.asked and Site.asked["/chapter/3"] == 2
    lines = [json.loads(line) for line in open(f"{out}/manifest.jsonl")]
    assert [(x["type"], x.get("attempts")) for x in lines] == [("chapter", 1), ("chapter", 2), ("summary", None)]
    assert lines[0]["robots_allowed"] is True and lines[-1]["rejected"] == {"disallowed_scheme": 1, "robots_disallowed": 1} and lines[-1]["failed"][0]["reason"] == "error"
    Site.fail, Site.chapters = {}, 6
    Site.asked.clear()
    assert cli.run(spark, args) == 0
    assert {p for p in Site.asked if p.startswith("/chapter")} == {"/chapter/3", "/chapter/5", "/chapter/6"}
    assert open(f"{out}/combined.txt").read().count("-" * 80) == 5 and os.path.exists(f"{out}/003 - Chapter 3.txt")


def test_a_broken_run_resumes_where_it_ended(spark, site, tmp_path):
    settings = Settings(link="ol.toc a", title="h1.title", content="article.reader", out=f"{tmp_path}/out", min_delay=0, max_delay=0, wait_after_load=0, concurrency=1, allow_private_hosts=True)
    source = book.live_pages(settings)
    collected = book.collect_links(spark, source, f"{site}/toc", settings)
    store = state.Store(spark, f"{tmp_path}/out/.state")
    store.start("t", "f", {}, collected.kept)

    def breaking(links, since):
        if links.where("idx = 3").count():
            raise KeyboardInterrupt
        return source(links, since)

    with pytest.raises(KeyboardInterrupt):
        book.fetch(collected, breaking, settings, store)
    assert {r.idx for r in store.completed().collect()} == {1, 2} and os.path.exists(f"{tmp_path}/out/002 - Chapter 2.txt")
    Site.asked.clear()
    store.start("t", "f", {}, collected.kept)
    result = book.fetch(collected, source, settings, store)
    assert sum(Site.asked.values()) == 2 and result.skipped.count() == 2 and result.totals().first().completed == 2
    assert book.whole_book(result, store).where(F.col("from_checkpoint")).count() == 2


def test_a_book_that_lost_chapters_is_not_exported(spark, site, tmp_path):
    settings = Settings(link="ol.toc a", title="h1.title", content="article.reader", out=f"{tmp_path}/out", min_delay=0, max_delay=0, wait_after_load=0, allow_private_hosts=True)
    source = book.live_pages(settings)
    collected = book.collect_links(spark, source, f"{site}/toc", settings)
    store = state.Store(spark, f"{tmp_path}/out/.state")
    store.start("t", "f", {}, collected.kept)
    result = book.fetch(collected, source, settings, store)
    lost = book.Result(collected, result.completed.where("idx <> 2"), result.failed, result.collected.kept.where("idx = 2"))
    store.discard()
    store.start("t", "f", {}, collected.kept)
    with pytest.raises(book.IncompleteBook):
        book.whole_book(book.Result(collected, collected.kept.limit(0).join(store.completed().drop("idx"), "url"), lost.failed, lost.skipped), store)
