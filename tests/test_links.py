"""Resolution, vetting, robots and accounting of links."""

import ipaddress

import pytest
from pyspark.sql import functions as F

from pagewright.functions import markup, urls
from pagewright.operators import guard, links, robots

ROBOTS = "# comment line\nUser-agent: *\nDisallow: /private/\nCrawl-delay: 4\n\nUser-agent: Reader\nDisallow: /members/\nAllow: /members/public/\n"


def account(spark, raw, **how):
    rows = [(1, "https://example.com/toc", i, None if not isinstance(v, str) else v, None if isinstance(v, str) else type(v).__name__) for i, v in enumerate(raw)]
    df = spark.createDataFrame(rows, "page_id int, base string, pos int, url string, kind string")
    return links.account(df, kind="kind", **how)


def test_every_link_is_accounted_for(spark):
    good = "https://example.com/ch/"
    raw = [good + "1", good + "2", {}, None, "file:///etc/passwd", "javascript:alert(1)", "", good + "1", "http://127.0.0.1/admin"]
    out = account(spark, raw)
    total = links.totals(out).first()
    assert (total.raw, total.kept, total.rejected, total.truncated) == (9, 2, 7, 0)
    assert {r.reason: r.links for r in links.rejected_by_reason(out).collect()} == {"not_a_string": 2, "disallowed_scheme": 2, "empty": 1, "duplicate": 1, "private_address": 1}
    total = links.totals(account(spark, [f"{good}{i}" for i in range(10)], maximum=3)).first()
    assert (total.kept, total.truncated, total.rejected) == (3, 7, 0)


def test_robots_come_after_repeats(spark):
    policy = spark.createDataFrame([("https://example.com", "User-agent: *\nDisallow: /no\n")], "origin string, content string")
    out = account(spark, ["https://example.com/no/1", "https://example.com/no/1", "https://example.com/yes"], robots_txt=policy, scope="toc")
    got = [(r.status, r.reason) for r in out.orderBy("pos").collect()]
    assert got == [("rejected", "robots_disallowed"), ("rejected", "duplicate"), ("kept", None)]
    kept = account(spark, ["https://example.com/no/1"], robots_txt=policy, authenticated=True).first()
    assert kept.status == "kept" and kept.robots_override and "line 2" in kept.robots_rule


@pytest.mark.parametrize("agent, path, allowed, line", [("Reader", "/chapter/1", True, None), ("Reader", "/members/secret", False, "line 7"), ("Reader", "/private/x", True, None), ("Someone", "/private/x", False, "line 3")])
def test_robots_table(spark, agent, path, allowed, line):
    policy = spark.createDataFrame([("https://e.com", ROBOTS)], "origin string, content string")
    one = spark.createDataFrame([(1, "https://e.com" + path), (2, "https://none.com" + path)], "id int, url string")
    got = {r.id: r for r in robots.decide(one, policy, agent=agent).collect()}
    assert got[1].robots_allowed == allowed and (line is None) == (got[1].robots_rule is None) and (line is None or line in got[1].robots_rule)
    assert got[2].robots_allowed
    delay = {r.crawl_delay for r in robots.crawl_delays(robots.parse(policy), agent).collect()}
    assert delay == ({4.0} if agent == "Someone" else set())


def test_robots_fetch_results(spark):
    fetched = spark.createDataFrame([("a", 200, bytearray(b"User-agent: *\xff")), ("b", 404, bytearray(b"x"))], "origin string, status int, body binary")
    got = robots.documents(fetched).collect()
    assert len(got) == 1 and got[0].content.startswith("User-agent: *")


ADDRESSES = ["0.1.2.3", "10.0.0.1", "127.1.1.1", "100.64.0.1", "169.254.1.1", "172.15.0.1", "172.16.0.1", "172.32.0.1", "192.0.0.8", "192.0.0.9", "192.0.0.170", "192.0.2.1", "192.88.99.1", "192.168.0.1", "198.17.0.1", "198.19.0.1", "198.51.100.1", "203.0.113.1", "223.255.255.255", "224.0.0.1", "240.0.0.1", "255.255.255.255", "8.8.8.8", "::1", "fe80::1", "2001:4860::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "ff02::1", "fd00::1"]


def test_private_addresses_agree_with_the_library(spark):
    df = spark.createDataFrame([(a,) for a in ADDRESSES], "a string")
    got = {r.a: r.p for r in df.select("a", urls.private_address(F.col("a")).alias("p")).collect()}
    for a in ADDRESSES:
        ip = ipaddress.ip_address(a)
        ip = getattr(ip, "ipv4_mapped", None) or ip
        assert got[a] == (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified), a


def test_normal_forms(spark):
    same = [("https://e.com/ch/1/", "https://e.com/ch/1"), ("https://e.com/1#part2", "https://e.com/1"), ("https://EXAMPLE.com/x", "https://example.com/x"), ("HTTPS://e.com/", "https://e.com")]
    df = spark.createDataFrame(same, "a string, b string").select(urls.normalize(F.col("a")).alias("a"), urls.normalize(F.col("b")).alias("b"))
    assert all(r.a == r.b for r in df.collect())
    odd = spark.createDataFrame([("https://e.com/a?x=1",), ("https://e.com/a?x=2",)], "u string").select(urls.normalize(F.col("u")).alias("u")).distinct()
    assert odd.count() == 2


def test_resolution(spark):
    df = spark.createDataFrame([("https://e.com/b/toc", h) for h in ("ch/1", "/für", "//o.org/x", "../up", "https://z.org/", None, "?q=1", "#f")], "base string, href string").withColumn("pos", F.monotonically_increasing_id())
    got = [r.url for r in links.resolved(df).orderBy("pos").collect()]
    assert got == ["https://e.com/b/ch/1", "https://e.com/f%C3%BCr", "https://o.org/x", "https://e.com/up", "https://z.org/", None, "https://e.com/b/toc?q=1", "https://e.com/b/toc#f"]


def test_selectors():
    root = markup.parse('<ol class="toc"><li><a href="1">One</a><li class="x"><a href="2" data-k="ab cd">Two</a></ol><svg><a xlink:href="3">s</a></svg><div id="d"><p>a <b>b</b><br>c<script>no</script><p hidden>h</div>')
    pick = lambda s: [markup.inner_text(n) for n in markup.select(root, s)]
    assert pick("ol.toc a") == ["One", "Two"] and pick("ol > li.x > a[href]") == ["Two"] and pick("li:first-child a, li:nth-child(2) a") == ["One", "Two"]
    assert pick('a[data-k~="cd"]') == ["Two"] and pick("li + li a") == ["Two"] and pick("#d") == ["a b\nc"] and pick(".none") == []
    with pytest.raises(ValueError):
        markup.select(root, "a:hover(")


def test_guard_keeps_every_reason_known():
    assert len(set(guard.REASONS)) == 9


def test_longer_addresses_agree_with_the_library(spark):
    import random

    rng, texts = random.Random(1), []
    for _ in range(1500):
        groups = [rng.choice([0, 0, 0, 1, 0xFFFF, 0x2001, 0x2002, 0xDB8, 0xFE80, 0xFEC0, 0x112, 0x20, 0x3F, rng.randrange(65536)]) for _ in range(8)]
        if rng.random() < 0.7:
            groups[0] = rng.choice([0x2001, 0x2002, 0xFE80, 0xFEC0, 0xFC00, 0xFF02, 0x64, 0x100, 0, rng.randrange(65536)])
        if rng.random() < 0.2:
            groups[:6] = [0, 0, 0, 0, 0, 0xFFFF]
        ip = ipaddress.IPv6Address(b"".join(g.to_bytes(2, "big") for g in groups))
        texts.append(rng.choice([str(ip), ip.exploded]))
    texts += ["::", "1:2", "::1%eth0", ":::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "::1.2.3.4", "::ffff:300.0.0.1", "12345::", "g::", "64:ff9b::8.8.8.8", "1::2::3", ":1", ":"]
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    assert [r.a for r in df.select("a", urls.private_address(F.col("a")).alias("p")).collect() if r.p != urls.not_public(r.a)] == []


RESOLVED = [
    ("a//b", "https://e.com/b/a//b"), ("../../../x", "https://e.com/x"), ("a/./b/../c", "https://e.com/b/a/c"), ("/a/../b", "https://e.com/b"), ("..", "https://e.com/"), ("a/..", "https://e.com/b/"), ("", "https://e.com/b/toc?q=1"),
    ("?", "https://e.com/b/toc?"), ("a?b=../c", "https://e.com/b/a?b=../c"), ("a#../b", "https://e.com/b/a#../b"), ("javascript:alert(1)", "javascript:alert(1)"), ("https:foo", "https://e.com/b/foo"), ("  x\n", "https://e.com/b/x"),
    ("..;x", "https://e.com/b/..;x"), ("...", "https://e.com/b/..."), ("é?ü#ö", "https://e.com/b/%C3%A9?%C3%BC#%C3%B6"), ("mailto:a@b", "mailto:a@b"), ("//h", "https://h"),
]


def test_references_as_a_browser_follows_them(spark):
    df = spark.createDataFrame([("https://e.com/b/toc?q=1#f", r) for r, _ in RESOLVED], "b string, r string")
    assert {r.r: r.u for r in df.select("r", urls.resolve(F.col("b"), F.col("r")).alias("u")).collect()} == dict(RESOLVED)


@pytest.mark.parametrize("source", ["<![x[y]]>a", "<![foo bar>a", "<![CDATA[x]]>a", "<!x>a", "<?x>a", "</>a", "<p <b>a</p>"])
def test_odd_declarations_are_comments(source):
    assert markup.inner_text(markup.parse(source)) == "a"


def test_many_siblings_and_deep_pages():
    import time

    began = time.process_time()
    root = markup.parse("<ul>" + "<li><a href=x>a</a>" * 40_000)
    assert len(markup.select(root, "ul li + li a")) == 39_999 and len(markup.select(root, "li ~ li:last-child > a")) == 1
    markup.parse("<p><div>" * 30_000)
    assert time.process_time() - began < 10


def test_links_count_from_the_base(spark):
    pages = spark.createDataFrame([(1, "https://e.com/x/", '<base href="../deep/y"><a href="1">'), (2, "https://e.com/x/", '<a href="1"><base href="https://o.org/d/"><base href="/no/">'), (3, "https://e.com/x/", '<a href="1">'), (4, "https://e.com/", None)], "page_id int, url string, html string")
    got = {r.page_id: r.url for r in links.resolved(links.raw_links(pages, "a")).collect()}
    assert got == {1: "https://e.com/deep/1", 2: "https://o.org/d/1", 3: "https://e.com/x/1"}


def test_a_page_that_cannot_be_read_is_a_reason(spark):
    from pagewright.operators import records

    pages = spark.createDataFrame([("u", "<h1>t</h1><p>b")], "url string, html string")
    assert records.chapters(pages, "h1", "p").first().error is None
    deep = spark.createDataFrame([("u", "<h1>t</h1>"), ("v", None)], "url string, html string")
    assert {r.url: (r.error, r.detail) for r in records.chapters(deep, "h1", "p").collect()} == {"u": ("selector_not_found", ""), "v": ("selector_not_found", "")}
