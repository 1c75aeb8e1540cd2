"""Rendering, search and fixity on small tables."""

import collections
import random
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import fixity, vector_search
from pagewright.llm.html_layout import extract, render

PAGES = [
    ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div>b</div>", "a\nb"), ("a<br>b", "a\nb"), ("  a \n b  ", "a b"), ("x &amp; y &lt;", "x & y <"), ("", ""), (None, None),
    ("<head><title>t</title></head><script>var a='</p>';</script>v<style>p{}</style>", "v"), ("<p hidden>h</p><p style='display: none'>i</p>v", "v"),
    ("<style>.no,#d{display:none} nav{visibility:hidden}</style><i class='a no'>1</i><i id=d>2</i><nav>3</nav>4", "4"),
    ("<ul><li>a<li>b<ol start=3><li>c</ol></ul>t", "- a\n- b\n  3. c\n\nt"), ("<table><tr><th>N<th>Q<tr><td>long name<td>3</table>", "N          Q\nlong name  3"),
    ("<table><tbody><tr><td>a</td><td></td></tr></tbody><tr><td>b<p>c<td>d</table>z", "a\nb c  d\n\nz"), ("<pre>a  b\n  c</pre>d", "a  b\n  c\n\nd"), ("<blockquote>q</blockquote>r", "  q\n\nr"),
    ("a<!-- no -->b<!-- open", "ab"), ("<b>a<i>b</b>c</i></div></p>d", "abcd"), ("<dl><dt>t<dd>d</dl>", "t\n  d"), ("1 < 2 <3", "1 < 2 <3"), ("<h1>T</h1>x<hr>y", "T\n\nx\n\ny"), ("<textarea><b>raw", "<b>raw"),
    ("<template>n</template><svg>s</svg><noscript>n</noscript>o", "o"),
]


@pytest.mark.parametrize("html, text", PAGES)
def test_render(html, text):
    assert render(html) == text


@pytest.mark.parametrize("css, seen", [
    ("@media print { nav, .x {display:none} }", True), ("@media (max-width:600px){.x{display:none}}", True),
    ("@media screen and (min-width: 40em){.x{display:none}}", False), ("@media not print{.x{display:none}}", False),
    ("@media print{@media all{.x{display:none}}} .y{}", True), ("@media unheard-of{.x{display:none}}", True),
    ("@import url('a;b'); .x{display:none}", False), ("@supports (display:grid){.x{display:none}}", False), ("@keyframes k{.x{display:none}}", True),
    (".x{display:none} .x{display:block}", True), (".x{display:block} .x{display:none}", False), (".x{display:none!important} .x{display:block}", False),
    (".x{display:none} p{display:block}", False), ("p{display:none} .x{display:block}", True), (".x{visibility:hidden;display:block}", False),
    (".x{display:none} .x{visibility:visible}", False), (".x{display:none} @media print{.x{display:block}}", False), ("/* .x{display:none} */", True),
    (".x{display:none} @media print{.y{color:red}", False), (".x{content:'}'; display:none", False), ("P{display:none}", False),
])
def test_style_sheets_apply_as_on_a_screen(css, seen):
    assert render(f"<style>{css}</style><p class=x>text</p>rest") == ("text\n\nrest" if seen else "rest")
    assert render(f"<style media=print>.x{{display:none}}</style><p class=x>text</p>") == "text"
    assert render("<style>.x{display:none}</style><p class=x style='display:block'>text</p>") == "text"


@pytest.mark.parametrize("html, text", [
    ("<div>" * 400 + "<p hidden>SECRET</p>seen", "seen"), ("<div hidden/>SECRET</div>seen", "seen"), ("<a href=x/>in</a> out", "in out"),
    ("<div class=a/b/>in</div>out", "in\nout"), ('a<a "b', "a"), ("a<p title='b>c", "a"), ("a<p title='>'>b", "a\n\nb"), ("a<b x=1 x=2/ y = '3'>c</b>", "ac"),
    ("<textarea>a &amp; b</textarea>", "a & b"), ("<title>t &amp; u</title>v", "v"), ("x<!-->y<!-- z --->w", "xyw"), ("a</>b</ c>d<?e>f<!g>h", "abdfh"), ("<plaintext>a<b>", "a<b>"),
    ("<table><tr><td colspan=2>wide one<td>c<tr><td>a<td>b<td>c</table>", "wide one  c\na  b      c"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"), ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a  b\n   c\n   d"),
    ("<table><tbody><tr><td rowspan=9>a<td>b<tbody><tr><td>c<td>d</table>", "a  b\nc  d"), ("<table><tr><td colspan=900000000>a<tr><td>b<td>c</table>", "a\nb  c"),
    ("<table><tr><td>x<td><ul><li>a<li>b</ul><td>y</table>", "x  - a  y\n   - b"), ("<table><tr><td>o<td><table><tr><td>i<td>j<tr><td>kk<td>l</table></table>", "o  i   j\n   kk  l"),
    ("<ul><li><ol><li>a<li>b</ol></ul>", "- 1. a\n  2. b"), ("<ol><li>a<li value=7>b<li>c</ol>", "1. a\n7. b\n8. c"), ("<li>a<ul><li><table><tr><td><li>b</table></ul>", "a\n\n- b"),
    ("<b><p>one</b> two</p>three", "one two\n\nthree"), ("<noscript><div></noscript>seen", "seen"), ("<template><table><td></template>seen", "seen"), ("<button><div>x</button>y", "x\ny"), ("<svg><g/><text>s</svg>t", "t"),
    ("<details><summary>S</summary>closed</details><details open><summary>T</summary>o</details>", "S\nT\no"), ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"), ("<input value=v><input type=hidden value=h><input type=password value=p>", "v"),
    ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b>no</div>", "yes"), ("<pre>\na\r\n b</pre>", "a\n b"), ("<p hidden style='display:block'>a</p>b", "a\n\nb"),
])
def test_render_as_a_browser_shows(html, text):
    assert render(html) == text


@pytest.mark.parametrize("part", ['<a "', "<a b='", "<style \"", "<!--", "</", "<p", "<b><p></b>", "<div><button><p>", "<li><ul>", "<blockquote>a", "<ul><li>a", "<table><tr><td>", "<table><td colspan=1000 rowspan=65534>", "<tr><td rowspan=3>a", "<span></p>", "&amp", "<td style='display:none'>", "<svg>"])
def test_time_grows_with_the_page(part):
    markup = "<table>" * part.startswith("<tr") + part * (400_000 // len(part))
    began = time.process_time()
    render(markup)
    assert time.process_time() - began < 8


def plain_page(rng, depth=0):
    """A random well-formed part of a page and, by its own account, the lines a reader sees: (gap before and after, lines)."""
    word = lambda: " ".join("w%d" % rng.randrange(99) for _ in range(rng.randrange(1, 4)))
    kind = rng.choice(["p", "div", "hidden", "ul", "table", "pre", "quote"]) if depth < 3 else rng.choice(["p", "div", "pre"])
    if kind in ("p", "pre"):
        text = word()
        return f"<{kind}>{'<b>' + text + '</b>' if rng.random() < 0.3 else text}</{kind}>", [(2, [text])]
    if kind == "hidden":
        return f"<{rng.choice(['div hidden', 'p style=display:none', 'div class=off'])}>{word()}</{'div'}>".replace("<p style=display:none>", "<div style=display:none>"), []
    if kind == "table":
        cells = [[word() if rng.random() < 0.8 else "" for _ in range(3)] for _ in range(rng.randrange(1, 4))]
        widths = [max(len(r[k]) for r in cells) for k in range(3)]
        lines = ["  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in cells if any(r)]
        return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in cells) + "</table>", [(2, lines)] if lines else [(2, [])]
    inner = [plain_page(rng, depth + 1) for _ in range(rng.randrange(1, 4))]
    if kind == "ul":
        items = [(word(), plain_page(rng, 9) if rng.random() < 0.3 else ("", [])) for _ in range(rng.randrange(1, 4))]
        out = []
        for text, (_, more) in items:
            out.append("- " + text)
            for _, lines in more:
                out += ["", *("  " + x for x in lines)] if lines and _ == 2 else ["  " + x for x in lines]
        # What follows an item's paragraph keeps its distance.
        return None, (items, out)
    html = "".join(h for h, _ in inner if h is not None)
    blocks = [b for h, bs in inner if h is not None for b in bs]
    if kind == "quote":
        return f"<blockquote>{html}</blockquote>", [(2, [])] + [(g, ["  " + x for x in lines]) for g, lines in blocks] + [(2, [])]
    return f"<div>{html}</div>", [(1, [])] + blocks + [(1, [])]


def laid(blocks):
    lines, due = [], 0
    for gap, part in blocks:
        due = max(due, gap)
        for k, line in enumerate(part):
            if lines and (due > 1 if k == 0 else False):
                lines.append("")
            lines.append(line)
        if part:
            due = gap
    return "\n".join(lines)


@pytest.mark.parametrize("seed", range(40))
def test_generated_pages(seed):
    rng = random.Random(seed)
    parts = [p for p in (plain_page(rng) for _ in range(6)) if p[0] is not None]
    got = render("<style>.off{display:none}</style>" + "".join(h for h, _ in parts))
    assert got == laid([b for _, bs in parts for b in bs])


def test_deep_and_long_pages():
    assert render("<div>" * 50_000 + "x").strip() == "x"
    assert len(render("<p>word " * 40_000).split()) == 40_000


def test_extract(spark):
    df = spark.createDataFrame([(1, "<p>a", "t"), (1, "<p>a", "t"), (None, None, None)], "page_id long, html string, text string")
    assert sorted(map(str, extract(df).collect())) == sorted(["Row(page_id=1, text='a')"] * 2 + ["Row(page_id=None, text=None)"])
    assert extract(df.limit(0)).count() == 0


def plain_search(rows, top, step):
    usable = [(i, np.floor(np.array(v, float) * 256).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    width = max((len(v) for _, v in usable), default=0)
    usable = [(i, np.pad(v, (0, width - len(v)))) for i, v in usable]
    out = []
    for q in sorted({i for i, _ in usable if i % step == 0}):
        v = min((v for i, v in usable if i == q), key=lambda x: x.tobytes())
        found = sorted((-int(v @ w), i) for i, w in usable if i != q)[:top]
        out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(found)]
    return out


def search(spark, rows, **how):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int")
    return sorted(tuple(r) for r in vector_search.search(df, **how).collect())


def test_search_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=8) / 2]) for k in range(700)]
    rows += [(1000 + k, rows[50][1]) for k in range(60)]  # ties beyond k
    rows += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (None, [1.0] * 8), (2004, [1.0, 2.0]), (2005, []), (50, rows[50][1])]
    assert search(spark, rows) == plain_search(rows, 5, 50)
    monkeypatch.setattr(vector_search.lay_out, "__defaults__", (8 * 8 * 20,))
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 2)
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 7)
    assert search(spark, rows, top=3) == plain_search(rows, 3, 50)
    assert search(spark, rows[:3]) == plain_search(rows[:3], 5, 50) and search(spark, []) == [] and search(spark, [(0, [1.0])]) == []


def test_large_components_stay_exact():
    big = np.array([[2.0**29, 3.0], [2.0**29, 4.0]])
    assert vector_search.products(big.astype(np.int64), big.astype(np.int64))[0, 1] == 2**58 + 12
    scores = np.array([[5, 5, 5, 1] * 20])
    got, ids = vector_search.best(scores, np.arange(80)[None, ::-1], 5)
    assert got.tolist() == [[5] * 5] and ids.tolist() == [[1, 2, 3, 5, 6]]


def test_huge_vectors_take_no_part_and_large_ones_tie_right(spark):
    rows = [(0, [1e30, 0.0]), (1, [1e30, 1.0]), (50, [1.0, 1.0]), (51, [2.0, 2.0]), (100, [3e38, -3e38])]
    assert search(spark, rows) == plain_search(rows[2:4], 5, 50)
    # Scores beyond 2**53 that differ in their last bits.
    large = [(50 * k, [float(2**21), float(k)]) for k in range(6)] + [(7 + k, [float(2**21), float(k % 3)]) for k in range(6)]
    assert search(spark, large) == plain_search(large, 5, 50)


def records(spark, rows):
    return spark.createDataFrame([(i, r, "x") for i, r in rows], "page_id long, record string, hash string")


def audit(spark, held, replica):
    return {(r.page_id, r.kind): (r.held_offset, r.replica_offset) for r in fixity.audit(records(spark, held), records(spark, replica)).collect()}


def test_fixity(spark):
    rng = random.Random(6)
    held = [(k, "r" * rng.randrange(1, 30) + str(k)) for k in range(2300)]
    held += [(None, "none"), (7, "again"), (7, "again"), (5000, None), (-3, "below")]
    assert audit(spark, held, held[::-1]) == {}
    replica = [(i, r) for i, r in held if i != 1500]
    replica = [(i, "damaged" if i in (0, 999, 2299) else r) for i, r in replica] + [(2600, "new")]
    got = audit(spark, held, replica)
    assert set(got) == {(0, "damaged"), (999, "damaged"), (2299, "damaged"), (1500, "missing"), (2600, "extra")}
    before = sum(len(r) for i, r in held if i is not None and 1000 <= i < 1500)
    assert got[1500, "missing"][0] == before
    assert len(audit(spark, held[:20], [])) == 20 and audit(spark, [], []) == {}


def stored(spark, rows):
    side = fixity.leaves(records(spark, rows)).withColumn("replica", F.lit(False))
    return {r["file"]: r for r in fixity.trees(fixity.placed(side, fixity.crowded(side))).collect()}


def test_only_damaged_branches_differ(spark):
    held = [(k, f"record {k}") for k in range(3000)]
    ours, theirs = stored(spark, held), stored(spark, [(k, r if k != 1234 else "a longer broken one") for k, r in held])
    assert [f for f in ours if ours[f]["hash"] != theirs[f]["hash"]] == [1]
    a, b = ours[1], theirs[1]
    for place in (2, 23):
        kids = [(x, y) for x, y in zip(a["kids"], b["kids"]) if x["hash"] != y["hash"]]
        assert [(x["at"], y["at"]) for x, y in kids] == [(place, place)]
        a, b = kids[0]
    moved = [x["at"]["page_id"] for x, y in zip(a["kids"], b["kids"]) if x != y]
    assert moved == [1234, 1235, 1236, 1237, 1238, 1239]


def plain_audit(held, replica):
    """kind, id, content and copies by comparing multisets; ids of more copies than share a file are not paired."""
    left = collections.Counter(held), collections.Counter(replica)
    lost, found = left[0] - left[1], left[1] - left[0]
    out = collections.Counter()
    for i in {i for i, _ in [*lost, *found]}:
        n, m = (sum(k for (j, _), k in side.items() if j == i) for side in (lost, found))
        out[i] = n, m
    return out


def test_many_records_of_one_id(spark):
    import hashlib

    a, b, d, c = sorted((f"record {k}" for k in range(4)), key=lambda r: hashlib.sha256(r.encode()).hexdigest())
    for one, other in (([a, b, b, c], [a, d, d, c]), ([a, b], [b, d]), ([a, a, a], [a]), ([], [a, b])):
        sides = [[(5, r) for r in side] for side in (one, other)]
        got = fixity.audit(*(records(spark, s) for s in sides)).collect()
        lost, found = plain_audit(*sides).get(5, (0, 0))
        kinds = collections.Counter(r.kind for r in got)
        assert kinds == collections.Counter({k: n for k, n in (("damaged", min(lost, found)), ("missing", max(0, lost - found)), ("extra", max(0, found - lost))) if n})
        assert all(r.copies == 1 and r["file"] == 0 for r in got)


def test_crowded_ids_have_files_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(fixity, "RECORDS_A_FILE", 100)
    monkeypatch.setattr(fixity, "FANOUT", 5)
    rng = random.Random(2)
    held = [(None, f"n{rng.randrange(400)}") for _ in range(900)] + [(7, "same")] * 300 + [(k, f"r{k}") for k in range(50)]
    assert audit(spark, held, held[::-1]) == {}
    replica = [*held[3:], (None, "new"), (7, "same"), (7, "other")]
    replica.remove((None, held[400][1]))
    lost, found = plain_audit(held, replica)[None]
    got = fixity.audit(records(spark, held), records(spark, replica)).collect()
    sums = collections.Counter()
    for r in got:
        assert r["file"] is None and (r.held_sha256 is None) == (r.kind == "extra") and (r.replica_sha256 is None) == (r.kind == "missing")
        sums[r.page_id, r.kind] += r.copies
    assert sums[None, "damaged"] + sums[None, "missing"] == lost and sums[None, "damaged"] + sums[None, "extra"] == found
    assert sums[7, "extra"] == 2 and set(sums) <= {(None, "damaged"), (None, "missing"), (None, "extra"), (7, "extra")}


def test_warc_records(spark):
    row = spark.createDataFrame([(1, "http://e", "é"), (None, None, None)], "p long, u string, h string").select(fixity.warc_record(F.col("p"), F.col("u"), F.col("h")).alias("r")).collect()
    assert "Content-Length: 2\r\n\r\né\r\n\r\n" in row[0].r
    for r in row:
        head = dict(line.split(": ", 1) for line in r.r.split("\r\n\r\n")[0].split("\r\n")[1:])
        assert r.r.startswith("WARC/1.0\r\n") and set(head) >= {"WARC-Type", "WARC-Date", "WARC-Record-ID", "Content-Length"}
        assert uuid.UUID(head["WARC-Record-ID"][1:-1].removeprefix("urn:uuid:")).version == 3
