"""Resuming, naming, pacing, outcomes, exports, state and whole runs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pagewright import cli
from pagewright.operators import filenames, records, resume, runlog, schedule
from pagewright.sinks import exporters
from pagewright.sources import pages as page_sources
from pagewright.sources import state
from pagewright.sources.profile import ProfileError, load_profile, merged
from pagewright.streaming import incremental


@pytest.mark.parametrize("stored, current, expected", [("abc", "abc", "identical"), ("abc", "abcde", "grew_at_end"), ("abc", "xyabc", "grew_at_start"), ("abc", "xabcy", "diverged"), ("abc", "ab", "diverged"), ("abc", "acbd", "diverged"), ("", "ab", "identical")])
def test_comparison(spark, stored, current, expected):
    row = spark.createDataFrame([(list(stored), list(current))], "s array<string>, c array<string>")
    assert row.select(resume.compare(F.col("s"), F.col("c"))).first()[0] == expected


def test_prepended_chapter_hides_nothing(spark):
    now = spark.createDataFrame([("new", 1)], "url string, idx int")
    old = spark.createDataFrame([("first", 1), ("new", 2)], "url string, idx int")
    got = {(r.url, r.from_checkpoint) for r in resume.merge_prior(now, old, key=["url"]).collect()}
    assert got == {("new", False), ("first", True)}


@pytest.mark.parametrize("titles, expected", [
    ([(1, "Ch"), (1, "CH"), (1, "ch")], ["001 - Ch.txt", "001 - CH (2).txt", "001 - ch (3).txt"]),
    ([(7, "A//B"), (7, "A/B")], ["007 - A_B.txt", "007 - A_B (2).txt"]),
    ([(1, "Ch (2)"), (1, "Ch"), (1, "ch")], ["001 - Ch (2).txt", "001 - Ch.txt", "001 - ch (3).txt"]),
    ([(1, "a"), (2, "a")], ["001 - a.txt", "002 - a.txt"]),
])
def test_allocation(spark, titles, expected):
    rows = spark.createDataFrame([("o", k, i, t) for k, (i, t) in enumerate(titles)], "o string, k int, idx int, title string")
    got = filenames.allocate(rows, output="o", order=["k"]).orderBy("k").collect()
    assert [r.name for r in got] == expected


def test_long_names_stay_in_bounds(spark):
    rows = spark.createDataFrame([("o", k, 1, "章" * 120) for k in range(3)], "o string, k int, idx int, title string")
    names = [r.name for r in filenames.allocate(rows, output="o", order=["k"]).collect()]
    assert len(set(names)) == 3 and all(len(n.encode()) <= 255 for n in names)


def test_pacing(spark):
    rows = spark.createDataFrame([("h", i, 0.0) for i in range(10)] + [("g", 10, 3.0), ("g", 11, 10.0)], "host string, id int, arrival double")
    got = {r.id: r.start for r in schedule.starts(rows, host="host", arrival="arrival", order=["arrival", "id"], interval=F.lit(2.0)).collect()}
    assert [got[i] for i in range(10)] == [2.0 * i for i in range(10)] and got[10] == 3.0 and got[11] == 10.0
    hosts = spark.createDataFrame([("h",), ("g",)], "host string")
    delays = spark.createDataFrame([("h", 4.0), ("g", 0.1)], "host string, crawl_delay double")
    assert {r.host: r.interval for r in schedule.effective_intervals(hosts, delays).collect()} == {"h": 4.0, "g": 1.2}


@pytest.mark.parametrize("span", [1, 7, 10_000])
def test_pacing_is_a_fold_for_any_ranges(spark, span):
    import random

    rng = random.Random(span)
    asked = [("ab"[rng.randrange(2)], k, float(rng.choice([0, 3, rng.randrange(60)]))) for k in range(80)]
    want, last = {}, {}
    for host, k, arrival in sorted(asked, key=lambda r: (r[2], r[1])):
        want[k] = arrival if host not in last else max(arrival, last[host] + 2.0)
        last[host] = want[k]
    rows = spark.createDataFrame(asked, "host string, id int, arrival double")
    got = schedule.starts(rows, host="host", arrival="arrival", order=["arrival", "id"], interval=F.lit(2.0), span=span)
    assert {r.id: r.start for r in got.collect()} == want and got.columns == [*rows.columns, "start", "waited"]
    before: dict[str, float] = {}
    gaps = {}
    for host, k, arrival in sorted(asked, key=lambda r: (r[2], r[1])):
        gaps[k] = arrival - before[host] if host in before else None
        before[host] = arrival
    assert {r.id: r.gap for r in schedule.gaps(rows, host="host", at="arrival", order=["arrival", "id"], span=span).collect()} == gaps


def test_paced_stream_keeps_state(spark, tmp_path):
    rows = [("h", 1, 0.0), ("h", 2, 0.0), ("h", 3, 9.0)]
    for k, row in enumerate(rows):
        spark.createDataFrame([row], "host string, id long, arrival double").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("host string, id long, arrival double").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    starts: dict[int, float] = {}
    query = incremental.available_now(incremental.paced(stream, 2.0), lambda batch, n: starts.update({r.id: r.start for r in batch.collect()}), f"{tmp_path}/state")
    query.awaitTermination()
    assert sorted(starts.values()) in ([0.0, 2.0, 9.0], [0.0, 9.0, 11.0], [9.0, 11.0, 13.0])


def test_outcomes(spark):
    tries = [("a", 1, "timeout"), ("a", 2, None), ("b", 1, "selector_not_found"), ("c", 1, "error"), ("c", 2, "error"), ("c", 3, "timeout"), ("c", 4, None), ("d", 1, "error")]
    got = {r.url: (r.attempts, r.reason) for r in records.outcomes(spark.createDataFrame(tries, "url string, attempt int, error string"), key=["url"]).collect()}
    assert got == {"a": (2, None), "b": (1, "selector_not_found"), "c": (3, "timeout"), "d": (1, "error")}


def test_phases(spark):
    events = spark.createDataFrame([(1, 1, "phase", "launching"), (1, 2, "phase", "done"), (2, 1, "phase", "browsing")], "run int, seq int, kind string, state string")
    assert {(r.run, r.before, r.phase) for r in runlog.illegal(events).collect()} == {(1, "launching", "done"), (2, "idle", "browsing")}


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_moves_are_carried_over_ranges(spark, span):
    states = ["launching", "browsing", "failed", "idle", "launching", "done", "idle"]
    events = spark.createDataFrame([(r, 2 * k + r, "phase" if k != 3 else "chapter", s) for r in (1, 2) for k, s in enumerate(states)], "run int, seq int, kind string, state string")
    kept = [s for k, s in enumerate(states) if k != 3]
    got = {(r.run, r.seq): (r.before, r.phase) for r in runlog.moves(events, span).collect()}
    assert [got[key] for key in sorted(got) if key[0] == 2] == list(zip(["idle", *kept], kept)) and len(got) == 12


def test_growing_pages_are_told_from_diverged_ones(spark):
    stored = spark.createDataFrame([(1, 0, "https://e.com/a"), (2, 0, "https://e.com/a"), (3, 0, "https://e.com/a")], "page_id int, pos int, url string")
    today = spark.createDataFrame([(1, 0, "https://e.com/a"), (1, 1, "https://e.com/b"), (2, 0, "https://e.com/x"), (3, 0, "https://e.com/a")], "page_id int, pos int, url string")
    going, refused = incremental.growth_guard(stored, "page_id")(today)
    assert {(r.page_id, r.comparison) for r in going.collect()} == {(1, "grew_at_end"), (3, "identical")} and [r.page_id for r in refused.collect()] == [2]


def test_redirects_are_vetted(spark):
    links = spark.createDataFrame([("https://e.com/a",), ("https://e.com/p",), ("https://e.com/loop",), ("https://e.com/f",)], "url string")
    moves = spark.createDataFrame([("https://e.com/a", "/b"), ("https://e.com/b", "https://e.com/c"), ("https://e.com/p", "http://169.254.169.254/"), ("https://e.com/loop", "/loop"), ("https://e.com/f", "file:///etc/passwd")], "url string, location string")
    got = {r.url: r for r in page_sources.follow_redirects(links, moves, hops=3).collect()}
    assert got["https://e.com/a"].final_url == "https://e.com/c" and got["https://e.com/a"].hops == 2
    assert got["https://e.com/p"].blocked_reason == "private_address" and got["https://e.com/f"].blocked_reason == "disallowed_scheme"
    assert got["https://e.com/loop"].blocked_reason == "too_many_redirects"


def test_profile(tmp_path):
    path = tmp_path / "p.toml"
    path.write_text('[selectors]\nlink = "a"\n[options]\nmax = 25\nformats = ["text", "jsonl"]\n')
    assert merged(load_profile(path), {"max": 20}).max == 20 and merged(load_profile(path), {}).formats == ("text", "jsonl")
    for bad in ("[other]\n", "[options]\nwhat = 1\n", '[options]\nmax = "1"\n', "[options]\nmax = true\n", '[options]\nformats = ["pdf"]\n', "["):
        path.write_text(bad)
        with pytest.raises(ProfileError):
            load_profile(path)
    assert merged({}, {"concurrency": 0, "retries": -1, "max_delay": 0.5}).clamped().concurrency == 1


def test_damaged_files_are_named(spark):
    recorded = spark.createDataFrame([("a", ""), ("b", "00"), ("c", "")], "name string, output_sha256 string")
    files = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"x"))], "name string, content binary")
    assert {(r.name, r.fault) for r in exporters.damaged(recorded, files).collect()} == {("b", "changed"), ("c", "missing")}


def _book(spark, path, n, first=1):
    items = "".join(f'<li><a href="chapter/{i}.html">C{i}</a>' for i in range(first, n + 1))
    rows = [("https://e.com/toc", f'<ol class="toc">{items}<li><a href="javascript:x">bad</a></ol>')]
    rows += [(f"https://e.com/chapter/{i}.html", f'<h1 class="title">Chapter {i}</h1><article class="reader"><p>Body {i}. https://x.org/{i}</article>') for i in range(first, n + 1) if i != 3]
    spark.createDataFrame(rows, "url string, html string").write.mode("overwrite").parquet(path)


def test_run_and_resume(spark, tmp_path):
    pages, out = f"{tmp_path}/pages", f"{tmp_path}/out"
    args = ["--pages", pages, "--toc", "https://e.com/toc", "--link", "ol.toc a", "--title", "h1.title", "--content", "article.reader", "--out", out, "--format", "text", "--format", "jsonl", "--format", "markdown"]
    _book(spark, pages, 2)
    assert cli.run(spark, [*args, "--dry-run"]) == 0 and not os.path.exists(out)
    assert cli.run(spark, args) == 0
    assert open(f"{out}/001 - Chapter 1.txt").read() == "Chapter 1\n\nBody 1.\n"
    assert open(f"{out}/combined.txt").read().count("-" * 80) == 2 and "# Chapter 2" in open(f"{out}/book.md").read()
    lines = [json.loads(line) for line in open(f"{out}/manifest.jsonl")]
    assert [x["type"] for x in lines] == ["chapter", "chapter", "summary"] and lines[-1]["rejected"] == {"disallowed_scheme": 1} and lines[0]["stripped_urls"] == 1
    _book(spark, pages, 4)
    assert cli.run(spark, args) == 1  # chapter 3 has no page
    lines = [json.loads(line) for line in open(f"{out}/manifest.jsonl")]
    assert [x.get("from_checkpoint", False) for x in lines[:-1]] == [True, True, False] and lines[-1]["failed"][0]["reason"] == "error"
    assert open(f"{out}/combined.txt").read().count("-" * 80) == 3
    _book(spark, pages, 4, first=2)
    assert cli.run(spark, args) == 2 and state.Store(spark, f"{out}/.state").header().number == 2
    assert cli.run(spark, [*args[:-2], "--link", "ol a"]) == 2
    assert cli.run(spark, ["--pages", pages, "--toc", "file:///x", *args[4:]]) == 2
    assert cli.run(spark, [*args, "--out", "hdfs://somewhere/out"]) == 2
    (tmp_path / "out/.state/state.json").write_text("{broken")
    assert state.Store(spark, f"{out}/.state").header() is None


def test_changed_files_are_refused(spark, tmp_path):
    pages, out = f"{tmp_path}/pages", f"{tmp_path}/out"
    args = ["--pages", pages, "--toc", "https://e.com/toc", "--link", "ol.toc a", "--title", "h1.title", "--content", "article.reader", "--out", out]
    _book(spark, pages, 2)
    assert cli.run(spark, args) == 0 and cli.run(spark, args) == 0
    file = f"{out}/001 - Chapter 1.txt"
    kept = open(file).read()
    open(file, "w").write("changed")
    assert cli.run(spark, args) == 1 and open(file).read() == "changed"
    os.remove(file)
    assert cli.run(spark, args) == 1
    assert cli.run(spark, [*args, "--force"]) == 0 and open(file).read() == kept
