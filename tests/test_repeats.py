"""Addresses that several pages or moves share, and references cut off, against the queries' SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from pagewright.functions import markup
from pagewright.operators import records
from pagewright.sources import pages as page_sources

NAV = "<nav><ul>{}</ul></nav>"


def page(url, links, heading, body="<p>one</p>"):
    items = "".join(f'<li><a href="/en/{k}">x</a></li>' for k in range(links))
    return url, f"<html><head><title>t</title></head><body>{NAV.format(items)}<article><h1>{heading}</h1>{body}</article></body></html>"


PAGES = [
    page("https://a.example/en/1", 6, "First"), page("https://a.example/en/1", 2, "Second"), page("https://a.example/en/1", 6, "First"), page("https://b.example/en/2?page=2", 6, "Third"),
    page("https://b.example/en/2?page=2", 1, "Fourth"), page("https://b.example/en/3#top", 3, "Fifth"), page("https://b.example/en/3#top", 7, "Sixth"), page("https://c.example/en/4", 6, "Last"),
    page("https://d.example/en/5", 6, "cut &amp;&amp;&amp", "<p>x &am; &a y &amp;lt; &quo</p><p>&lt;&amp</p>"), page("https://d.example/en/6", 6, "cut &quot", "<p>one &amp;copy and &lt</p>"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("repeats"))
    spark.createDataFrame([(k, *p) for k, p in enumerate(PAGES)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


def same(spark, folder, name):
    got = entry.queries()[name](spark, folder)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
        told = db.sql(entry.oracle_sql()[name])
        assert got.columns == told.columns and sorted(map(tuple, got.collect())) == sorted(told.fetchall())


def test_accounting_of_addresses_with_several_pages(spark, folder):
    same(spark, folder, "run_accounting")


def test_each_page_of_an_address_is_loaded_once(spark, folder):
    same(spark, folder, "loaded_chapters")


def test_several_stored_pages_multiply_no_link(spark):
    kept = spark.createDataFrame([(1, "u"), (2, "v"), (3, "w")], "idx int, url string")
    pages = spark.createDataFrame([("u", "a"), ("u", "b"), ("u", "b"), ("v", None), ("v", "c"), ("x", "d")], "url string, html string")
    assert sorted((r.idx, r.html, r.error) for r in records.stored(kept, pages).collect() if r.html) == [(1, "b", None), (2, "c", None)]
    assert [(r.idx, r.error, r.detail) for r in records.stored(kept, pages).where("html IS NULL").collect()] == [(3, "error", "no such page")]


def test_pages_of_an_address_follow_their_own_redirects(spark, folder):
    same(spark, folder, "redirect_guarded")


def test_several_moves_multiply_no_link(spark):
    links = spark.createDataFrame([("https://e.com/a",), ("https://e.com/p",)], "url string")
    moves = [("https://e.com/a", "/c"), ("https://e.com/a", "/b"), ("https://e.com/a", "/b"), ("https://e.com/b", None), ("https://e.com/p", "/a"), ("https://e.com/p", "http://10.0.0.1/")]
    got = page_sources.follow_redirects(links, spark.createDataFrame(moves, "url string, location string")).collect()
    assert sorted((r.url, r.final_url, r.hops, r.blocked_reason) for r in got) == [("https://e.com/a", "https://e.com/b", 1, None), ("https://e.com/p", "https://e.com/p", 0, "private_address")]


def test_references_that_were_cut_off():
    source = "<h1>a &amp;&amp &lt;b&gt; &#65;&#x42; &#67 &copy;&copy AT&T &</h1><script>x && y</script>"
    assert markup.inner_text(markup.parse(source)) == "a && <b> AB C \xa9\xa9 AT&T &"
    assert markup.inner_text(markup.parse(source, strict_references=True)) == "a &&amp <b> AB &#67 \xa9&copy AT&T &"


def test_chapters_with_references_cut_off(spark, folder):
    same(spark, folder, "extract_chapter")


def test_books_of_markdown_with_references_cut_off(spark, folder):
    same(spark, folder, "book_markdown")


def test_chapter_files_with_references_cut_off(spark, folder):
    same(spark, folder, "chapter_file_digests")


def test_markdown_files_with_references_cut_off(spark, folder):
    same(spark, folder, "chapter_markdown_files")


def test_combined_texts_with_references_cut_off(spark, folder):
    same(spark, folder, "combined_text")


def test_malformed_pages_with_references_cut_off(spark, folder):
    same(spark, folder, "malformed_chapters")


def test_manifests_with_references_cut_off(spark, folder):
    same(spark, folder, "manifest_lines")


def test_resumed_manifests_with_references_cut_off(spark, folder):
    same(spark, folder, "resumed_manifest_lines")
