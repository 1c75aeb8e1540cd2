"""Cleaning, trimming and naming against tables and an independent form in the standard library."""

import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import text as T

CASES = [
    ("", "", 0), ("   \n\t  \n  ", "", 0), ("Chapter text.\nAds by PubRev\nMore text.", "Chapter text.\nMore text.", 0),
    ("Text.\nADS BY SomeVendor\nsponsored   content\nEnd.", "Text.\nEnd.", 0), ("Before. Ads by Vendor. After.", "Before. . After.", 0),
    ("Ads by Big Ad Network here", "Ad Network here", 0), ("AdsbyVendor stays intact", "AdsbyVendor stays intact", 0), ("Sponsored\nContent removed", "removed", 0),
    ("See https://example.com/page. Next sentence.", "See  Next sentence.", 1), ("a https://a.com b http://b.com c", "a  b  c", 2), ("ftp://example.com survives", "ftp://example.com survives", 0),
    ("a\n\n\nb", "a\nb", 0), ("a\r\nb\r\n\r\n\r\nc", "a\nb\nc", 0), ("a\xa0b\n\xa0c", "a\xa0b\nc", 0), ("Read this:\n\nhttps://example.com/a\n\n\nThen this.", "Read this:\nThen this.", 1),
]


def test_clean_text_table(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    got = {r.i: (r.c.text, r.c.stripped_urls) for r in rows.select("i", T.clean_text(F.col("t")).alias("c")).collect()}
    assert [got[i] for i in range(len(CASES))] == [(c[1], c[2]) for c in CASES]


def plain_clean(value, remove_links, strip_ads):
    n = 0
    if strip_ads:
        value = re.sub(r"Sponsored\s+Content", "", re.sub(r"Ads by\s+\w+", "", value, flags=re.I), flags=re.I)
    if remove_links:
        value, n = re.subn(r"https?://\S+", "", value)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"\n\s+", "\n", re.sub(r"\s+\n", "\n", value))).strip(), n


SPACES = [c for c in map(chr, range(0x3001)) if c.isspace()]
PARTS = st.lists(st.sampled_from([*SPACES, "Ads by ", "ads BY\x1c", "Sponsored", "content", "http://x", "https://y.z/é", "word", "_", "é", "\n", "\n\n", "."]), max_size=14)


@settings(max_examples=3, deadline=None)
@given(st.lists(PARTS, min_size=40, max_size=80))
def test_clean_text_agrees_with_the_standard_library(spark, lists):
    texts = ["".join(p) for p in lists]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for links in (True, False):
        for ads in (True, False):
            got = {r.i: (r.c.text, r.c.stripped_urls) for r in rows.select("i", T.clean_text(F.col("t"), remove_links=links, strip_ads=ads).alias("c")).collect()}
            assert [got[i] for i in range(len(texts))] == [plain_clean(t, links, ads) for t in texts]


@pytest.mark.parametrize("value, limit, expected", [("abc", 10, "abc"), ("abc", 3, "abc"), ("abc", 2, "ab"), ("章章章", 9, "章章章"), ("章章章", 8, "章章"), ("章章章", 3, "章"), ("章章章", 2, ""), ("🙂🙂", 7, "🙂"), ("é🙂", 5, "é"), ("a", 0, "")])
def test_truncate_utf8(spark, value, limit, expected):
    assert spark.createDataFrame([(value,)], "t string").select(T.truncate_utf8(F.col("t"), limit)).first()[0] == expected


NAMES = [
    ("", "untitled"), ("   ", "untitled"), ("Chapter\tOne\nPart\rTwo", "Chapter One Part Two"), ("a\\b/c:d*e?f\"g<h>i|j", "a_b_c_d_e_f_g_h_i_j"), ("a////////b", "a_b"), ("///", "_"),
    ("x" * 151, "x" * 150), ("Café Chapter", unicodedata.normalize("NFC", "Café Chapter")), (".hidden chapter", "hidden chapter"), ("...three dots", "three dots"), ("章" * 120, "章" * 85),
    ("🙂" * 100, "🙂" * 63), ("Chapter\x00One\x07Two", "ChapterOneTwo"), ("Chapter 1: The Beginning", "Chapter 1_ The Beginning"),
]


def test_safe_filename(spark):
    rows = spark.createDataFrame([(i, n[0]) for i, n in enumerate(NAMES)], "i int, t string")
    got = {r.i: r.n for r in rows.select("i", T.safe_filename(F.col("t")).alias("n")).collect()}
    assert [got[i] for i in range(len(NAMES))] == [n[1] for n in NAMES]


def test_renderings(spark):
    row = spark.createDataFrame([("## T ", "B.", "http://f")], "t string, b string, u string")
    t, b, u = (F.col(c) for c in "tbu")
    got = row.select(T.chapter_text(t, b, u), T.combined_chunk(t, b), T.chapter_markdown(t, b, u), T.book_chunk(t, b), T.numbered(F.lit(1234)), T.log_line(F.lit("warning"), b), T.described_rejection(u, F.lit("empty"), F.lit(""))).first()
    assert got[0] == "## T \n\nSource: http://f\n\nB.\n" and got[1].endswith("B.\n\n" + "-" * 80 + "\n\n")
    assert got[2] == "# T\n\n[Source](http://f)\n\nB.\n" and got[3] == "# T\n\nB.\n\n" and got[4] == "1234" and got[5] == "warning: B." and got[6] == "http://f: empty"
