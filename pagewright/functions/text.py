"""Text columns: cleaning, trimming to bytes, file names and chapter renderings, all as JVM expressions but for NFC.

White space means the 29 code points that Unicode-aware tools outside the JVM take for it; Java's own `\\s` is narrower.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space, the marks of advertisements and links, characters no file name may hold, and size limits.
SPACE = r"\t\n\x0b\f\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS, NOT_WS = f"[{SPACE}]", f"[^{SPACE}]"
ADVERTISED = rf"(?iu)Ads by{WS}+[\p{{L}}\p{{N}}_]+"
SPONSORED = rf"(?iu)Sponsored{WS}+Content"
LINK = rf"https?://{NOT_WS}+"
FORBIDDEN = r"""[\\/:*?"<>|]+"""
NAME_CHARS, NAME_BYTES = 150, 255
UNTITLED = "untitled"
RULE = "-" * 80


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"\A{WS}+|{WS}+\z", "")


def without_ads(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, ADVERTISED, ""), SPONSORED, "")


def clean_text(text: Column, *, remove_links: bool = True, strip_ads: bool = True) -> Column:
    """Struct of the cleaned text and the number of links taken out; the steps' order decides the result."""
    body = without_ads(text) if strip_ads else text
    stripped = F.regexp_count(body, F.lit(LINK)) if remove_links else F.when(text.isNotNull(), F.lit(0))
    body = F.regexp_replace(body, LINK, "") if remove_links else body
    body = F.regexp_replace(body, rf"{WS}+\n", "\n")
    body = F.regexp_replace(body, rf"\n{WS}+", "\n")
    body = F.regexp_replace(body, r"\n{3,}", "\n\n")
    return F.struct(strip(body).alias("text"), stripped.cast("int").alias("stripped_urls"))


def truncate_utf8(text: Column, size: Column | int) -> Column:
    """The longest prefix of whole characters of at most `size` bytes.

    Where the cut falls inside a character, the bytes back to its lead byte go: a byte from 80 to BF continues one.
    """
    limit = F.lit(size) if isinstance(size, int) else size
    raw = F.encode(text, "UTF-8")
    at = lambda back: F.hex(F.substring(raw, limit + 1 - back, 1))
    inside = at(F.lit(0)).between("80", "BF")
    back = F.when(~inside, 0).when(at(F.lit(1)) >= "C0", 1).when(at(F.lit(2)) >= "C0", 2).otherwise(3)
    cut = F.decode(F.substring(raw, F.lit(1), limit - back), "UTF-8")
    return F.when(F.octet_length(text) <= limit, text).when(limit <= 0, F.lit("")).otherwise(cut)


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition, which the JVM functions lack; composed text passes through unread."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def name_key(text: pd.Series) -> pd.Series:
    """What a file system that ignores case compares."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t).casefold())


def or_untitled(text: Column) -> Column:
    return F.when(text == "", UNTITLED).otherwise(text)


def safe_filename(name: Column, *, max_chars: int = NAME_CHARS, max_bytes: Column | int = NAME_BYTES) -> Column:
    """One safe path component for a title."""
    out = strip(F.regexp_replace(nfc(name), r"[\t\n\r]", " "))
    out = F.regexp_replace(out, r"[\x00-\x1f\x7f]", "")
    out = F.regexp_replace(out, FORBIDDEN, "_")
    out = F.regexp_replace(out, f"{WS}+", " ")
    out = strip(F.regexp_replace(out, r"\A\.+", ""))
    return or_untitled(truncate_utf8(F.left(or_untitled(out), F.lit(max_chars)), max_bytes))


def escape_heading(title: Column) -> Column:
    return or_untitled(strip(F.regexp_replace(title, r"\A#+", "")))


def numbered(index: Column) -> Column:
    """At least three digits; more where needed."""
    return F.format_string("%03d", index)


def chapter_text(title: Column, text: Column, source: Column | None = None) -> Column:
    """A chapter as a text file; `source` adds its address."""
    return F.concat(title, F.lit("\n\n"), *([F.lit("Source: "), source, F.lit("\n\n")] if source is not None else []), text, F.lit("\n"))


def combined_chunk(title: Column, text: Column, source: Column | None = None) -> Column:
    """A chapter as a part of the combined text file."""
    return F.concat(chapter_text(title, text, source), F.lit(f"\n{RULE}\n\n"))


def chapter_markdown(title: Column, text: Column, source: Column | None = None) -> Column:
    head = [F.lit("# "), escape_heading(title), F.lit("\n\n")]
    return F.concat(*head, *([F.lit("[Source]("), source, F.lit(")\n\n")] if source is not None else []), text, F.lit("\n"))


def book_chunk(title: Column, text: Column, source: Column | None = None) -> Column:
    return F.concat(chapter_markdown(title, text, source), F.lit("\n"))


def described_rejection(value: Column, reason: Column, detail: Column) -> Column:
    """`value: reason (detail)`, without brackets where there is no detail."""
    return F.concat(value, F.lit(": "), reason, F.when(detail != "", F.concat(F.lit(" ("), detail, F.lit(")"))).otherwise(""))


def described_rule(directive: Column, value: Column, line: Column, agent: Column) -> Column:
    return F.format_string('"%s: %s" at robots.txt line %d (User-agent: %s)', directive, value, line, agent)


def log_line(level: Column, message: Column) -> Column:
    return F.when(level == "info", message).otherwise(F.concat(level, F.lit(": "), message))


def digests(text: Column) -> list[Column]:
    """bytes and sha256 of a text."""
    return [F.octet_length(text).cast("long").alias("bytes"), F.sha2(text.cast("binary"), 256).alias("sha256")]


def iso_time(at: Column) -> Column:
    """ISO 8601 with an offset; the fraction only where there is one."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssxxx")
    return F.when(F.date_format(at, "SSSSSS") == "000000", whole).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))
