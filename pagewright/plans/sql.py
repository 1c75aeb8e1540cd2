"""DuckDB forms of the expressions, for the checks."""

from __future__ import annotations

from pagewright.functions.text import FORBIDDEN, SPACE

WS = f"[{SPACE}]"
GENERIC = r"\A(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    """An inline table of text, numbers and nulls."""
    one = lambda v: "NULL" if v is None else quoted(v) if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({columns})"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A{WS}+|{WS}+\z', '', 'g')"


def part(url: str, number: int) -> str:
    return f"regexp_extract({url}, '{GENERIC}', {number})"


def host(url: str) -> str:
    place = rf"regexp_replace({part(url, 2)}, '\A.*@', '')"
    return rf"lower(CASE WHEN starts_with({place}, '[') THEN regexp_extract({place}, '\A\[([^\]]*)\]', 1) ELSE regexp_extract({place}, '\A([^:]*)', 1) END)"


def origin(url: str) -> str:
    return f"(lower({part(url, 1)}) || '://' || {part(url, 2)})"


def normalize(url: str) -> str:
    path = rf"regexp_replace(regexp_replace({part(url, 3)}, ';[^/]*\z', ''), '/+\z', '')"
    query = part(url, 4)
    return (
        f"(CASE WHEN {part(url, 1)} <> '' THEN lower({part(url, 1)}) || ':' ELSE '' END || CASE WHEN {part(url, 2)} <> '' THEN '//' || lower({part(url, 2)}) ELSE '' END"
        f" || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END)"
    )


def percent_encoded(x: str) -> str:
    return rf"array_to_string(list_transform(string_split({x}, ''), lambda c: CASE WHEN ascii(c) < 128 THEN c ELSE regexp_replace(hex(c), '(..)', '%\1', 'g') END), '')"


def clean_text(x: str, remove_links: bool = True, strip_ads: bool = True) -> tuple[str, str]:
    """The cleaned text and the number of links removed."""
    body = rf"regexp_replace(regexp_replace({x}, '(?i)Ads by{WS}+[\p{{L}}\p{{N}}_]+', '', 'g'), '(?i)Sponsored{WS}+Content', '', 'g')" if strip_ads else x
    link = f"https?://[^{SPACE}]+"
    count = f"len(regexp_extract_all({body}, '{link}'))" if remove_links else "0"
    body = f"regexp_replace({body}, '{link}', '', 'g')" if remove_links else body
    body = rf"regexp_replace(regexp_replace(regexp_replace({body}, '{WS}+\n', chr(10), 'g'), '\n{WS}+', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(body), f"({count})::INTEGER"


def truncate_utf8(x: str, size: str) -> str:
    """The longest prefix whose bytes fit, by trying each length from the number of characters that always fit."""
    return f"CASE WHEN strlen({x}) <= {size} THEN {x} ELSE left({x}, list_max(list_filter(range(0, {size}::BIGINT + 1), lambda k: strlen(left({x}, k)) <= {size}))::BIGINT) END"


def safe_filename(x: str, max_bytes: str = "255") -> str:
    out = strip(rf"regexp_replace(nfc_normalize({x}), '[\t\n\r]', ' ', 'g')")
    out = rf"regexp_replace({out}, '[\x00-\x1f\x7f]', '', 'g')"
    out = f"regexp_replace({out}, {quoted(FORBIDDEN)}, '_', 'g')"
    out = f"regexp_replace({out}, '{WS}+', ' ', 'g')"
    out = strip(rf"regexp_replace({out}, '\A\.+', '')")
    named = f"left(CASE WHEN {out} = '' THEN 'untitled' ELSE {out} END, 150)"
    return f"(SELECT CASE WHEN z = '' THEN 'untitled' ELSE z END FROM (SELECT {truncate_utf8('y', max_bytes)} AS z FROM (SELECT {named} AS y)))"


def inner_text(x: str) -> str:
    """Lines of visible text, for markup without nested unseen elements."""
    shown = f"regexp_replace({x}, '<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'gs')"
    broken = f"regexp_replace({shown}, '</?(p|h1|br|div|ul|ol|li|nav|article|footer|section)[^>]*>', chr(10), 'g')"
    plain = f"regexp_replace(regexp_replace({broken}, '<[^>]*>', '', 'g'), '[ \\t\\r\\f]+', ' ', 'g')"
    lines = f"list_filter(list_transform(string_split({plain}, chr(10)), lambda l: trim(l, ' ')), lambda l: l <> '')"
    joined = f"array_to_string({lines}, chr(10))"
    return f"replace(replace(replace(replace({joined}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


PAGE_LINKS = rf"""
hrefs AS (
  SELECT page_id, url AS base, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), 'href="([^"]*)"', 1) AS h FROM pages),
raw_links AS (
  SELECT page_id, base, unnest(h) AS href, unnest(range(len(h)))::INTEGER AS pos FROM hrefs),
followed AS (
  SELECT page_id, base, pos, {origin('base')} || {percent_encoded("replace(href, '&amp;', '&')")} AS url FROM raw_links)"""

ACCOUNTED = rf"""{PAGE_LINKS},
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS nth FROM followed),
ranked AS (
  SELECT *, CASE WHEN nth = 1 THEN row_number() OVER (PARTITION BY page_id, nth = 1 ORDER BY pos) END AS idx FROM numbered),
accounted AS (
  SELECT page_id, pos, url, idx, CASE WHEN nth > 1 THEN 'rejected' WHEN idx > 5 THEN 'truncated' ELSE 'kept' END AS status FROM ranked)"""
