"""Chapters: loading kept links, outcomes of attempts, records and failures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import markup
from pagewright.functions.text import clean_text, digests

# Outcomes that are never tried again: fixed values.
FINAL = ("selector_not_found", "not_a_string", "empty", "malformed", "disallowed_scheme", "missing_host", "unresolvable_host", "private_address", "robots_disallowed")
RETRIES = 2


def chapters(pages: DataFrame, title: str, content: str, *, url: str = "url", html: str = "html", strict_references: bool = False) -> DataFrame:
    """Adds title and body by their selectors, error and detail: selector_not_found where either matches nothing, error where
    the page could not be read. `strict_references` is that of the parser."""
    found = pages.withColumn("_f", markup.fields_in(F.col(html), strict_references=strict_references, title=title, body=content))
    missing = F.col("_f.title").isNull() | F.col("_f.body").isNull()
    error = F.when(F.col("_f.fault").isNotNull(), "error").when(missing, "selector_not_found")
    return found.select(*pages.columns, "_f.title", "_f.body", error.alias("error"), F.coalesce("_f.fault", F.lit("")).alias("detail"))


def stored(kept: DataFrame, pages: DataFrame, *, key: Sequence[str] = ("url",)) -> DataFrame:
    """Kept links (url, ...) with the final_url, html, attempts, error and detail of stored pages; a link without a page is an
    error.

    `key` names a page in both tables. Of several pages stored under one key the last by its source counts, so no link is
    multiplied; only pages that are asked for are compared.
    """
    final = F.coalesce("final_url", "url") if "final_url" in pages.columns else F.col("url")
    names = list(dict.fromkeys(key))
    asked = pages.withColumn("final_url", final).select(*names, "final_url", "html").join(kept.select(*names).distinct(), names, "left_semi")
    nth = F.row_number().over(Window.partitionBy(*names).orderBy(F.desc("html"), F.desc("final_url")))
    joined = kept.join(asked.withColumn("_n", nth).where("_n = 1").drop("_n"), names, "left")
    lost = F.col("html").isNull()
    return joined.withColumns({"attempts": F.lit(1), "error": F.when(lost, "error"), "detail": F.when(lost, "no such page").otherwise("")})


def read(loaded: DataFrame, title: str, content: str) -> DataFrame:
    """Loaded links (html, error, detail, ...) with title and body; the error of loading comes before that of reading. Pages
    are joined or loaded before their source is parsed, so only wanted ones are."""
    told = chapters(loaded.withColumnsRenamed({"error": "_error", "detail": "_detail"}), title, content)
    first = lambda c: F.when(F.col("_error").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c))
    return told.withColumns({"error": first("error"), "detail": first("detail")}).drop("html", "_error", "_detail")


def load(kept: DataFrame, pages: DataFrame, title: str, content: str, *, key: Sequence[str] = ("url",)) -> DataFrame:
    """Kept links read from stored pages."""
    return read(stored(kept, pages, key=key), title, content)


def outcomes(attempts: DataFrame, *, key: list[str], retries: int = RETRIES) -> DataFrame:
    """key, attempts, reason (null: success) from attempts (key, attempt, error): the first success, else the first error
    that is final, else the last one allowed."""
    ends = F.col("error").isNull() | F.col("error").isin(*FINAL) | (F.col("attempt") > retries)
    tried = attempts.withColumn("_ends", ends)
    first = F.min(F.when(F.col("_ends"), F.col("attempt")))
    done = tried.groupBy(*key).agg(
        F.coalesce(first, F.max("attempt")).alias("attempts"),
        F.coalesce(F.min_by(F.struct("error"), F.when(F.col("_ends"), F.col("attempt"))), F.max_by(F.struct("error"), "attempt")).alias("_last"),
    )
    return done.select(*key, "attempts", F.col("_last.error").alias("reason"))


def records(loaded: DataFrame, *, remove_links: bool = True, strip_ads: bool = True) -> DataFrame:
    """Chapters without error, cleaned, with bytes, sha256, redirected and stripped_urls."""
    good = loaded.where("error IS NULL").withColumn("_c", clean_text(F.col("body"), remove_links=remove_links, strip_ads=strip_ads))
    plain = good.withColumns({"text": F.col("_c.text"), "stripped_urls": F.col("_c.stripped_urls")}).drop("_c", "body", "error", "detail")
    return plain.select("*", *digests(F.col("text")), (F.col("url") != F.col("final_url")).alias("redirected"))


def failures(loaded: DataFrame) -> DataFrame:
    return loaded.where("error IS NOT NULL").select("idx", "url", F.col("error").alias("reason"), *(c for c in ("attempts", "detail") if c in loaded.columns))


def run_totals(kept: DataFrame, completed: DataFrame, failed: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row of counts; kept must be completed, failed or skipped."""
    from pagewright.operators.links import checked

    marks = [("kept", kept), ("completed", completed), ("failed", failed), ("skipped", skipped)]
    rows = None
    for name, df in marks:
        one = df.select(F.lit(name).alias("what"), (F.col("stripped_urls") if name == "completed" else F.lit(0)).cast("long").alias("stripped"))
        rows = one if rows is None else rows.unionByName(one)
    counts = rows.agg(*(F.count_if(F.col("what") == n).alias(n) for n, _ in marks), F.coalesce(F.sum("stripped"), F.lit(0)).alias("total_stripped_urls"))
    law = F.col("kept") == F.col("completed") + F.col("failed") + F.col("skipped")
    return counts.withColumn("kept", checked(F.col("kept"), law, "a chapter is not accounted for")).withColumn("attempted", F.col("completed") + F.col("failed"))


def latest(rows: DataFrame, *, key: str, order: str) -> DataFrame:
    """The last row of each key: an upsert where the newest write wins."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_n", nth).where("_n = 1").drop("_n")
