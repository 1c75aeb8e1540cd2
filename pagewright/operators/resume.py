"""Resuming: what a stored run means for the links of today."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import urls

COMPARISONS = ("identical", "grew_at_end", "grew_at_start", "diverged")


def fingerprint(normal_toc_url: str, link: str, title: str, content: str) -> str:
    """Names the extraction (address and selectors), not the links, so that growth does not change it."""
    told = {"content": content, "link": link, "title": title, "toc_url": normal_toc_url}
    return hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()


def compare(stored: Column, current: Column) -> Column:
    """How an array of links relates to the stored one, both normalised: equal, more at the end, more at the start, or
    something that cannot be told apart from a reordering. A stored array without links equals any."""
    n, m = F.size(stored), F.size(current)
    head = F.slice(current, F.lit(1), F.greatest(n, F.lit(1)))
    tail = F.slice(current, F.greatest(m - n, F.lit(0)) + 1, F.greatest(n, F.lit(1)))
    return (
        F.when((n == 0) | (stored == current), "identical").when(m < n, "diverged")
        .when(head == stored, "grew_at_end").when(tail == stored, "grew_at_start").otherwise("diverged")
    )


def link_lists(links: DataFrame, *, key: str, order: str = "pos", url: str = "url") -> DataFrame:
    """key and its normalised links in order, as an array."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), urls.normalize(F.col(url)).alias("u"))))
    return links.groupBy(key).agg(F.transform(packed, lambda x: x["u"]).alias("links"))


def compare_tables(stored: DataFrame, current: DataFrame, *, key: str) -> DataFrame:
    """key, comparison of every index page in the current table."""
    old, new = link_lists(stored, key=key).withColumnRenamed("links", "old"), link_lists(current, key=key).withColumnRenamed("links", "new")
    return new.join(old, key, "left").select(key, compare(F.coalesce("old", F.array().cast("array<string>")), F.col("new")).alias("comparison"))


def pending(kept: DataFrame, completed: DataFrame, *, normalised: bool = False) -> DataFrame:
    """Kept links that are not completed yet; equal as texts, or by their normal form."""
    return _against(kept, completed, "left_anti", normalised)


def skipped(kept: DataFrame, completed: DataFrame, *, normalised: bool = False) -> DataFrame:
    return _against(kept, completed, "left_semi", normalised)


def appended(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Links of today whose normal form is not among the stored ones."""
    return _against(current, stored, "left_anti", True)


def _against(left: DataFrame, right: DataFrame, how: str, normalised: bool) -> DataFrame:
    form = urls.normalize if normalised else (lambda c: c)
    known = right.select(form(F.col("url")).alias("_u")).distinct()
    return left.withColumn("_u", form(F.col("url"))).join(known, "_u", how).drop("_u")


def divergence(stored: DataFrame, current: DataFrame, *, key: str) -> DataFrame:
    """key, missing, added, first_missing: how many links each side lacks, and the first stored one that is gone."""
    old, new = (df.select(key, "pos", "url", urls.normalize(F.col("url")).alias("_u")) for df in (stored, current))
    gone = old.join(new.select(key, "_u").distinct(), [key, "_u"], "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("missing"), F.min_by("url", "pos").alias("first_missing"))
    come = new.join(old.select(key, "_u").distinct(), [key, "_u"], "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("added"))
    keys = old.select(key).union(new.select(key)).distinct()
    counted = keys.join(gone, key, "left").join(come, key, "left")
    return counted.select(key, F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("added", F.lit(0)).alias("added"), F.coalesce("first_missing", F.lit("")).alias("first_missing"))


def refusal(missing: Column, added: Column, first_missing: Column) -> Column:
    """Why a diverged run is not resumed, in a sentence."""
    gone = F.when(missing > 0, F.format_string("%d stored links are gone, the first is %s; ", missing, first_missing)).otherwise("")
    more = F.when(added > 0, F.format_string("%d links are new; ", added)).otherwise("")
    order = F.when((missing == 0) & (added == 0), "the order of links has changed; ").otherwise("")
    return F.concat(gone, more, order, F.lit("use --force to start over"))


def plan(stored_fingerprint: str, wanted_fingerprint: str, comparison: str, completed: int, force: bool = False) -> dict[str, object]:
    """Whether the stored run can be used, and whether its chapters must be numbered anew."""
    if force:
        return {"usable": False, "discard": True, "comparison": comparison, "already_done": 0, "renumbering": False}
    same = stored_fingerprint == wanted_fingerprint
    told = comparison if same else "diverged"
    return {"usable": told != "diverged", "discard": False, "comparison": told, "already_done": completed, "renumbering": told == "grew_at_start" and completed > 0}


def next_index(completed: DataFrame, key: list[str] = ()) -> DataFrame:
    """The number that follows the completed chapters', over all of them or by key."""
    return completed.groupBy(*key).agg((F.coalesce(F.max("idx"), F.lit(0)) + 1).alias("next_index"))


def merge_prior(current: DataFrame, prior: DataFrame, *, key: list[str]) -> DataFrame:
    """Chapters of this run and, for addresses it did not load, those of the stored run, marked from_checkpoint.

    Keyed by address, not by number: a chapter put in front of the others must not hide a stored one.
    """
    old = prior.join(current.select(*key).distinct(), key, "left_anti")
    return current.withColumn("from_checkpoint", F.lit(False)).unionByName(old.withColumn("from_checkpoint", F.lit(True)), allowMissingColumns=True)


def incomplete(expected: DataFrame, written: DataFrame) -> DataFrame:
    """Addresses on one side only: url, side ("expected" or "written"). No rows: complete."""
    return expected.select("url").exceptAll(written.select("url")).withColumn("side", F.lit("expected")).unionByName(
        written.select("url").exceptAll(expected.select("url")).withColumn("side", F.lit("written"))
    )
