"""From index pages to accounted links: every raw link ends as kept, rejected for a named reason, or truncated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import markup, urls
from pagewright.operators import guard, robots

MAX_LINKS = 20


def raw_links(pages: DataFrame, selector: str, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, base, pos, href of every link the selector matches, in document order; the source is read once by the parser.

    Links count from the page's address, or from what its `<base>` names, counted from the address itself.
    """
    found = pages.select(key, F.col(url).alias("base"), markup.links_in(F.col(html), selector).alias("_links"))
    based = found.withColumn("base", F.when(F.col("_links.base").isNull(), F.col("base")).otherwise(urls.resolve(F.col("base"), F.col("_links.base"))))
    # The outer form, as the plain one would test the parsed links in a filter of its own, and so parse each page twice.
    return based.select(key, "base", F.posexplode_outer("_links.hrefs").alias("pos", "href")).where("pos IS NOT NULL")


def resolved(links: DataFrame) -> DataFrame:
    """Adds url: the link as followed from its base."""
    return links.withColumn("url", urls.resolve(F.col("base"), F.col("href")))


def account(
    links: DataFrame, *, dns: DataFrame | None = None, robots_txt: DataFrame | None = None, agent: str = robots.AGENT, authenticated: bool = False,
    allow_private_hosts: bool = False, maximum: int = MAX_LINKS, key: str = "page_id", kind: str | None = None, scope: str = "link",
) -> DataFrame:
    """key, pos, url, status, reason, detail, idx of every raw link (key, pos, url; base for scope "toc").

    Order: guard, repeats, robots, truncation. A repeat of a link that robots forbid so is a repeat. `scope` says whose
    robots rules apply: each link's own origin, or that of the index page for all its links.
    """
    # One exchange by the index page serves both numberings and the totals; a page's links come from one row anyway.
    vetted = guard.vet(links, dns, kind=kind, allow_private_hosts=allow_private_hosts).repartition(key)
    passed = F.col("reason").isNull()
    # Links without a text to compare keep to themselves, so that no value repeats another's reason.
    nth = F.row_number().over(Window.partitionBy(key, F.col("url"), passed).orderBy("pos"))
    vetted = vetted.withColumn("reason", F.when(passed & (nth > 1), F.lit("duplicate")).otherwise(F.col("reason")))
    if robots_txt is not None:
        own = urls.origin(F.col("base")) if scope == "toc" else urls.origin(F.col("url"))
        asked = vetted.where(passed).withColumns({"id": F.xxhash64(own, "url"), "_origin": own})
        decided = robots.decide(asked.select("id", "url", "_origin").distinct(), robots_txt, agent=agent, authenticated=authenticated, origin=F.col("_origin"))
        vetted = vetted.withColumn("id", F.when(passed, F.xxhash64(own, "url"))).join(decided, "id", "left").drop("id")
        barred = passed & ~F.coalesce("robots_allowed", F.lit(True))
        vetted = vetted.withColumn("detail", F.when(barred, F.col("robots_rule")).otherwise(F.col("detail"))).withColumn("reason", F.when(barred, F.lit("robots_disallowed")).otherwise(F.col("reason")))
    kept = F.row_number().over(Window.partitionBy(key, F.col("reason").isNull()).orderBy("pos"))
    out = vetted.withColumn("idx", F.when(F.col("reason").isNull(), kept))
    status = F.when(F.col("reason").isNotNull(), "rejected").when(F.col("idx") > maximum, "truncated").otherwise("kept")
    extra = ["robots_rule", "robots_override"] if robots_txt is not None else []
    return out.withColumn("status", status).select(key, "pos", "url", "status", "reason", "detail", F.when(F.col("status") == "kept", F.col("idx")).alias("idx"), *extra)


def totals(accounted: DataFrame, key: str = "page_id") -> DataFrame:
    """raw, kept, rejected, truncated of each index page; a row that does not add up fails the run."""
    counted = accounted.groupBy(key).agg(F.count(F.lit(1)).alias("raw"), *(F.count_if(F.col("status") == s).alias(s) for s in ("kept", "rejected", "truncated")))
    return counted.withColumn("raw", checked(F.col("raw"), F.col("raw") == F.col("kept") + F.col("rejected") + F.col("truncated"), "a link is not accounted for"))


def checked(value: Column, law: Column, message: str) -> Column:
    """The value, if the law holds; an error otherwise. Keeps the check in the plan of what is used."""
    return F.when(law, value).otherwise(F.raise_error(F.lit(message)).cast("bigint"))


def rejected_by_reason(accounted: DataFrame) -> DataFrame:
    return accounted.where("status = 'rejected'").groupBy("reason").agg(F.count(F.lit(1)).alias("links")).orderBy("reason")


def first_seen(links: DataFrame, *, key: str, value: str = "url", order: str = "pos") -> DataFrame:
    """Adds duplicate: whether an earlier row of the key has the same value."""
    nth = F.row_number().over(Window.partitionBy(key, value).orderBy(order))
    return links.withColumn("duplicate", nth > 1)


def dry_run(accounted: DataFrame, key: str = "page_id") -> DataFrame:
    """What would be loaded: one numbered line for each kept link."""
    return accounted.where("status = 'kept'").select(key, "idx", F.format_string("%03d  %s", "idx", "url").alias("line"))
