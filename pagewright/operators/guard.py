"""Vetting of addresses before anything is loaded from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import urls
from pagewright.functions.text import strip

# Reasons for which a link is not followed: fixed values, written into manifests.
REASONS = (
    "not_a_string", "empty", "malformed", "disallowed_scheme", "missing_host", "unresolvable_host", "private_address",
    "robots_disallowed", "duplicate",
)
SCHEMES = ("http", "https")
DNS_SCHEMA = "host string, ord int, address string"


def _verdict(reason: str, detail: Column | str = "") -> Column:
    return F.struct(F.lit(reason).alias("reason"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))


def _shape(url: Column, kind: Column | None) -> Column:
    """What the text alone shows, cheapest test first: a struct (reason, detail), null if it passes. Reads the columns of `_parts`."""
    first = F.when(kind.isNotNull(), _verdict("not_a_string", F.concat(F.lit("got "), kind))).when if kind is not None else F.when
    found, place = F.col("_scheme"), F.col("_place")
    verdict = first(url == "", _verdict("empty")).when(place.contains("[") != place.contains("]"), _verdict("malformed", "Invalid IPv6 URL"))
    verdict = verdict.when(~found.isin(*SCHEMES), _verdict("disallowed_scheme", F.when(found == "", "(none)").otherwise(found)))
    return verdict.when(F.col("_host") == "", _verdict("missing_host"))


def answers(dns: DataFrame) -> DataFrame:
    """One row a host: the first private address among its answers, if any."""
    private = urls.private_address(F.col("address"))
    return (
        dns.where(F.col("address").isNotNull()).withColumn("private", private)
        .groupBy(F.lower("host").alias("_host")).agg(F.min_by(F.when(F.col("private"), F.col("address")), F.when(F.col("private"), F.col("ord"))).alias("_private_answer"))
    )


def vet(links: DataFrame, dns: DataFrame | None = None, *, url: str = "url", kind: str | None = None, allow_private_hosts: bool = False) -> DataFrame:
    """Adds reason and detail (null reason: allowed) and strips the url.

    Names are looked up in `dns` (host, ord, address); one without a row is unresolvable. Without a table no name is
    looked up and only literal addresses are judged. The lookup joins one row for each distinct host.
    """
    # One column a step: each part is worked out once, and later steps name it.
    parts = links.withColumn(url, strip(F.col(url))).withColumns({"_scheme": urls.scheme(F.col(url)), "_place": urls.netloc(F.col(url)), "_host": urls.host(F.col(url))})
    shaped = parts.withColumn("_v", _shape(F.col(url), F.col(kind) if kind else None)).drop("_scheme", "_place")
    if not allow_private_hosts:
        shaped = shaped.withColumn("_host", F.when(F.col("_v").isNull(), F.col("_host")))
        shaped = shaped.withColumns({"_literal": urls.is_address(F.col("_host")), "_private": urls.private_address(F.col("_host"))})
        literal = F.col("_literal")
        verdict = F.when(F.col("_v").isNotNull(), F.col("_v")).when(literal & F.col("_private"), _verdict("private_address", F.col("_host")))
        if dns is not None:
            shaped = shaped.join(answers(dns).withColumn("_known", F.lit(True)), "_host", "left")
            verdict = (
                verdict.when(~literal & F.col("_known").isNull(), _verdict("unresolvable_host", F.col("_host")))
                .when(~literal & F.col("_private_answer").isNotNull(), _verdict("private_address", F.concat("_host", F.lit(" -> "), "_private_answer")))
            )
        shaped = shaped.withColumn("_v", verdict)
    told = {"reason": F.col("_v.reason"), "detail": F.coalesce("_v.detail", F.lit(""))}
    return shaped.withColumns(told).drop("_v", "_host", "_literal", "_private", "_known", "_private_answer")
