"""Stored pages, and redirects as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import urls
from pagewright.operators import guard

HOPS = 20


def table(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages (url, html, and final_url where redirects were followed)."""
    return spark.read.parquet(path)


def follow_redirects(links: DataFrame, redirects: DataFrame, dns: DataFrame | None = None, *, key: Sequence[str] = (), hops: int = HOPS, allow_private_hosts: bool = False) -> DataFrame:
    """Adds final_url, hops, blocked_reason, blocked_url by following redirects (url, location), each hop vetted.

    The first hop that is not allowed blocks the page and is named. More than `hops` hops, loops among them, block it as
    well. One join a hop, over the links still moving.

    `key` are columns of both tables by which moves belong to links, as when each page was seen to move on its own. An
    address of one key makes one move: of several the first by its text, those that are not allowed before others.
    """
    keys = {c: f"_key{n}" for n, c in enumerate(key)}
    to = redirects.select(*(F.col(c).alias(k) for c, k in keys.items()), F.col("url").alias("_at"), urls.resolve(F.col("url"), F.col("location")).alias("_to")).where("_to IS NOT NULL")
    vetted = guard.vet(to.withColumn("url", F.col("_to")), dns, allow_private_hosts=allow_private_hosts)
    first = F.min(F.struct(F.col("reason").isNull().alias("allowed"), "url", "reason"))
    known = vetted.groupBy(*keys.values(), "_at").agg(first.alias("_m")).select(*keys.values(), "_at", F.col("_m.url").alias("_to"), F.col("_m.reason").alias("_why"))
    moving = links.withColumns({"final_url": F.col("url"), "hops": F.lit(0), "blocked_reason": F.lit(None).cast("string"), "blocked_url": F.lit(None).cast("string")})
    for _ in range(hops + 1):
        same = [F.col(c) == F.col(k) for c, k in keys.items()]
        joined = moving.join(known, [F.col("final_url") == F.col("_at"), F.col("blocked_reason").isNull(), *same], "left")
        step = F.col("_to").isNotNull()
        moving = joined.withColumns({
            "blocked_reason": F.when(step, F.when(F.col("_why").isNotNull(), F.col("_why")).when(F.col("hops") >= hops, "too_many_redirects")).otherwise(F.col("blocked_reason")),
            "blocked_url": F.when(step & (F.col("_why").isNotNull() | (F.col("hops") >= hops)), F.col("_to")).otherwise(F.col("blocked_url")),
            "final_url": F.when(step & F.col("_why").isNull() & (F.col("hops") < hops), F.col("_to")).otherwise(F.col("final_url")),
            "hops": F.when(step & F.col("_why").isNull() & (F.col("hops") < hops), F.col("hops") + 1).otherwise(F.col("hops")),
        }).drop("_at", "_to", "_why", *keys.values())
    return moving


def follow_redirects_sql(spark: SparkSession, links: DataFrame, redirects: DataFrame, *, hops: int = HOPS) -> DataFrame:
    """url, final_url, hops without vetting, as one recursive query; the end of each chain within the bound."""
    # Tables as arguments of the text: no view stays in the session.
    return spark.sql(f"""
      WITH RECURSIVE walk(url, at, hops) AS (
        SELECT url, url, 0 FROM (SELECT DISTINCT url FROM {{links}})
        UNION ALL
        SELECT w.url, r.location, w.hops + 1 FROM walk w JOIN {{redirects}} r ON w.at = r.url WHERE w.hops < {hops})
      SELECT url, max_by(at, hops) AS final_url, max(hops) AS hops FROM walk GROUP BY url""", links=links, redirects=redirects)
