"""robots.txt: parsing into rules, the group that governs an agent, and decisions.

The group is chosen winner-takes-all: the first that names the agent by a prefix, else the first for `*`. Within it the
first rule in file order whose value begins the path decides (`precedence="first"`), or the longest one (`"longest"`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import urls
from pagewright.functions.text import described_rule, strip

AGENT = "pagewright"
MAX_BYTES = 512_000
NO_RULE = "robots.txt disallows this path"


def documents(fetched: DataFrame) -> DataFrame:
    """origin, content of fetch results (origin, status, body): only status 200 counts, cut to MAX_BYTES, decoded with marks
    for what is no UTF-8. Every other origin has no row, and so no restrictions."""
    cut = F.substring(F.col("body").cast("binary"), 1, MAX_BYTES)
    return fetched.where("status = 200").select("origin", F.make_valid_utf8(cut.cast("string")).alias("content"))


def lines(robots: DataFrame) -> DataFrame:
    """origin, line_number, key, value of the lines that say something."""
    numbered = robots.select("origin", F.posexplode(F.split("content", r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\x{2028}\x{2029}]")).alias("at", "raw"))
    line = strip(F.regexp_replace("raw", r"(?s)#.*\z", ""))
    told = numbered.select("origin", (F.col("at") + 1).alias("line_number"), line.alias("line")).where(F.col("line").contains(":"))
    return told.select(
        "origin", "line_number", F.lower(strip(F.regexp_extract("line", r"(?s)\A([^:]*):", 1))).alias("key"),
        strip(F.regexp_extract("line", r"(?s)\A[^:]*:(.*)\z", 1)).alias("value"),
    )


def parse(robots: DataFrame) -> DataFrame:
    """origin, group_id, agents, last_agent, line_number, directive, value of every rule, crawl delays among them.

    Consecutive agent lines share a group; an agent line after any other key begins a new one. Rules before the first
    agent line belong to nobody.
    """
    told = lines(robots)
    order = Window.partitionBy("origin").orderBy("line_number")
    starts = (F.col("key") == "user-agent") & ~F.coalesce(F.lag("key").over(order) == "user-agent", F.lit(False))
    grouped = told.withColumn("group_id", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("group_id > 0")
    named = grouped.where("key = 'user-agent'").groupBy("origin", "group_id").agg(
        F.array_agg(F.lower("value")).alias("agents"), F.max_by(F.lower("value"), "line_number").alias("last_agent")
    )
    rules = grouped.where(F.col("key").isin("allow", "disallow", "crawl-delay")).withColumnRenamed("key", "directive")
    return named.join(rules, ["origin", "group_id"], "left").select("origin", "group_id", "agents", "last_agent", "line_number", "directive", "value")


def governing(rules: DataFrame, agent: str = AGENT) -> DataFrame:
    """The rules of the one group of each origin that governs the agent."""
    wanted = F.lit(agent.lower())
    names = F.exists("agents", lambda a: (a != "*") & (a != "") & wanted.startswith(a))
    rank = F.when(names, 0).when(F.array_contains("agents", "*"), 1)
    ranked = rules.withColumn("_rank", rank).where(F.col("_rank").isNotNull())
    first = ranked.groupBy("origin").agg(F.min(F.struct("_rank", "group_id")).alias("_best")).select("origin", F.col("_best.group_id").alias("group_id"))
    return ranked.drop("_rank").join(first, ["origin", "group_id"])


def crawl_delays(rules: DataFrame, agent: str = AGENT) -> DataFrame:
    """origin, crawl_delay of the governing group: the last whole number given."""
    asked = governing(rules, agent).where((F.col("directive") == "crawl-delay") & F.col("value").rlike(r"\A\d+\z"))
    return asked.groupBy("origin").agg(F.max_by(F.col("value").cast("double"), "line_number").alias("crawl_delay"))


def decide(
    links: DataFrame, robots: DataFrame, *, url: str = "url", agent: str = AGENT, precedence: str = "first", authenticated: bool = False, key: str = "id", origin: Column | None = None
) -> DataFrame:
    """One row for each distinct `key` of links: key, robots_allowed, robots_rule, robots_override.

    `origin` names whose rules apply (the link's own origin unless given). Disallowed but signed in: allowed, with the
    rule kept. The rule named is the longest Disallow that begins the path; the rules join by origin, so each link meets
    only its own few.
    """
    rules = governing(parse(robots), agent).where(F.col("directive").isin("allow", "disallow"))
    told = links.select(key, (origin if origin is not None else urls.origin(F.col(url))).alias("origin"), urls.path(F.col(url)).alias("_p"))
    told = told.withColumn("_p", F.when(F.col("_p") == "", "/").otherwise(F.col("_p")))
    met = told.join(rules, "origin", "left").withColumn("_hit", (F.col("value") != "") & F.col("_p").startswith(F.col("value")))
    order = F.col("line_number") if precedence == "first" else F.struct(-F.length("value"), F.col("directive"), F.col("line_number"))
    hit = F.col("_hit")
    barred = hit & (F.col("directive") == "disallow")
    named = described_rule(F.lit("disallow"), F.col("value"), F.col("line_number"), F.col("last_agent"))
    decided = met.groupBy(key).agg(
        F.min_by(F.when(hit, F.col("directive")), F.when(hit, order)).alias("_by"),
        F.max_by(F.when(barred, named), F.when(barred, F.struct(F.length("value"), -F.col("line_number")))).alias("_rule"),
    )
    refused = F.coalesce(F.col("_by") == "disallow", F.lit(False))
    rule = F.when(refused, F.coalesce("_rule", F.lit(NO_RULE)))
    return decided.select(key, (~refused | F.lit(authenticated)).alias("robots_allowed"), rule.alias("robots_rule"), (refused & F.lit(authenticated)).alias("robots_override"))
