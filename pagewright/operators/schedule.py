"""Pacing: when each request to a host may start, the gaps that result, and waits before retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_DELAY, MAX_DELAY = 1.2, 2.5


def effective_intervals(hosts: DataFrame, delays: DataFrame, minimum: float = MIN_DELAY) -> DataFrame:
    """Adds interval: the least one, raised (never lowered) by the host's own crawl_delay."""
    wanted = delays.groupBy("host").agg(F.max("crawl_delay").alias("_d"))
    return hosts.join(wanted, "host", "left").withColumn("interval", F.greatest(F.lit(max(0.0, minimum)), F.coalesce("_d", F.lit(0.0)))).drop("_d")


#: Arrivals of one host are worked on in ranges of so much time, in seconds.
SPAN = 3600


def _ranged(requests: DataFrame, host: str, at: str, span: Column | int) -> DataFrame:
    """The requests with _range, the stretch of time they fall in; a host with many is so spread over many tasks."""
    return requests.withColumn("_range", F.floor(F.col(at) / span))


def _of_ranges(ranged: DataFrame, host: str, **told: Column) -> DataFrame:
    """host, _range and aggregates of each range; one row for each stretch of time in which a host was asked."""
    return ranged.groupBy(host, "_range").agg(*(c.alias(n) for n, c in told.items()))


def starts(requests: DataFrame, *, host: str, arrival: str, order: list[str], interval: Column, span: int = SPAN) -> DataFrame:
    """Adds start: no earlier than the arrival, and an interval after the request before it on the same host; and waited.

    The fold start = max(arrival, previous start + interval) in closed form: n * interval plus the running maximum of
    arrival - n * interval. Both the count and the maximum are taken inside ranges of time and carried from range to range, so
    no task holds all of a host. The interval is one number for each host; `order` begins with the arrival.
    """
    before = Window.partitionBy(host).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(host, "_range").orderBy(*order)
    ranged = _ranged(requests, host, arrival, span).withColumn("_i", interval)
    counts = _of_ranges(ranged, host, _rows=F.count(F.lit(1))).withColumn("_ahead", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    numbered = ranged.join(counts, [host, "_range"]).withColumn("_n", F.col("_ahead") + F.row_number().over(inside) - 1)
    slack = numbered.withColumn("_slack", F.col(arrival) - F.col("_n") * F.col("_i"))
    most = _of_ranges(slack, host, _most=F.max("_slack")).withColumn("_held", F.max("_most").over(before)).drop("_most")
    running = F.max("_slack").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    carried = slack.join(most, [host, "_range"]).withColumn("start", F.col("_n") * F.col("_i") + F.greatest(running, F.col("_held")))
    return carried.withColumn("waited", F.col("start") - F.col(arrival)).select(*requests.columns, "start", "waited")


def gaps(requests: DataFrame, *, host: str, at: str, order: list[str], span: int = SPAN) -> DataFrame:
    """Adds gap: the time since the request before on the same host, null for the first; taken inside ranges of time and
    carried from range to range. `order` begins with the time."""
    ranged = _ranged(requests, host, at, span)
    last = _of_ranges(ranged, host, _last=F.max(at)).withColumn("_before", F.lag("_last").over(Window.partitionBy(host).orderBy("_range"))).drop("_last")
    inside = F.lag(at).over(Window.partitionBy(host, "_range").orderBy(*order))
    told = ranged.join(last, [host, "_range"]).withColumn("gap", F.col(at) - F.coalesce(inside, "_before"))
    return told.select(*requests.columns, "gap")


def backoff_ceiling(attempt: Column, minimum: float = MIN_DELAY, maximum: float = MAX_DELAY) -> Column:
    """The longest wait before the attempt is repeated; the real wait is drawn between zero and this."""
    return F.least(F.lit(maximum), F.lit(minimum) * F.pow(F.lit(2.0), attempt - 1))


def backoff(attempt: Column, seed: int, minimum: float = MIN_DELAY, maximum: float = MAX_DELAY) -> Column:
    return F.rand(seed) * backoff_ceiling(attempt, minimum, maximum)


def progress(done: Column, total: Column) -> Column:
    return F.when(total <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), done / F.greatest(total, F.lit(1))))
