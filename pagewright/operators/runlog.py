"""The event log of a run, folded into the state a viewer sees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Legal moves of the lifecycle: fixed values.
MOVES = {
    "idle": ("launching",), "launching": ("browsing", "failed", "idle"), "browsing": ("confirmed", "failed", "idle"),
    "confirmed": ("extracting", "failed", "idle"), "extracting": ("stopping", "done", "failed"), "stopping": ("done", "failed"),
    "done": ("idle",), "failed": ("idle",),
}
SENTENCES = {
    "idle": "Ready", "launching": "Starting", "browsing": "Waiting for confirmation", "confirmed": "Confirmed",
    "extracting": "Loading chapters", "stopping": "Stopping", "done": "Done", "failed": "Failed",
}


def chapter_rows(events: DataFrame) -> DataFrame:
    """run, idx, url, state, title, detail: the newest value of each chapter; a title stays when newer ones are empty."""
    told = events.where("kind = 'chapter'")
    filled = lambda c: F.max_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("seq")))
    return told.groupBy("run", "idx").agg(
        F.coalesce(filled("url"), F.lit("")).alias("url"), F.max_by("state", "seq").alias("state"),
        F.coalesce(filled("title"), F.lit("")).alias("title"), F.max_by("detail", "seq").alias("detail"),
    )


def state_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run", "state").agg(F.count(F.lit(1)).alias("chapters"))


def overrides(events: DataFrame) -> DataFrame:
    """Each robots rule passed over, once a run, at its first mention."""
    return events.where("kind = 'override'").groupBy("run", "detail").agg(F.min("seq").alias("seq"))


#: Changes of phase are worked on in ranges of so many numbers of a run's log.
SPAN = 100_000


def moves(events: DataFrame, span: int = SPAN) -> DataFrame:
    """run, seq, before, phase of each change of phase; a run begins idle. Taken inside ranges of the log and carried from range
    to range, so that no task holds all of a run."""
    told = events.where("kind = 'phase'").select("run", "seq", F.col("state").alias("phase"), F.floor(F.col("seq") / span).alias("_range"))
    last = told.groupBy("run", "_range").agg(F.max_by("phase", "seq").alias("_last"))
    carried = last.select("run", "_range", F.lag("_last").over(Window.partitionBy("run").orderBy("_range")).alias("_carried"))
    inside = F.lag("phase").over(Window.partitionBy("run", "_range").orderBy("seq"))
    return told.join(carried, ["run", "_range"]).select("run", "seq", F.coalesce(inside, "_carried", F.lit("idle")).alias("before"), "phase")


def illegal(events: DataFrame) -> DataFrame:
    """Changes of phase that the lifecycle does not allow."""
    spark: SparkSession = events.sparkSession
    # The table of legal moves is a constant.
    legal = F.broadcast(spark.createDataFrame([(a, b) for a, bs in MOVES.items() for b in bs], "before string, phase string"))
    return moves(events).join(legal, ["before", "phase"], "left_anti").select("run", "seq", "before", "phase")


def abilities(phase: Column) -> dict[str, Column]:
    """What may be started in a phase."""
    return {
        "can_launch": phase.isin("idle", "done", "failed"), "can_confirm": phase == "browsing",
        "can_extract": phase == "confirmed", "can_stop": phase == "extracting",
    }


def sentence(phase: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in SENTENCES.items() for x in pair))[phase]


def last_lines(log: DataFrame, n: int = 500) -> DataFrame:
    return log.orderBy(F.desc("seq")).limit(n)


def updates(records: DataFrame, failures: DataFrame) -> DataFrame:
    """Records and failures as chapter events."""
    done = records.select("idx", "url", F.lit("done").alias("state"), "title", F.lit("").alias("detail"))
    told = F.format_string("%s after %d attempt(s)", "reason", "attempts")
    return done.unionByName(failures.select("idx", "url", F.lit("failed").alias("state"), F.lit("").alias("title"), told.alias("detail")))
