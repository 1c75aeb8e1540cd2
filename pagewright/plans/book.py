"""A whole run: index page to links to chapters to exports, with every link accounted for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import urls
from pagewright.functions.text import chapter_text
from pagewright.operators import filenames, links, records, resume, robots
from pagewright.operators.links import checked
from pagewright.sinks import exporters
from pagewright.sources import live
from pagewright.sources.profile import Settings
from pagewright.sources.state import Store

#: Links (url, idx, ...) and when each host was asked last, to final_url, html, attempts, error, detail and started_at.
Source = Callable[[DataFrame, DataFrame | None], DataFrame]


class IncompleteBook(RuntimeError):
    """An export that would lack chapters or hold changed ones."""


def stored_pages(pages: DataFrame) -> Source:
    """Pages (url, html, and final_url where redirects were followed) of a table."""
    return lambda links_, since: records.stored(links_, pages).withColumn("started_at", F.lit(None).cast("double"))


def live_pages(settings: Settings, delays: DataFrame | None = None, lookup: Callable[[str], list[str]] | None = None) -> Source:
    """Pages as they are loaded, by the settings' manners."""
    return lambda links_, since: live.fetched(links_, live.Manners.of(settings), delays=delays, since=since, lookup=lookup)


@dataclass(frozen=True)
class Collected:
    """Accounted links of one index page."""

    toc_url: str
    accounted: DataFrame
    html: str | None = None

    @property
    def kept(self) -> DataFrame:
        rows = self.accounted.where("status = 'kept'")
        if "robots_rule" not in rows.columns:
            return rows.select("idx", "url")
        return rows.select("idx", "url", F.lit(True).alias("robots_allowed"), "robots_rule", "robots_override")


@dataclass(frozen=True)
class Result:
    collected: Collected
    completed: DataFrame
    failed: DataFrame
    skipped: DataFrame

    def totals(self) -> DataFrame:
        return records.run_totals(self.collected.kept, self.completed, self.failed, self.skipped)


def collect_links(
    spark: SparkSession, source: Source, toc_url: str, settings: Settings, *, dns: DataFrame | None = None, robots_txt: DataFrame | None = None, authenticated: bool = False
) -> Collected:
    """The index page's links, vetted; raises where the page cannot be loaded. Links count from where redirects ended."""
    asked = spark.createDataFrame([(toc_url, 0)], "url string, idx int")
    # One page: it is read on the driver, as its links are those of one run.
    page = source(asked, None).first()
    if page is None or page.error is not None:
        raise IncompleteBook(f"{page.error}: {page.detail}" if page else toc_url)
    toc = spark.createDataFrame([(0, page.final_url, page.html)], "page_id int, url string, html string")
    found = links.resolved(links.raw_links(toc, settings.link))
    agent = {"agent": settings.ua} if settings.ua else {}
    accounted = links.account(
        found, dns=dns, robots_txt=robots_txt, authenticated=authenticated, allow_private_hosts=settings.allow_private_hosts, maximum=settings.max, scope="toc", **agent
    )
    return Collected(toc_url, accounted, page.html)


def crawl_delays(robots_txt: DataFrame, agent: str | None) -> DataFrame:
    """host, crawl_delay of the origins that ask for one."""
    rules = robots.crawl_delays(robots.parse(robots_txt), *([agent] if agent else []))
    return rules.select(urls.host(F.col("origin")).alias("host"), "crawl_delay")


def read_chapters(loaded: DataFrame, settings: Settings, now: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Completed chapters, named, and failures of loaded pages. `now` fixes the time of loading, for repeatable output."""
    told = records.read(loaded.drop("started_at"), settings.title, settings.content)
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    good = records.records(told, remove_links=not settings.include_links, strip_ads=settings.strip_ads).withColumn("fetched_at", at)
    # Names begin with the number in the book, so waves cannot take each other's.
    named = filenames.allocate(good.withColumn("_book", F.lit(0)), output="_book").drop("_book", "collided_with")
    return named, records.failures(told)


def fetch(collected: Collected, source: Source, settings: Settings, store: Store, *, now: str | None = None) -> Result:
    """Loads the kept links that the store has not, in waves as wide as the concurrency, and adds each wave to the store.

    A table of stored pages is one wave. Chapter files are written wave by wave as well, with their digests in the store.
    """
    spark = store.spark
    kept, prior = collected.kept, store.completed().select("url")
    todo = resume.pending(kept, prior).persist()
    try:
        numbers = sorted(r.idx for r in todo.select("idx").collect())  # as many as --max allows
        wide = max(1, len(numbers) if settings.pages else settings.concurrency)
        since: DataFrame | None = None
        for first in range(0, len(numbers), wide):
            some = numbers[first : first + wide]
            loaded = store.wave(source(todo.where(F.col("idx").between(some[0], some[-1])), since))
            completed, failed = read_chapters(loaded, settings, now)
            digest = F.lit("")
            if "text" in settings.formats:
                exporters.write_files(completed.select("name", _text_file(settings).alias("content")), settings.out)
                digest = F.sha2(_text_file(settings).cast("binary"), 256)
            store.add(completed.withColumn("output_sha256", digest), failed)
            if not settings.pages:
                # A row for each host of the wave; held here, as the next wave takes the place of its table.
                seen = loaded.groupBy(urls.host(F.col("url")).alias("host")).agg(F.max("started_at").alias("started_at")).collect()
                since = spark.createDataFrame([tuple(r) for r in seen], "host string, started_at double")
        failures = store.failed().join(todo.select("url"), "url", "left_semi")
        return Result(collected, resume.pending(store.completed(), prior), failures, resume.skipped(kept, prior))
    finally:
        todo.unpersist()


def _text_file(settings: Settings):
    return chapter_text(F.col("title"), F.col("text"), F.col("final_url") if settings.include_links else None)


def whole_book(result: Result, store: Store) -> DataFrame:
    """All chapters of the book, numbered as the index page is today: those of this run and, from_checkpoint, stored ones.

    Keyed by address; an address that is expected and absent, or the other way round, is an error.
    """
    current = result.completed
    prior = store.completed().join(current.select("url"), "url", "left_anti")
    wanted = result.collected.kept.select("url", F.col("idx").alias("_now"))
    merged = resume.merge_prior(current, prior, key=["url"]).join(wanted, "url").withColumn("idx", F.col("_now")).drop("_now")
    faults = resume.incomplete(current.select("url").union(result.skipped.select("url")), merged).limit(5).collect()
    if faults:
        raise IncompleteBook("the book does not match its chapters: " + ", ".join(f"{r.url} ({r.side} only)" for r in faults))
    times = merged.groupBy("url").agg(F.count(F.lit(1)).alias("_times"))
    return merged.join(times, "url").withColumn("bytes", checked(F.col("bytes"), F.col("_times") == 1, "a chapter is in the book twice")).drop("_times")


def verify_files(spark: SparkSession, store: Store, out: str) -> None:
    """Refuses to go on where a chapter file that the store names is gone or was changed."""
    from pathlib import Path

    recorded = store.completed().where("output_sha256 <> ''").select("name", "output_sha256")
    if not any(Path(out).glob("*.txt")):
        files = spark.createDataFrame([], "name string, content binary")
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(out).select(F.regexp_extract("path", r"([^/]*)\z", 1).alias("name"), "content")
    faults = sorted((r.name, r.fault) for r in exporters.damaged(recorded, files).collect())
    if faults:
        raise IncompleteBook("chapter files are not what was written: " + ", ".join(f"{n} ({f})" for n, f in faults) + "; use --force to load them again")


def export(spark: SparkSession, result: Result, settings: Settings, store: Store) -> None:
    """Writes the formats asked for; the book is evaluated once for all of them."""
    book = whole_book(result, store).persist()
    try:
        for name in settings.formats:
            if name == "jsonl":
                lines = exporters.manifest_lines(book).select(F.col("idx").alias("_at"), "line")
                summary = exporters.manifest_summary(result.collected.accounted, result.completed, result.failed, result.collected.toc_url).select(F.lit(2**31 - 1).alias("_at"), "line")
                parts = F.array_sort(F.collect_list(F.struct("_at", "line")))
                whole = lines.unionByName(summary).agg(F.concat(F.array_join(F.transform(parts, lambda p: p["line"]), "\n"), F.lit("\n")).alias("content"))
                exporters.write_files(whole.select(F.lit("manifest.jsonl").alias("name"), "content"), settings.out)
                continue
            # Text files of chapters are there already, unless they were loaded by a run without them.
            chapters = book.where("output_sha256 = ''") if name == "text" else book
            exporters.write_files(exporters.EXPORTERS[name](chapters, include_links=settings.include_links), settings.out)
            keyed = book.withColumn("_book", F.lit(result.collected.toc_url))
            joined = (exporters.combined_text if name == "text" else exporters.book_markdown)(keyed, key=["_book"], include_links=settings.include_links)
            exporters.write_files(joined.select(F.lit("combined.txt" if name == "text" else "book.md").alias("name"), "content"), settings.out)
    finally:
        book.unpersist()
