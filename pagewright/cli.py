"""Command line: extract a book, loading its pages or from stored ones."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import urls
from pagewright.operators import guard, links, resume, robots
from pagewright.plans import book
from pagewright.session import reachable
from pagewright.sinks.exporters import write_files
from pagewright.sources import live, pages, state
from pagewright.sources.profile import FORMATS, ProfileError, Settings, load_profile, merged

VERSION = "0.1.0"
OK, FAILED, USAGE = 0, 1, 2
log = logging.getLogger("pagewright")


def build_parser() -> argparse.ArgumentParser:
    """Every option is absent unless given, so that a profile can tell what was asked for."""
    p = argparse.ArgumentParser(prog="pagewright", argument_default=argparse.SUPPRESS)
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("--pages", help="table of stored pages (url, html), instead of loading them")
    p.add_argument("--toc", required=True, help="address of the index page")
    p.add_argument("--profile")
    for name in ("link", "title", "content"):
        p.add_argument(f"--{name}", help=f"selector of the {name}")
    p.add_argument("--max", type=int)
    p.add_argument("--out")
    p.add_argument("--include-links", action="store_true")
    p.add_argument("--format", action="append", choices=FORMATS, dest="formats")
    p.add_argument("--no-strip-ads", action="store_false", dest="strip_ads")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--force", action="store_true")
    p.add_argument("--dump-html", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--timeout", type=int, help="milliseconds for a page, redirects included")
    p.add_argument("--min-delay", type=float, help="seconds between requests to a host")
    p.add_argument("--max-delay", type=float, help="longest wait before a page is tried again, in seconds")
    p.add_argument("--retries", type=int, help="more tries for a page")
    p.add_argument("--wait-after-load", type=int, help="milliseconds to rest after each page")
    p.add_argument("--concurrency", type=int, help="pages loaded at once, and chapters in a wave")
    p.add_argument("--ua", help="the agent that requests name, and robots rules are read for")
    p.add_argument("--allow-private-hosts", action="store_true")
    p.add_argument("--robots", help="table of robots files (origin, content), instead of asking for them")
    p.add_argument("--dns", help="table of addresses (host, ord, address)")
    return p


def _robots(spark: SparkSession, flags: dict, settings: Settings) -> DataFrame | None:
    """The robots file of the index page's origin: from the given table, or asked for where pages are loaded."""
    if "robots" in flags:
        return spark.read.parquet(flags["robots"])
    if settings.pages:
        return None
    origins = spark.createDataFrame([(flags["toc"],)], "url string").select(urls.origin(F.col("url")).alias("origin"))
    answers = live.fetched_robots(origins, live.Manners.of(settings)).collect()
    for row in answers:
        if row.detail:
            log.warning("could not read %s/robots.txt (%s). Going on as if it permits everything, which may not be what the site intends.", row.origin, row.detail)
    return robots.documents(spark.createDataFrame(answers, "origin string, status int, body binary, detail string"))


def _announce(plan: dict, grown: int) -> None:
    log.info("resuming: %d chapter(s) are there already", plan["already_done"])
    if grown:
        log.info("the index page has %d new link(s)", grown)
    if plan["renumbering"]:
        log.warning("links were added at the start: files that are there keep their numbers, the book and the manifest count anew; use --force for one numbering")


def _refusal(told: state.Header, selectors: dict[str, str], normal: str, store: state.Store, today: DataFrame) -> str:
    changed = [f"--{k} was {told.selectors.get(k)!r} and is {v!r}" for k, v in selectors.items() if told.selectors.get(k) != v]
    if told.toc_url != normal:
        changed.append(f"the index page was {told.toc_url} and is {normal}")
    if changed:
        return "; ".join(changed) + "; use --force to start over"
    before = store.links().select(F.lit(0).alias("page_id"), "pos", "url")
    return resume.divergence(before, today, key="page_id").select(resume.refusal(F.col("missing"), F.col("added"), F.col("first_missing")).alias("why")).first().why


def run(spark: SparkSession, argv: list[str]) -> int:
    flags = vars(build_parser().parse_args(argv))
    logging.basicConfig(level=logging.DEBUG if flags.get("verbose") else logging.WARNING if flags.get("quiet") else logging.INFO, format="%(message)s")
    try:
        settings = merged(load_profile(flags["profile"]) if "profile" in flags else {}, flags)
    except ProfileError as error:
        log.error("%s", error)
        return USAGE
    if settings.missing():
        log.error("selectors missing: %s", ", ".join(settings.missing()))
        return USAGE
    if "://" in settings.out:
        log.error("--out must be a folder that driver and executors mount, not %s", settings.out)
        return USAGE
    reachable(spark)
    toc = spark.createDataFrame([(flags["toc"],)], "url string")
    verdict = guard.vet(toc, allow_private_hosts=settings.allow_private_hosts).select("reason", "detail", urls.normalize(F.col("url")).alias("normal")).first()
    if verdict.reason:
        log.error("%s: %s %s", flags["toc"], verdict.reason, verdict.detail)
        return USAGE
    robots_txt = _robots(spark, flags, settings)
    delays = book.crawl_delays(robots_txt, settings.ua) if robots_txt is not None and not settings.pages else None
    source = book.stored_pages(pages.table(spark, settings.pages)) if settings.pages else book.live_pages(settings, delays)
    try:
        collected = book.collect_links(spark, source, flags["toc"], settings, dns=spark.read.parquet(flags["dns"]) if "dns" in flags else None, robots_txt=robots_txt)
    except book.IncompleteBook as error:
        log.error("could not read the index page: %s", error)
        return FAILED
    accounted = collected.accounted.persist()
    counts = links.totals(accounted.withColumn("page_id", F.lit(0))).first()
    log.info("found %d link(s)", counts.kept if counts else 0)
    for row in links.rejected_by_reason(accounted).collect():
        log.warning("rejected %s: %d", row.reason, row.links)
    if counts and counts.truncated:
        log.info("left out %d link(s) beyond --max", counts.truncated)
    if flags.get("dry_run"):
        for row in links.dry_run(accounted.withColumn("page_id", F.lit(0))).orderBy("idx").collect():
            print(row.line)
        return OK
    if flags.get("dump_html"):
        write_files(spark.createDataFrame([("toc.html", collected.html)], "name string, content string"), settings.out)
    selectors = {"link": settings.link, "title": settings.title, "content": settings.content}
    wanted = resume.fingerprint(verdict.normal, **selectors)
    store = state.Store(spark, f"{settings.out}/.state")
    if flags.get("force"):
        store.discard()
    today = accounted.where("status = 'kept'").select(F.lit(0).alias("page_id"), F.col("idx").alias("pos"), "url")
    told = store.header()
    if told is not None:
        before = store.links().select(F.lit(0).alias("page_id"), "pos", "url")
        comparison = resume.compare_tables(before, today, key="page_id").first()
        plan = resume.plan(told.fingerprint, wanted, comparison.comparison if comparison else "diverged", store.completed().count())
        if not plan["usable"]:
            log.error("not resuming: %s", _refusal(told, selectors, verdict.normal, store, today))
            return USAGE
        _announce(plan, resume.appended(today, before).count())
    try:
        if told is not None:
            book.verify_files(spark, store, settings.out)
        store.start(verdict.normal, wanted, selectors, collected.kept)
        result = book.fetch(collected, source, settings, store)
        book.export(spark, result, settings, store)
    except book.IncompleteBook as error:
        log.error("%s", error)
        return FAILED
    totals = result.totals().first()
    log.info("kept %d, completed %d, failed %d, skipped %d; %d address(es) taken out of texts", totals.kept, totals.completed, totals.failed, totals.skipped, totals.total_stripped_urls)
    for row in result.failed.orderBy("idx").collect():
        log.warning("chapter %d failed after %d attempt(s): %s %s", row.idx, row.attempts, row.reason, row.detail)
    return OK if totals.failed == 0 else FAILED


def main() -> None:
    sys.exit(run(SparkSession.builder.appName("pagewright").config("spark.sql.session.timeZone", "UTC").getOrCreate(), sys.argv[1:]))


if __name__ == "__main__":
    main()
