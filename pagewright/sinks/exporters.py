"""Exports: one file for each chapter, the whole book in one file, and a manifest of lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from pagewright.functions.text import book_chunk, chapter_markdown, chapter_text, combined_chunk, iso_time


class NamedFiles(DataSource):
    """`df.write.format("named_files")`: writes rows (name, content) as files of a folder all executors share.

    Each file appears whole: it is written beside its name and then moved.
    """

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(self.options["path"])


class _FileWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows) -> WriterCommitMessage:
        import os
        import uuid

        os.makedirs(self.path, exist_ok=True)
        for row in rows:
            partial = os.path.join(self.path, f".{uuid.uuid4().hex}")
            with open(partial, "w", encoding="utf-8", newline="") as file:
                file.write(row["content"])
            os.replace(partial, os.path.join(self.path, row["name"]))
        return WriterCommitMessage()


def _source(include_links: bool) -> Column | None:
    return F.col("final_url") if include_links else None


def text_files(records: DataFrame, *, include_links: bool = False) -> DataFrame:
    return records.select("name", chapter_text(F.col("title"), F.col("text"), _source(include_links)).alias("content"))


def markdown_files(records: DataFrame, *, include_links: bool = False) -> DataFrame:
    name = F.regexp_replace("name", r"\.txt\z", ".md")
    return records.select(name.alias("name"), chapter_markdown(F.col("title"), F.col("text"), _source(include_links)).alias("content"))


def _joined(chunks: DataFrame, key: list[str]) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("idx", "chunk")))
    return chunks.groupBy(*key).agg(F.array_join(F.transform(parts, lambda p: p["chunk"]), "").alias("content"))


def combined_text(records: DataFrame, *, key: list[str], include_links: bool = False) -> DataFrame:
    """All chapters of each book in one text, in the order of their numbers. A book is bounded: links are cut at a maximum."""
    return _joined(records.select(*key, "idx", combined_chunk(F.col("title"), F.col("text"), _source(include_links)).alias("chunk")), key)


def book_markdown(records: DataFrame, *, key: list[str], include_links: bool = False) -> DataFrame:
    return _joined(records.select(*key, "idx", book_chunk(F.col("title"), F.col("text"), _source(include_links)).alias("chunk")), key)


def manifest_lines(records: DataFrame) -> DataFrame:
    """idx, line: a JSON line for each chapter; robots marks where there are any, a thinner line for stored chapters."""
    keep = {"ignoreNullFields": "false"}
    head = [F.lit("chapter").alias("type")]
    body = [F.col("idx").alias("index"), "url", "final_url"]
    full = F.struct(*head, *body, "redirected", "title", iso_time(F.col("fetched_at")).alias("fetched_at"), "attempts", "bytes", "sha256", "stripped_urls")
    stored = F.struct(*head, F.lit(True).alias("from_checkpoint"), *body, "title", iso_time(F.col("fetched_at")).alias("fetched_at"), "bytes", "sha256", "stripped_urls")
    line = F.when(F.col("from_checkpoint"), F.to_json(stored, keep)).otherwise(F.to_json(full, keep)) if "from_checkpoint" in records.columns else F.to_json(full, keep)
    if "robots_rule" in records.columns:
        marks = F.to_json(F.struct(F.col("robots_allowed"), F.col("robots_rule"), F.col("robots_override").alias("robots_authenticated_override")), keep)
        line = F.when(F.col("robots_allowed").isNull(), line).otherwise(F.concat(F.regexp_replace(line, r"\}\z", ","), F.substring(marks, 2, 2**31 - 1)))
    return records.select("idx", line.alias("line"))


def manifest_summaries(books: DataFrame, accounted: DataFrame, records: DataFrame, failures: DataFrame, *, key: str) -> DataFrame:
    """key, line: the summary's JSON line of each book (key, toc_url). Details are those of one book, bounded by its links."""
    rejected = F.when(F.col("status") == "rejected", F.struct("pos", "url", "reason", "detail"))
    links = accounted.groupBy(key).agg(
        F.count(F.lit(1)).alias("raw_links"), *(F.count_if(F.col("status") == s).alias(s) for s in ("kept", "truncated")), F.array_sort(F.collect_list(rejected)).alias("gone")
    )
    done = records.groupBy(key).agg(F.count(F.lit(1)).alias("completed"), F.sum("stripped_urls").alias("total_stripped_urls"))
    lost = failures.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("index"), "url", "reason", "attempts"))).alias("failed"))
    whole = books.join(links, key, "left").join(done, key, "left").join(lost, key, "left")
    whole = whole.fillna(0, ["raw_links", "kept", "truncated", "completed", "total_stripped_urls"])
    none = lambda c, like: F.coalesce(F.col(c), F.array().cast(like))
    whole = whole.withColumns({"gone": none("gone", whole.schema["gone"].dataType), "failed": none("failed", whole.schema["failed"].dataType)})
    reasons = F.array_sort(F.array_distinct(F.transform("gone", lambda g: g["reason"])))
    counts = F.map_from_entries(F.transform(reasons, lambda r: F.struct(r, F.size(F.filter("gone", lambda g: g["reason"] == r))))).alias("rejected")
    detail = F.transform("gone", lambda g: F.struct(g["url"].alias("url"), g["reason"].alias("reason"), g["detail"].alias("detail"))).alias("rejected_detail")
    told = F.struct(F.lit("summary").alias("type"), "toc_url", "raw_links", "kept", "truncated", "completed", counts, detail, "failed", "total_stripped_urls")
    return whole.select(key, F.to_json(told, {"ignoreNullFields": "false"}).alias("line"))


def manifest_summary(accounted: DataFrame, records: DataFrame, failures: DataFrame, toc_url: str) -> DataFrame:
    """One row with the JSON line of one book."""
    spark = accounted.sparkSession
    books = spark.createDataFrame([(0, toc_url)], "_book int, toc_url string")
    own = (df.withColumn("_book", F.lit(0)) for df in (accounted, records, failures))
    return manifest_summaries(books, *own, key="_book").select("line")


EXPORTERS: dict[str, Callable[..., DataFrame]] = {"text": text_files, "markdown": markdown_files}


def write_files(files: DataFrame, path: str) -> None:
    files.sparkSession.dataSource.register(NamedFiles)
    files.select("name", "content").write.format("named_files").mode("append").save(path)


def damaged(recorded: DataFrame, files: DataFrame) -> DataFrame:
    """Recorded outputs (name, output_sha256) that are missing or differ among files (name, content): name, fault."""
    found = files.select("name", F.sha2("content", 256).alias("_now"))
    fault = F.when(F.col("_now").isNull(), "missing").when((F.col("output_sha256") != "") & (F.col("output_sha256") != F.col("_now")), "changed")
    return recorded.join(found, "name", "left").select("name", fault.alias("fault")).where(F.col("fault").isNotNull())
