"""The stored run: a header, and parts that are added as chapters are loaded, each the chapters and failures of one wave.

A part counts from the moment the header names it, and the header is replaced as a whole: whenever a run is broken off, a
reader sees every wave that had ended and nothing of the one that had not. A chapter or failure replaces earlier ones of its
address.
"""

from __future__ import annotations

import json
import os
import shutil
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.records import latest

VERSION = 2
COMPLETED = (
    "url string, idx int, name string, title string, text string, bytes long, sha256 string, stripped_urls int, fetched_at timestamp, final_url string, redirected boolean, attempts int, "
    "robots_allowed boolean, robots_rule string, robots_override boolean, output_sha256 string"
)
FAILED = "url string, idx int, reason string, attempts int, detail string"


def _columns(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


@dataclass(frozen=True)
class Header:
    """What names a run: the index page, the selectors and the parts; `number` tells the links of each start."""

    number: int
    toc_url: str
    fingerprint: str
    selectors: dict[str, str] = field(default_factory=dict)
    parts: tuple[str, ...] = ()


class Store:
    """A run's state in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def header(self) -> Header | None:
        """The stored header; none where there is no state, or it is damaged or of another version."""
        try:
            told = json.loads(Path(self.path, "state.json").read_text(encoding="utf-8"))
            if told.get("version") != VERSION:
                return None
            return Header(told["number"], told["toc_url"], told["fingerprint"], told["selectors"], tuple(told["parts"]))
        except (OSError, ValueError, AttributeError, KeyError):
            return None

    def _replace(self, header: Header) -> None:
        told = {
            "version": VERSION, "number": header.number, "toc_url": header.toc_url, "fingerprint": header.fingerprint, "selectors": header.selectors, "parts": list(header.parts),
            "updated_at": datetime.now(UTC).isoformat(),
        }
        os.makedirs(self.path, exist_ok=True)
        target = Path(self.path, "state.json")
        partial = target.with_suffix(".partial")
        with partial.open("w", encoding="utf-8") as file:
            json.dump(told, file)
            file.flush()
            os.fsync(file.fileno())
        os.replace(partial, target)

    def start(self, toc_url: str, fingerprint: str, selectors: dict[str, str], links: DataFrame) -> None:
        """Begins a run over these links (url, idx); the parts of the stored run of the same name stay."""
        old = self.header()
        number = (old.number if old else 0) + 1
        links.select("url", F.col("idx").alias("pos")).write.mode("overwrite").parquet(f"{self.path}/links-{number}")
        self._replace(Header(number, toc_url, fingerprint, selectors, old.parts if old and old.fingerprint == fingerprint else ()))

    def add(self, completed: DataFrame, failed: DataFrame) -> None:
        """One more part; what a broken-off run had begun to write in its place is replaced."""
        header = self.header()
        part = f"part-{header.number}-{len(header.parts)}"
        have = set(completed.columns)
        fill = [F.col(c) if c in have else F.lit(None).alias(c) for c in _columns(COMPLETED)]
        completed.select(*(c.cast(t.split()[1]).alias(t.split()[0]) for c, t in zip(fill, COMPLETED.split(", ")))).write.mode("overwrite").parquet(f"{self.path}/{part}/completed")
        failed.select(*_columns(FAILED)).write.mode("overwrite").parquet(f"{self.path}/{part}/failed")
        self._replace(replace(header, parts=(*header.parts, part)))

    def _rows(self, what: str, ddl: str) -> DataFrame:
        header = self.header()
        parts = header.parts if header else ()
        if not parts:
            return self.spark.createDataFrame([], f"{ddl}, _part int")
        # A run has as many parts as it had waves.
        rows = [self.spark.read.schema(ddl).parquet(f"{self.path}/{p}/{what}").withColumn("_part", F.lit(k)) for k, p in enumerate(parts)]
        out = rows[0]
        for one in rows[1:]:
            out = out.unionByName(one)
        return out

    def completed(self) -> DataFrame:
        return latest(self._rows("completed", COMPLETED), key="url", order="_part").drop("_part")

    def failed(self) -> DataFrame:
        """The newest failure of each address that has not been loaded since."""
        rows = latest(self._rows("failed", FAILED), key="url", order="_part").drop("_part")
        return rows.join(self.completed().select("url"), "url", "left_anti")

    def links(self) -> DataFrame:
        """pos, url of the links of the last start."""
        return self.spark.read.schema("url string, pos int").parquet(f"{self.path}/links-{self.header().number}")

    def wave(self, loaded: DataFrame) -> DataFrame:
        """Loaded pages, written once and read from there, so that nothing loads them again."""
        path = f"{self.path}/wave"
        loaded.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(loaded.schema).parquet(path)

    def discard(self) -> None:
        Path(self.path, "state.json").unlink(missing_ok=True)
        for old in Path(self.path).glob("part-*"):
            shutil.rmtree(old, ignore_errors=True)
