"""Shared pieces of the training-data operators: shared-folder tables, word splitting, input normalisation."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.session import sound_unions

# Bytes outside `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` become spaces after A-Z are lower-cased; bytes from 0x80 on are kept.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def word_split(raw: bytes) -> list[bytes]:
    """Lower-cased words of UTF-8 bytes: runs of digits, a-z and bytes above 0x7F."""
    return raw.translate(_WORD_BYTES).split()


#: Rows sent to a Python worker at once; texts can be long, and a worker holds a few copies of a batch.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    sound_unions(spark)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir, or a local one in single-machine tests."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    got = os.path.join(tempfile.gettempdir(), "pagewright-shared")
    spark.conf.set("spark.checkpoint.dir", got)
    return got


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same, but memory that Arrow keeps for later batches goes back when the task ends: worker processes live on, and what
    they keep is missing in the stages that follow."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return whole


#: Paths of the tables written inside each open `scratch`, innermost last.
_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables written inside when it ends, but for those that were written with `keep`."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: lineage is cut and lost executors lose nothing.

    With `keep` the table outlives the innermost `scratch`, for results that are read later.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/pagewright/{name}-{uuid.uuid4().hex}"
    if held := _scratch[: len(_scratch) - keep]:
        held[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be no column's name, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(n))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra or clashing columns of an input never reach an operator."""
    bounded_batches(df.sparkSession)
    return df.select(*(F.col(f"`{n}`") for n in names))
