"""Incremental runs as Structured Streaming: each address once, over any number of arrivals."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def new_pages(spark: SparkSession, path: str, *, files_per_batch: int = 200) -> DataFrame:
    """A stream of pages whose address has not been seen. Addresses stay in state for good: a book's links are bounded."""
    schema = spark.read.parquet(path).schema
    # A table may be one file: its folder is the stream then, and the glob keeps other tables out.
    folder, _, name = path.rstrip("/").rpartition("/")
    java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = java.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(java).isFile()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", name if single else "*.parquet")
    stream = reader.parquet(folder if single else path)
    return stream.dropDuplicates(["url"])


def available_now(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Handles all that has arrived, batch by batch; what `each` wrote before a failure is written again, so it must replace by batch."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def paced(requests: DataFrame, interval: float) -> DataFrame:
    """host, id, arrival, start of a stream of requests (host, id, arrival in seconds): the last start of each host is kept as
    state, so pacing holds across batches."""

    def start(key: tuple, frames, state: GroupState):
        last = state.get[0] if state.exists else None
        for frame in frames:
            frame = frame.sort_values(["arrival", "id"])
            starts = []
            for arrival in frame["arrival"]:
                last = arrival if last is None else max(arrival, last + interval)
                starts.append(last)
            yield pd.DataFrame({"host": key[0], "id": frame["id"].to_numpy(), "arrival": frame["arrival"].to_numpy(), "start": starts})
        if last is not None:
            state.update((last,))

    return requests.groupBy("host").applyInPandasWithState(
        start, "host string, id long, arrival double, start double", "last double", "append", GroupStateTimeout.NoTimeout
    )


def growth_guard(stored: DataFrame, key: str) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """For a batch of index links: how each page relates to the stored links, those to go on with and those to refuse."""
    from pagewright.operators import resume

    def judge(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        told = resume.compare_tables(stored, batch, key=key)
        return told.where("comparison <> 'diverged'"), told.where("comparison = 'diverged'")

    return judge


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a local one on a single machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.gettempdir()


def collected(stream: DataFrame) -> DataFrame:
    """All that a stream has now, as a table in the shared folder."""
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/pagewright-stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


def written(df: DataFrame) -> DataFrame:
    """A table in the shared folder, for what several parts of a plan read and is dear to make."""
    path = f"{shared_folder(df.sparkSession)}/pagewright-table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
