"""Line dedup: hashed lines are range-partitioned, sorted by document and position, and streamed once.

A line counts by its key (ASCII white space stripped, A-Z lower-cased). Keys of at least `min_chars` code points found in
at least `min_docs` documents lose all their lines except in the largest doc_id that holds them. The result is one
compressed keep bitmap per document that loses lines; texts are never shuffled to find it.

Defined cases: a null or empty text is one empty line, which is never long enough to be dropped; a null doc_id counts as
one document smaller than all others; rows that repeat a doc_id count as one document; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import fresh, materialize, pick, read, released, shuffle_partitions

MIN_CHARS = 40
MIN_DOCS = 5
FLUSH_KEYS = 40_000
NO_ID = -(2**63)

_BLANK = b" \t\n\x0b\x0c\r"
_LINE_ROWS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("text_h", pa.int64()), ("n_lines", pa.int32()), ("at", pa.binary()), ("docs", pa.int32())])
_LINE_DDL = "h1 long, h2 long, doc_id long, text_h long, n_lines int, at binary, docs int"
_DROP_ROWS = pa.schema([("doc_id", pa.int64()), ("text_h", pa.int64()), ("n_lines", pa.int32()), ("at", pa.binary())])
_DROP_DDL = "doc_id long, text_h long, n_lines int, at binary"


def _positions(at: list[int]) -> bytes:
    return np.array(at, np.int32).tobytes()


def _hashed_lines(min_chars: int, min_docs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents to one row per (key, document), pre-aggregated so that no key gives more than `min_docs` rows a flush.

    When a flush holds `min_docs` documents of a key, all but the largest are known to lose their lines; they leave as
    decided rows (docs = 0), and the largest one carries the count of those it stands for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, dict[tuple[int, int], list]] = {}
        #: Rows of this flush: one that repeats id and text says nothing new.
        seen: set[tuple[int, int]] = set()
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            for key, docs in found.items():
                h1, h2 = np.frombuffer(key, np.int64).tolist()
                ids = {doc for doc, _ in docs}
                decided = len(ids) >= min_docs
                largest = max(ids)
                for (doc, text_h), (n_lines, at) in docs.items():
                    if decided and doc != largest:
                        # Needs no key any more: dealt by the document's hash, so that neither a common line nor a group
                        # of copies weighs on one range.
                        spread = xxhash.xxh3_64_intdigest(doc.to_bytes(8, "little", signed=True)) - 2**63
                        out.append((spread, 0, doc, text_h, n_lines, _positions(at), 0))
                    else:
                        out.append((h1, h2, doc, text_h, n_lines, _positions(at), len(ids) if decided else 1))
            found.clear()
            seen.clear()
            for k in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[k : k + 20_000]), _LINE_ROWS)], schema=_LINE_ROWS)

        for batch in batches:
            raws = batch.column(2).cast(pa.binary()).to_pylist()
            for doc, text_h, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raws):
                row = (doc, text_h)
                if row in seen:
                    continue
                seen.add(row)
                lines = raw.split(b"\n")
                for at, line in enumerate(lines):
                    key = line.strip(_BLANK)
                    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
                        continue
                    docs = found.setdefault(xxhash.xxh3_128_digest(key.lower()), {})
                    if row in docs:
                        docs[row][1].append(at)
                    else:
                        docs[row] = [len(lines), [at]]
                        held += 1
                if held >= FLUSH_KEYS or len(seen) >= 10 * FLUSH_KEYS:
                    yield from flush()
                    held = 0
        yield from flush()

    return released(run)


def _first_occurrences(min_docs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams rows sorted by key and descending document: the first document keeps its lines, the rest lose them.

    Memory is constant: rows of a key wait only until `min_docs` documents are counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = first = last = None
        count, waiting, out = 0, [], []

        def emit() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _DROP_ROWS)], schema=_DROP_ROWS)
            out.clear()
            return got

        for batch in batches:
            for h1, h2, doc, text_h, n_lines, at, docs in zip(*(c.to_pylist() for c in batch.columns)):
                if docs == 0:
                    # Decided where it was read, and counted by the row of its flush that stands for it.
                    out.append((doc, text_h, n_lines, at))
                    continue
                if (h1, h2) != key:
                    key, first, last, count, waiting = (h1, h2), doc, None, 0, []
                if doc != last:
                    count, last = count + docs, doc
                elif docs > 1:
                    count += docs - 1
                if doc != first:
                    waiting.append((doc, text_h, n_lines, at))
                if count >= min_docs and waiting:
                    out += waiting
                    waiting = []
                if len(out) >= 20_000:
                    yield emit()
        if out:
            yield emit()

    return released(run)


@released
def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Collected drop positions of a document to its compressed keep bitmap."""
    for batch in batches:
        docs, texts, lines, ats = (c.to_pylist() for c in batch.columns)
        kept, dropped = [], []
        for n, parts in zip(lines, ats):
            keep = np.ones(n, bool)
            for part in parts:
                keep[np.frombuffer(part, np.int32)] = False
            kept.append(zlib.compress(np.packbits(keep).tobytes()))
            dropped.append(int(n - keep.sum()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(docs, pa.int64()), pa.array(texts, pa.int64()), pa.array(lines, pa.int32()), pa.array(dropped, pa.int32()), pa.array(kept, pa.binary())],
            names=["doc_id", "text_h", "n_lines", "n_dropped", "keep_bitmap"],
        )


def range_id(h1: Column, n: int) -> Column:
    """Which of n equal ranges of the hash space a 64-bit hash lies in; hashes are uniform, so ranges need no sampling."""
    return F.shiftrightunsigned(F.shiftrightunsigned(h1, 33) * F.lit(n), 31).cast("int")


def _identity() -> list[Column]:
    """What tells rows apart even where ids repeat: the id and a hash of the text."""
    return [F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("text_h")]


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text_h, n_lines, n_dropped, keep_bitmap of each document that loses lines; all others keep everything."""
    parts = shuffle_partitions(docs.sparkSession)
    lines = pick(docs, "doc_id", "text").where(F.length("text") >= min_chars).select(*_identity(), "text").mapInArrow(_hashed_lines(min_chars, min_docs), _LINE_DDL)
    drops = (
        lines.repartitionById(parts, range_id(F.col("h1"), parts))
        .sortWithinPartitions("h1", "h2", F.desc("doc_id"), "at")
        .mapInArrow(_first_occurrences(min_docs), _DROP_DDL)
    )
    # Rows that repeat id and text gave equal positions, which are sets here, combined before the shuffle.
    return (
        drops.groupBy("doc_id", "text_h").agg(F.first("n_lines").alias("n_lines"), F.collect_set("at").alias("ats"))
        .mapInArrow(_bitmaps, "doc_id long, text_h long, n_lines int, n_dropped int, keep_bitmap binary")
    )


def kept_lines(raw: bytes, bitmap: bytes | None) -> tuple[int, int, bytes]:
    """Number of lines, number dropped and the kept text of one document."""
    if not bitmap:
        return raw.count(b"\n") + 1, 0, raw
    lines = raw.split(b"\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines))
    kept = [line for line, k in zip(lines, keep) if k]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Documents with one more column, the last: the bitmap of each, null where nothing is dropped."""
    # Written first: made in the stage that reads the texts, they would take a second Python worker for each of its tasks.
    bitmaps = materialize(bitmaps, "bitmaps")
    doc_id, text_h = _identity()
    own_id, own_h, bitmap = fresh(docs.columns, "_id", "_h", "_bitmap")
    keyed = bitmaps.select(F.col("doc_id").alias(own_id), F.col("text_h").alias(own_h), F.col("keep_bitmap").alias(bitmap))
    own = docs.withColumns({own_id: doc_id, own_h: text_h})
    # The bitmaps, one a document, are the side that is hashed: texts stream past them and are never sorted.
    return own.join(keyed.hint("shuffle_hash"), [own_id, own_h], "left").select(*(F.col(f"`{c}`") for c in docs.columns), bitmap)


@released
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raws = batch.column(1).cast(pa.binary()).to_pylist()
        got = [kept_lines(raw or b"", b) for raw, b in zip(raws, batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([hashlib.sha256(g[2]).hexdigest() for g in got], pa.string())],
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )


@released
def _kept_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *names, bitmap = batch.schema.names
        raws = batch.column("text").cast(pa.binary()).to_pylist()
        texts = [None if raw is None else kept_lines(raw, b)[2] for raw, b in zip(raws, batch.column(bitmap).to_pylist())]
        text = pa.array(texts, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([text if n == "text" else batch.column(n) for n in names], names=names)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with their kept lines as text; all other columns as they were."""
    return with_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs)).mapInArrow(_kept_texts, docs.schema)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(read(spark, sf_dir, "documents"), "doc_id", "text")
    return with_bitmaps(docs, keep_bitmaps(docs)).mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, (c.key IS NOT NULL AND k.doc_id <> c.keeper) AS dropped
  FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
