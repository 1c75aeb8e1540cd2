"""Exact top-k search by inner product over a pivot-distance index.

Vectors of integers get one more component that makes all norms equal, so the largest inner product is the least
Euclidean distance. Each vector is keyed by its nearest pivot and its distance to it; each pivot's distances are cut into
annuli at sampled quantiles. Annuli are gathered, or salted, into parts of bounded bytes, and the rows of a part are packed into
blocks by annulus and distance. Pivots, quantiles and each query's floor (a score that k rows reach) come from a bounded sample;
the index holds every row.

A query is dealt to the parts that the triangle inequality leaves it: those with an annulus that may hold a score no lower than
its floor. Parts and queries meet by an exchange on the part; a task holds one part and streams the queries, block by block of
`QUERY_BLOCK`, visits the part's blocks in the order of their bounds, and opens each only for queries whose k-th best its bound
still reaches. Nothing that grows with the input is broadcast or held by the driver. Where bounds prune nothing, every query meets
every part: work and shuffled bytes then grow with queries times rows, as they must.

Defined cases: vectors that are null, or hold null or non-finite components, and rows without vec_id take no part, nor do
vectors whose squared norm passes `MOST_NORM`, whose scores might not fit the 64 bits of a score; all other scores are exact
whole numbers; shorter vectors count as padded with zeros; of rows that repeat a query's id the one of least content asks,
and none of them is its candidate; repeated candidates each count; fewer than k candidates give fewer rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.common import materialize, pick, read, scratch, shuffle_partitions

SCALE = 256
TOP = 5
QUERY_STEP = 50
SAMPLE = 4096
PIVOTS = 48
ANNULI = 16
BLOCK_ROWS = 2048
#: Bytes of the vectors of a part, about.
PART_BYTES = 16 << 20
QUERY_BLOCK = 512
MOST_NORM = 2.0**62
#: The score of what is not there; below every score of vectors within `MOST_NORM`.
NONE = -(2**62) - 1


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, lists = batch.column(0), batch.column(1)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        # Null components become non-finite ones.
        x = np.asarray(lists.values.to_numpy(zero_copy_only=False), np.float64)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        with np.errstate(all="ignore"):
            whole = np.floor(x * SCALE)
            squares = whole * whole
        odd = np.concatenate(([0], np.cumsum(~np.isfinite(squares))))
        norms = np.concatenate(([0.0], np.cumsum(np.where(np.isfinite(squares) & (squares <= MOST_NORM), squares, 2 * MOST_NORM))))
        # A sum over the whole batch may swallow small rows behind a huge one; those are summed by themselves.
        norm = norms[offsets[1:]] - norms[offsets[:-1]] if norms[-1] < 2.0**50 else np.array([squares[a:b].sum() for a, b in zip(offsets, offsets[1:])])
        good = (odd[offsets[1:]] == odd[offsets[:-1]]) & (norm <= MOST_NORM) & np.asarray(lists.is_valid()) & np.asarray(ids.is_valid())
        data = np.where(np.isfinite(whole) & (np.abs(whole) < 2.0**62), whole, 0).astype(np.int64)
        packed = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((8 * offsets).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
        out = pa.RecordBatch.from_arrays([ids.cast(pa.int64()), packed, pa.array(np.where(good, norm, 0.0))], names=["vec_id", "v", "norm"])
        yield out.filter(pa.array(good))


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v (packed int64 components, floor of SCALE times x) and norm (its square) of every usable row."""
    return pick(vectors, "vec_id", "embedding").mapInArrow(_packed, "vec_id long, v binary, norm double")


def unpack(packed: list[bytes], width: int) -> np.ndarray:
    """Rows of whole numbers, padded to `width`."""
    if all(len(p) == 8 * width for p in packed):
        return np.frombuffer(b"".join(packed), np.int64).reshape(len(packed), width)
    out = np.zeros((len(packed), width), np.int64)
    for row, p in zip(out, packed):
        row[: len(p) // 8] = np.frombuffer(p, np.int64)
    return out


@dataclass(frozen=True)
class Pivots:
    """Pivots in the space with equal norms, and each one's annulus edges."""

    width: int
    largest: float
    points: np.ndarray
    edges: np.ndarray

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        rest = np.sqrt(np.maximum(self.largest - np.einsum("ij,ij->i", x, x), 0))
        return np.column_stack((x, rest))

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        squares = (lifted**2).sum(1)[:, None] + (self.points**2).sum(1)[None] - 2 * lifted @ self.points.T
        return np.sqrt(np.maximum(squares, 0))


def choose_pivots(sample: np.ndarray, width: int, largest: float, pivots: int = PIVOTS, annuli: int = ANNULI) -> Pivots:
    """Each next pivot is the sampled vector farthest from the chosen ones; edges are quantiles of the sample's distances."""
    first = Pivots(width, largest, np.zeros((1, width + 1)), np.zeros((1, annuli - 1)))
    points = first.lifted(sample) if len(sample) else np.zeros((1, width + 1))
    chosen, far = [0], ((points - points[0]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(1))
    some = Pivots(width, largest, points[chosen], first.edges)
    away = some.distances(points)
    nearest, least = away.argmin(1), away.min(1)
    cuts = np.linspace(0, 1, annuli + 1)[1:-1]
    edges = np.stack([np.quantile(least[nearest == p], cuts) if (nearest == p).any() else np.zeros(annuli - 1) for p in range(len(chosen))])
    return Pivots(width, largest, points[chosen], edges)


def _keyed(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots: Pivots = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            away = pivots.distances(pivots.lifted(unpack(batch.column("v").to_pylist(), pivots.width)))
            nearest = away.argmin(1)
            distance = away[np.arange(len(away)), nearest]
            ring = (pivots.edges[nearest] < distance[:, None]).sum(1)
            key = nearest * (pivots.edges.shape[1] + 1) + ring
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(key.astype(np.int32)), pa.array(distance)], names=["vec_id", "v", "key", "distance"])

    return run


@dataclass(frozen=True)
class Layout:
    """Annuli in order of their key with their least and greatest distance, and the first part and number of parts of each. As
    many entries as there are annuli, whatever the input."""

    keys: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    parts: np.ndarray


def lay_out(keyed: DataFrame, width: int, part_bytes: int = PART_BYTES) -> Layout:
    """Neighbouring annuli share a part up to `part_bytes`; a larger annulus has several parts of its own."""
    rows_a_part = max(1, part_bytes // (8 * max(1, width)))
    found = sorted(keyed.groupBy("key").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count(F.lit(1)).alias("n")).collect())
    first, parts, at, filled = [], [], -1, rows_a_part
    for r in found:
        if r.n > rows_a_part:
            first.append(at + 1)
            parts.append(-(-r.n // rows_a_part))
            at, filled = at + parts[-1], rows_a_part
            continue
        if filled + r.n > rows_a_part:
            at, filled = at + 1, 0
        filled += r.n
        first.append(at)
        parts.append(1)
    column = lambda k, kind: np.array([r[k] for r in found], kind)
    return Layout(column(0, np.int64), column(1, float), column(2, float), np.array(first, np.int64), np.array(parts, np.int64))


_PART_DDL = "part int, kind int, key int, low double, high double, ids binary, vs binary, floors binary"
_PART_KINDS = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
_PART_NAMES = [c.split()[0] for c in _PART_DDL.split(", ")]


def _part_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_PART_KINDS)], names=_PART_NAMES)


def _packs(width: int, most: int, make: Callable[[list[tuple]], Iterator[tuple]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs sorted rows (group, key, vec_id, v, distance) of one (group, key) into runs of at most `most`, each made into rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("group", "key", "vec_id", "v", "distance"))):
                if held and (held[-1][:2] != row[:2] or len(held) >= most):
                    for made in make(held):
                        yield _part_rows([made])
                    held.clear()
                held.append(row)
        if held:
            for made in make(held):
                yield _part_rows([made])

    return run


def index_blocks(keyed: DataFrame, layout: Layout, width: int) -> DataFrame:
    """The blocks of every part: rows of one annulus, near each other in distance."""
    spark = keyed.sparkSession
    homes = F.broadcast(spark.createDataFrame([(int(k), int(f), int(n)) for k, f, n in zip(layout.keys, layout.first, layout.parts)], "key int, first int, parts int"))
    part = F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int")
    placed = keyed.join(homes, "key").select(part.alias("group"), "key", "vec_id", "v", "distance")
    dealt = placed.repartition(shuffle_partitions(spark), "group").sortWithinPartitions("group", "key", "distance", "vec_id")

    def block(held: list[tuple]) -> Iterator[tuple]:
        part, key, ids, vs, distances = zip(*held)
        yield part[0], 0, key[0], distances[0], distances[-1], np.array(ids, np.int64).tobytes(), unpack(list(vs), width).tobytes(), None

    return dealt.mapInArrow(_packs(width, BLOCK_ROWS, block), _PART_DDL)


def _reach(pivots: Pivots, away: np.ndarray, squares: np.ndarray, keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The highest score that the triangle inequality leaves each query in each annulus or block, and a little for rounding."""
    pivot = keys // (pivots.edges.shape[1] + 1)
    gap = np.maximum(0, np.maximum(away[:, pivot] - high, low - away[:, pivot]))
    return (squares[:, None] + pivots.largest - gap**2) / 2 + 1e-7 * (pivots.largest + squares.max(initial=0) + 1)


def _asked(pivots: Pivots, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of queries to the pivots, and their squares."""
    x = queries.astype(np.float64)
    return pivots.distances(np.column_stack((x, np.zeros(len(x))))), np.einsum("ij,ij->i", x, x)


def deal_queries(asked: DataFrame, shared, top: int) -> DataFrame:
    """Blocks of queries for each part that may hold some of their best."""
    spark = asked.sparkSession
    # Queries of neighbouring annuli are near each other, and so go to the same parts; ranges split an annulus that many share.
    dealt = asked.repartitionByRange(shuffle_partitions(spark), "key", "distance", "vec_id").sortWithinPartitions("key", "distance", "vec_id")
    dealt = dealt.select(F.lit(0).alias("group"), F.lit(0).alias("key"), "vec_id", "v", "distance")

    def deals(held: list[tuple]) -> Iterator[tuple]:
        pivots, layout, sample, sample_ids = shared.value
        ids, queries = np.array([h[2] for h in held], np.int64), unpack([h[3] for h in held], pivots.width)
        # The sample's k-th best score is one that k rows reach: nothing below it can be among the best.
        floors = np.full(len(held), NONE)
        got = products(queries, sample)
        got[ids[:, None] == sample_ids[None]] = NONE
        if got.shape[1] >= top:
            floors = np.partition(got, -top, axis=1)[:, -top]
        away, squares = _asked(pivots, queries)
        open_ = _reach(pivots, away, squares, layout.keys, layout.low, layout.high) >= floors[:, None]
        for first in np.unique(layout.first):
            here = layout.first == first
            wanted = open_[:, here].any(axis=1)
            if wanted.any():
                yield int(first), int(layout.parts[here][0]), 0, 0.0, 0.0, ids[wanted].tobytes(), queries[wanted].tobytes(), floors[wanted].tobytes()

    packed = dealt.mapInArrow(_packs(0, QUERY_BLOCK, deals), _PART_DDL)
    # `kind` holds the number of parts from `part` on; each takes the block.
    spread = F.explode(F.sequence(F.col("part"), F.col("part") + F.col("kind") - 1))
    return packed.withColumn("part", spread).withColumn("kind", F.lit(1)).select(*_PART_NAMES)


def best(scores: np.ndarray, ids: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """The `top` highest scores of each row and their ids, ties to the smaller id; NONE marks what isn't there."""
    if len(scores) and scores.shape[1] > 8 * top:
        n = scores.shape[1]
        there = scores > NONE
        if int(np.abs(np.where(there, scores, 0)).max(initial=0)) < 2**61 // n:
            # The place in the order of ids decides ties in one number.
            if ids.strides[0]:
                place = np.empty(ids.shape, np.int64)
                np.put_along_axis(place, np.argsort(ids, axis=1, kind="stable"), np.arange(n)[None], 1)
            else:  # one row for all
                place = np.empty(n, np.int64)
                place[np.argsort(ids[0], kind="stable")] = np.arange(n)
            some = np.argpartition(-np.where(there, scores * n - place, -(2**62)), top - 1, axis=1)[:, :top]
            scores, ids = np.take_along_axis(scores, some, 1), np.take_along_axis(ids, some, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :top]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in floating point where no sum can leave its exact range. Integer sums may wrap
    on the way, but not in the end, as no product of vectors within `MOST_NORM` passes 64 bits."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    if most < 2**53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return queries @ vectors.T


class _Part:
    """One part of the index: its blocks, and the best rows of queries in it."""

    def __init__(self, pivots: Pivots):
        self.pivots = pivots
        self.blocks: list[tuple[np.ndarray, np.ndarray]] = []
        self.keys: list[int] = []
        self.low: list[float] = []
        self.high: list[float] = []

    def add(self, key: int, low: float, high: float, ids: bytes, vs: bytes) -> None:
        own = np.frombuffer(ids, np.int64)
        self.blocks.append((own, np.frombuffer(vs, np.int64).reshape(len(own), self.pivots.width)))
        self.keys.append(key)
        self.low.append(low)
        self.high.append(high)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the best rows of each query in this part."""
        scores, ids = np.full((len(queries), top), NONE), np.full((len(queries), top), np.iinfo(np.int64).max)
        if not self.blocks:
            return scores, ids
        away, squares = _asked(self.pivots, queries)
        reach = _reach(self.pivots, away, squares, np.array(self.keys), np.array(self.low), np.array(self.high))
        # The blocks that promise most come first; each is opened for the queries that its bound still leaves a place.
        for b in np.argsort(-reach.max(axis=0), kind="stable"):
            some = np.flatnonzero(reach[:, b] >= np.maximum(floors, scores[:, -1]))
            if len(some):
                own_ids, vs = self.blocks[b]
                got = products(queries[some], vs)
                got[query_ids[some][:, None] == own_ids[None]] = NONE
                block_scores, block_ids = best(got, np.broadcast_to(own_ids, got.shape), top)
                scores[some], ids[some] = best(np.hstack((scores[some], block_scores)), np.hstack((ids[some], block_ids)), top)
        return scores, ids


def _searched(shared, top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams rows sorted by part, the index before the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value[0]
        at, part = None, _Part(pivots)
        for batch in batches:
            for number, kind, key, low, high, ids, vs, floors in zip(*(batch.column(c).to_pylist() for c in _PART_NAMES)):
                if number != at:
                    at, part = number, _Part(pivots)
                if kind == 0:
                    part.add(key, low, high, ids, vs)
                    continue
                query_ids, floor = np.frombuffer(ids, np.int64), np.frombuffer(floors, np.int64)
                queries = np.frombuffer(vs, np.int64).reshape(len(query_ids), pivots.width)
                scores, found = part.search(query_ids, queries, floor, top)
                good = (scores > NONE) & (scores >= floor[:, None])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.broadcast_to(query_ids[:, None], scores.shape)[good]), pa.array(found[good]), pa.array(scores[good])], names=["query_id", "vec_id", "score"]
                )

    return run


def search(vectors: DataFrame, top: int = TOP, step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score of the `top` best rows for each row whose id is divisible by `step`."""
    spark = vectors.sparkSession
    with scratch(spark):
        rows = materialize(integer_vectors(vectors), "vectors")
        shape = rows.agg(F.max(F.length("v") / 8).cast("int").alias("width"), F.max("norm").alias("largest"), F.count(F.lit(1)).alias("n")).first()
        width, largest, n = shape.width or 0, shape.largest or 0.0, shape.n
        drawn = rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(n, 1)))).select("vec_id", "v").limit(4 * SAMPLE).toPandas()
        drawn = drawn.sort_values(["vec_id", "v"])
        sample, sample_ids = unpack(list(drawn["v"]), width), drawn["vec_id"].to_numpy(np.int64)
        pivots = choose_pivots(sample, width, largest)
        keyed = materialize(rows.mapInArrow(_keyed(spark.sparkContext.broadcast(pivots)), "vec_id long, v binary, key int, distance double"), "keyed")
        layout = lay_out(keyed, width)
        shared = spark.sparkContext.broadcast((pivots, layout, sample, sample_ids))
        asked = keyed.where(F.pmod("vec_id", F.lit(step)) == 0).groupBy("vec_id").agg(F.min(F.struct("v", "key", "distance")).alias("q")).select("vec_id", "q.*")
        together = index_blocks(keyed, layout, width).unionByName(deal_queries(asked, shared, top))
        met = together.repartition(shuffle_partitions(spark), "part").sortWithinPartitions("part", "kind")
        found = met.mapInArrow(_searched(shared, top), "query_id long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return materialize(found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score"), "found", keep=True)


def op3_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"))


OP3_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
