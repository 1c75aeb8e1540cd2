"""Quality classifier: supervised subword embeddings trained by stochastic gradient descent in numpy.

A document is the mean of learned vectors of its hashed words and character n-grams, read by a softmax over the labels 0
and 1. After training, each bucket's vector counts only through the difference of the two outputs, so scoring looks up one
number for each feature. Training uses a bounded sample; scoring covers every whole text.

One kind of feature goes beyond words and n-grams: that a word is the same as the one so many words before has a learned vector
as well. A mean of word vectors cannot see repetition in itself, and texts of low quality repeat words of any kind: on held-out
labels the plain features rank 0.91 of the pairs right, these all of them (README).

Defined cases: a null or empty text has only the feature every document has; labels other than 0 and 1 and unlabelled rows
train nothing; of several labels of a document the highest counts; without training rows every score is 0.5; words longer
than a piece of text are cut there; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import crc_bucket, pick, read

ORDERS = (3, 4, 5)
BUCKET_BITS = 18
#: Bound of the training sample, in documents of each label.
TRAIN_PER_LABEL = 2000
DIMENSIONS = 16
#: Steps of gradient descent; both labels are drawn equally often.
STEPS = 24_000
RATE = 0.5
HELD_OUT_OF = 3
PIECE_CHARS = 1 << 18
_EVERY = 0
#: A word that is the same as the one so many words before is a feature as well; its bucket is the distance.
REPEATS = (1, 2, 3)


def _points(text: str) -> np.ndarray:
    """Code points with white space as 32, one more on either side."""
    points = np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    points[(points < 32) | (points == 0x85) | (points == 0xA0)] = 32
    return points


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[np.ndarray]:
    """Parts of a text, cut at spaces where there are any."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            space = text.rfind(" ", at + 1, end)
            end = space if space > at else end
        yield _points(text[at:end])
        at = end


def features(points: np.ndarray) -> np.ndarray:
    """Buckets of all words and of the character n-grams inside them; an n-gram may hold a space only at its ends."""
    space = points == 32
    before = np.concatenate(([0], np.cumsum(space)))
    found = []
    for order in ORDERS:
        n = len(points) - order + 1
        if n < 1:
            continue
        h = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(order):
            h ^= points[k : k + n]
            h *= np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        inside = before[order - 1 : order - 1 + n] == before[1 : 1 + n]
        found.append(h[inside] * np.uint32(0x9E3779B1) >> np.uint32(32 - BUCKET_BITS))
    edges = np.flatnonzero(space)
    starts, ends = edges[:-1] + 1, edges[1:]
    real = ends > starts
    # A word's hash is a polynomial of its code points, from prefix sums, with the place's power divided out.
    base, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(points), base, np.uint64))), dtype=np.uint64)
    back = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(points), inverse, np.uint64))), dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(points.astype(np.uint64) * powers[:-1], dtype=np.uint64)))
    word = (sums[ends[real]] - sums[starts[real]]) * back[starts[real]]
    word ^= word >> np.uint64(29)
    word *= np.uint64(0xBF58476D1CE4E5B9)
    found.append((word >> np.uint64(64 - BUCKET_BITS)).astype(np.uint32))
    for lag in REPEATS:
        found.append(np.full(int((word[lag:] == word[:-lag]).sum()), lag, np.uint32))
    return np.concatenate(found)


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a document and how often each occurs."""
    got = [np.array([_EVERY], np.uint32), *(features(p) for p in pieces(text or ""))]
    return np.unique(np.concatenate(got), return_counts=True)


def fit(samples: list[tuple[int, np.ndarray, np.ndarray]], dimensions: int = DIMENSIONS, steps: int = STEPS, rate: float = RATE, seed: int = 7) -> np.ndarray:
    """Gradient descent one document at a time; returns each bucket's contribution to the log-odds of label 1."""
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((1 << BUCKET_BITS, dimensions), dtype=np.float32) - 0.5) * (2 / dimensions)).astype(np.float32)
    outputs = np.zeros((2, dimensions), np.float32)
    of_label = [group for label in (0, 1) if (group := [k for k, s in enumerate(samples) if s[0] == label])]
    order = np.stack([np.resize(rng.permutation(group), -(-steps // len(of_label))) for group in of_label], 1).ravel() if of_label else []
    for done, k in enumerate(order):
        label, at, counts = samples[k]
        weights = (counts / counts.sum()).astype(np.float32)
        hidden = weights @ vectors[at]
        logits = outputs @ hidden
        chance = np.exp(logits - logits.max())
        chance /= chance.sum()
        chance[label] -= 1
        now = np.float32(rate * (1 - done / len(order)))
        pull = chance @ outputs
        outputs -= now * np.outer(chance, hidden)
        vectors[at] -= now * np.outer(weights, pull)
    return (vectors @ (outputs[1] - outputs[0])).astype(np.float32)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [document_features(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("quality"), pa.array([a.astype(np.uint32).tobytes() for a, _ in got], pa.binary()), pa.array([c.astype(np.uint32).tobytes() for _, c in got], pa.binary())],
            names=["doc_id", "quality", "at", "counts"],
        )


def train(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL) -> np.ndarray:
    """Learns from about `per_label` documents of each label at most, drawn by hash of the id."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = pick(labels, "doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    sizes = {r.quality: r.n for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return np.zeros(1 << BUCKET_BITS, np.float32)
    share = F.create_map(*(x for q, n in sizes.items() for x in (F.lit(q), F.lit(per_label / n))))
    # At most about 2 * per_label ids, so the broadcast is bounded by a parameter.
    drawn = known.where(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 20)) < share[F.col("quality")] * (1 << 20))
    joined = pick(docs, "doc_id", "text").join(F.broadcast(drawn), "doc_id")
    # Rows that repeat an id count once, so that they can't outgrow the sample.
    rows = joined.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    found = rows.mapInArrow(_sampled, f"doc_id {kind}, quality int, at binary, counts binary").toPandas()
    found = found.sort_values(["doc_id", "at"], kind="stable")
    return fit([(q, np.frombuffer(a, np.uint32), np.frombuffer(c, np.uint32)) for q, a, c in zip(found["quality"], found["at"], found["counts"])])


def _scorer(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def mean_odds(texts: list[str | None], odds: np.ndarray) -> np.ndarray:
        sums, counts = np.full(len(texts), float(odds[_EVERY])), np.ones(len(texts))
        for k, text in enumerate(texts):
            for part in pieces(text or ""):
                found = odds[features(part)]
                sums[k] += found.sum(dtype=np.float64)
                counts[k] += len(found)
        return sums / counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = shared.value
        for batch in batches:
            scores = 1 / (1 + np.exp(-np.clip(mean_odds(batch.column("text").to_pylist(), odds), -500, 500)))
            kept = [(f.name, batch.column(f.name)) for f in batch.schema if f.name != "text"]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[*(n for n, _ in kept), "score", "predicted"])

    return run


def score(docs: DataFrame, odds: np.ndarray) -> DataFrame:
    """doc_id (and held_out, if there), score and predicted of every row; the broadcast has one number for each bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(odds)
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(_scorer(shared), f"{head}, score double, predicted int")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = crc_bucket(F.col("doc_id"), HELD_OUT_OF) == 1
    labels = read(spark, sf_dir, "labels")
    odds = train(docs, labels.where(crc_bucket(F.col("doc_id"), HELD_OUT_OF) != 1))
    return score(docs.select("doc_id", held_out.alias("held_out"), "text"), odds)
