"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and everything but letters becomes a space; n-grams of one to three characters are hashed into
buckets. Counts of a bounded training sample give a bucket-by-language matrix of log-probabilities, which is broadcast
(buckets times languages numbers, whatever the input). Scoring walks each batch's n-grams sparsely in numpy. Sums over the
overlapping orders count the same letters several times and are divided by their number, which tempers the score only.

Defined cases: a null text or one without letters is `und` with score 0; rows without lang train nothing; with no training
row at all every text is `und`; beyond `MAX_LANGUAGES` the rarest lang values train nothing; ties go to the language first in
order; texts of any length are scored whole, in pieces whose sums add up; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import crc_bucket, pick, read, released

ORDERS = (1, 2, 3)
BUCKET_BITS = 16
#: Bound of the training sample, in documents of each language.
TRAIN_PER_LANGUAGE = 4000
#: Languages that are learned: the most frequent ones, which bounds the matrix.
MAX_LANGUAGES = 500
HELD_OUT_OF = 5
PIECE_CHARS = 1 << 19
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def pieces(texts: list[str | None], size: int = PIECE_CHARS) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Groups of (document, code points) of at most about `size` characters; a longer text is cut into overlapping pieces,
    so that each n-gram starts in one piece only."""
    who: list[int] = []
    held: list[np.ndarray] = []
    total, overlap = 0, max(ORDERS) - 1
    for k, text in enumerate(texts):
        if not text:
            continue
        points = np.frombuffer((text.lower() + " " * overlap).encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(_is_letter()[points], points, 32)
        for start in range(0, len(points) - overlap, size):
            part = points[start : start + size + overlap]
            who.append(k)
            held.append(part)
            total += len(part)
            if total >= size:
                yield who, held
                who, held, total = [], [], 0
    if who:
        yield who, held


def buckets(points: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each place; multiplicative hashing in 32 bits."""
    n = len(points) - max(ORDERS) + 1
    h = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        h ^= points[k : k + n].astype(np.uint32)
        h *= np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x9E3779B1)
    return h >> np.uint32(32 - BUCKET_BITS)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    #: log P(bucket | language), less the mean over languages, which changes no comparison and keeps sums exact enough.
    log_probability: np.ndarray
    prior: np.ndarray
    #: Which buckets any training text has; without it all count as such.
    held: np.ndarray | None = None

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its chance among the languages."""
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, chance and fit: the share of the longest n-grams that begin with a letter and that training texts had. The
        chance compares languages that are known, whatever the text's own; the fit is low where that is none of them."""
        n = len(self.languages)
        sums, letters, fitting = np.zeros((len(texts), n)), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for who, held in pieces(texts):
            points = np.concatenate(held)
            overlap = max(ORDERS) - 1
            starts = np.cumsum([0, *map(len, held)])[:-1]
            seen = points[: len(points) - overlap] != 32
            # The places where the next piece's characters would be read belong to nobody.
            lengths = np.array([len(h) - overlap for h in held])
            own = np.zeros(len(points) + 1, np.int8)
            own[starts] += 1
            own[starts + lengths] -= 1
            seen_at = np.flatnonzero(np.cumsum(own[: len(points) - overlap]) > 0)
            places = np.searchsorted(seen_at, starts)
            np.add.at(letters, who, np.add.reduceat(seen[seen_at].astype(np.int64), places))
            for order in ORDERS:
                at = buckets(points, order)[seen_at]
                got = self.log_probability[at]
                np.add.at(sums, who, np.add.reduceat(got, places, axis=0, dtype=np.float64))
            met = seen[seen_at] if self.held is None else seen[seen_at] & self.held[at]
            np.add.at(fitting, who, np.add.reduceat(met.astype(np.int64), places))
        if n:
            # Overlapping orders count the same evidence several times.
            logits = sums / len(ORDERS) + self.prior
            best = logits.argmax(axis=1)
            spread = np.exp(logits - logits.max(axis=1, keepdims=True))
            chance = spread.max(axis=1) / spread.sum(axis=1)
        known = letters > 0 if n else np.zeros(len(texts), bool)
        which = [self.languages[best[k]] if known[k] else UNKNOWN for k in range(len(texts))]
        return which, [float(chance[k]) if known[k] else 0.0 for k in range(len(texts))], (fitting / np.maximum(letters, 1)).tolist()


def _counts(languages: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {lang: np.zeros(1 << BUCKET_BITS, np.int64) for lang in languages}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for who, held in pieces(batch.column(1).to_pylist()):
                for k, points in zip(who, held):
                    for order in ORDERS:
                        table[langs[k]] += np.bincount(buckets(points, order), minlength=1 << BUCKET_BITS)
        for lang, counts in table.items():
            at = np.flatnonzero(counts)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(counts[at])], names=["lang", "bucket", "n"])

    return run


def train(labelled: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, smoothing: float = 0.5) -> LanguageModel:
    """Fits on about `per_language` rows of each language at most (doc_id, text, lang; null lang ignored).

    Rows are drawn by a hash of id and text: by the text alone, a text with many copies could be drawn with all of them.
    """
    rows = pick(labelled, "doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel((), np.zeros((1 << BUCKET_BITS, 0)), np.zeros(0))
    rows = rows.where(F.col("lang").isin(languages))
    share = F.create_map(*(x for lang in languages for x in (F.lit(lang), F.lit(per_language / sizes[lang]))))
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("lang", "text")
    # The sample is bounded, so a fixed number of tasks counts it; their counts are summed by bucket before they leave.
    counted = sample.repartition(24).mapInArrow(_counts(languages), "lang string, bucket int, n long")
    counts = np.zeros((len(languages), 1 << BUCKET_BITS))
    got = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    where = {lang: k for k, lang in enumerate(languages)}
    counts[got["lang"].map(where).to_numpy(int), got["bucket"].to_numpy(int)] = got["n"].to_numpy(float)
    log_probability = np.log(counts + smoothing) - np.log((counts + smoothing).sum(axis=1, keepdims=True))
    log_probability -= log_probability.mean(axis=0, keepdims=True)
    total = np.array([sizes[lang] for lang in languages], float)
    return LanguageModel(tuple(languages), np.ascontiguousarray(log_probability.T, np.float32), np.log(total / total.sum()), counts.any(axis=0))


def _scorer(shared, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                some = batch.slice(part, 1000)
                langs, scores, fits = shared.value.judge(some.column("text").to_pylist())
                kept = [f.name for f in some.schema if f.name not in names]
                told = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.float64())]
                yield pa.RecordBatch.from_arrays([*(some.column(n) for n in kept), *told], names=[*kept, *names])

    return released(run)


def identify(docs: DataFrame, model: LanguageModel, names: tuple[str, str, str] = ("lang_pred", "score", "fit")) -> DataFrame:
    """The rows with lang_pred, score and fit, under these or other names; columns that already had the names are replaced."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name not in names]
    return docs.mapInArrow(_scorer(shared, list(names)), StructType([*fields, StructField(names[0], StringType()), *(StructField(n, DoubleType()) for n in names[1:])]))


def learn(docs: DataFrame) -> LanguageModel:
    """The model of the documents' own lang values, learned from those that are not held out."""
    return train(docs.where(crc_bucket(F.col("doc_id"), HELD_OUT_OF) != 0))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = learn(docs)
    rows = docs.select("doc_id", (crc_bucket(F.col("doc_id"), HELD_OUT_OF) == 0).alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")
