"""The corpus pipeline: language, lines, near copies, benchmark passages, tokens.

Each stage takes the documents its predecessor kept, written and read again, and returns the documents it keeps with all
their columns; the last returns token ids. Texts change where lines or passages are cut; nothing else does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import byte_bpe, decontamination, language_id, line_dedup, near_dedup
from pagewright.llm.common import fresh, materialize, read, scratch

#: A document whose best language is less likely than this is in no language known.
LEAST_CHANCE = 0.5
#: A document is in no language known either if less of its n-grams than this were met in training.
LEAST_FIT = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language the model knows; those without letters, without a likely language or in one that was never
    learned go."""
    lang, score, fit = fresh(docs.columns, "lang_pred", "score", "fit")
    found = language_id.identify(docs, language_id.learn(docs), (lang, score, fit))
    likely = (F.col(score) >= LEAST_CHANCE) & (F.col(fit) >= LEAST_FIT)
    return found.where((F.col(lang) != language_id.UNKNOWN) & likely).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines found in many documents; a document stays even when no line is left."""
    return line_dedup.dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies."""
    return near_dedup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of benchmark items; a document that is little else goes."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of ids and decoded bytes."""
    return byte_bpe.encode(docs, *byte_bpe.public_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language id", identify_language),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("byte bpe", tokenize),
]

#: The learned language model and Order MinHash have no SQL form; a brute-force version stands in the tests.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    # Only the last stage's table stays.
    with scratch(spark):
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"), keep=name == STAGES[-1][0])
    return docs
