"""From raw documents to token ids: five stages, each applying one operator to what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, language, sentencepiece_bpe, simhash, toxicity
from corpusloom.llm.common import table
from corpusloom.llm.queries import digest_of_ids, piece_model
from corpusloom.session import checkpointed

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language is less likely than this are dropped.
LEAST_LANGUAGE_SCORE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't predict as toxic.

    Null and empty texts get the bias as their score; repeated rows are judged each; an empty table stays empty.
    """
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.train(docs, labels, "crc32(cast(doc_id as string)) % 5 <> 0")
    scored = toxicity.with_toxicity(docs.select(*COLUMNS), model)
    return scored.where(F.col("predicted") == 0).select(*COLUMNS)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned and is predicted with enough confidence.

    Null texts and those without a letter have no language and go, as does everything when nothing can be learned.
    """
    model = language.train(docs, "crc32(cast(doc_id as string)) % 4 <> 2")
    guessed = language.with_language(docs.select(*COLUMNS), model)
    sure = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return guessed.where(sure).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest id, null ids last.

    Near means within 3 bits of fingerprints over runs of three words, as in op1. Null and empty texts have the
    fingerprint zero and are one class; of repeated rows one stays.
    """
    return simhash.drop_near_duplicates(docs.select(*COLUMNS))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts have none; repeated rows stay or go alike."""
    benchmark = table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), benchmark).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the token ids of each document, and the digest of the text they decode to.

    Null texts are empty and have no ids; repeated rows are encoded each.
    """
    return digest_of_ids(sentencepiece_bpe.encode_and_decode(docs.select("doc_id", "text"), piece_model()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("sentencepiece", encode_pieces),
]

#: The classifiers, the component search and the merges can't be stated in SQL; tests use plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what one keeps is stored before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
