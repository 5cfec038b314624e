"""A corpus pipeline: quality, exact copies, near copies, benchmark passages, encoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodelake.llm.common import written
from episodelake.llm.corpus_queries import table, tokenizer_file
from episodelake.llm.decontaminate import decontaminate
from episodelake.llm.exact_dedup import exact_dedup
from episodelake.llm.near_dedup import near_duplicates
from episodelake.llm.quality import held_out, score_quality
from episodelake.llm.sentencepiece_codec import encode_texts

#: The stages have no SQL twin: their models, signatures and encodings are tested against brute force.
ORACLE_SQL = None


def keep(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of the documents that the decisions (doc_id) name; a null id names the rows without one.

    Rows that share an id are one document: all of them stay if one of them does.
    """
    ids = decisions.select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of label 1; all of them where there are no labels of both kinds to learn from."""
    labels = table(spark, sf_dir, "labels")
    known = labels.join(docs.select("doc_id"), "doc_id", "left_semi").where("quality in (0, 1)").where(~held_out("doc_id"))
    if known.select("quality").distinct().count() < 2:
        return docs
    return keep(docs, score_quality(docs, labels).where("predicted = 1"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    return keep(docs, exact_dedup(docs).where("kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the document with the smallest id."""
    return keep(docs, near_duplicates(docs).where("kept"))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return keep(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")).where("not contaminated"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' SentencePiece ids, as counts and digests, with the round trip checked."""
    return encode_texts(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written and reread before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
