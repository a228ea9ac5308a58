"""Corpus pipeline: the stages run one after the other, each on what its predecessor has written.

In every stage: columns besides ``doc_id``, ``text`` and ``n_chars`` are passed on unread, null in them or not; an empty
table gives an empty result; a text of any length is treated whole; rows that repeat get equal results, and both stay
unless a stage says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import bpe, decontamination, near_dedup, quality_rules, substring_dedup
from tidegate.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line labelling and the base rules keep.

    Null and empty texts have too few words and go.  Ids play no part but in which documents lend labelled lines.
    """
    return quality_rules.retained(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates.

    Rows with a null id and texts without words stay.  Rows with one id are one document: all of them stay, or none.
    """
    return near_dedup.one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 50-word passages that stand in a document with a smaller id; ``n_chars`` follows.

    Null texts stay null, texts of fewer words stay as they are; a null id removes nothing and loses nothing, and rows
    of one id do not remove each other's words.
    """
    return substring_dedup.without_repeats(docs, 50).withColumn(
        "n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay, whatever their id; null and empty items are in no text.
    """
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and the text as the ids decode to it.

    A null or empty text has no ids and becomes empty.
    """
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encoded(docs, path, pattern).withColumn("text", bpe.decoder(path, pattern)("ids").cast("string"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("near_dedup", one_of_each),
    ("substring_dedup", drop_repeats),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]

#: The stages' methods (labelling, sketching, alignment, merges) have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again.

    The rows are those that every stage keeps; an empty table gives none.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
