"""Corpus pipeline: stages over the documents table, each written and read again before the next.

1. language: documents without a recognisable language go.
2. near copies: of each group of near copies (five-word shingles, likeness 0.8 or more) one document stays.
3. mixing: sources are brought to their target weights; a document comes 0 to 3 times.
4. sentencepiece: whole texts become piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tmweave.llm import jaccard_join, language_id, mixing, queries, sentencepiece_wfst
from tmweave.llm.common import discard, stage, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows whose text has a recognisable language, all columns as they are. Null, empty and letterless texts go; of an empty table nothing is learned and nothing is left.

    The languages are learned from the labelled rows of docs; those held out say how much evidence a text needs.
    """
    model = language_id.calibrate(docs, language_id.fit(docs, ~language_id.held_out()), language_id.held_out())
    return language_id.recognised(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies; documents without words stay."""
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it; those taken 0 times go. Null sources are a source of their own."""
    return mixing.mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids and round_trip of each row; a null text has no ids."""
    return sentencepiece_wfst.encode(docs, queries.vocabulary("piece_bpe_32k.model"))


STAGES = [("language", language), ("near copies", near_copies), ("mixing", mix_sources), ("sentencepiece", sentencepiece)]
#: Neither a learned classifier nor the encoder can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result over the documents of sf_dir. What a stage wrote is deleted when the next one has read it."""
    docs, read = table(spark, sf_dir, "documents"), []
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        discard(*read)
        read = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
