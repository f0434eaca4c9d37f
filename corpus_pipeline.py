"""From raw documents to token ids: five stages, each one of the training-data operators.

What holds for all stages: columns of any name pass through up to the last stage; doc_id is a whole number (or a string of
one) or null; very long texts are worked on whole; an empty table gives an empty one; equal rows fare alike, but for near
copies, where rows of one doc_id are one document.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of
documents. Between stages the rows are written as Parquet, in the cluster's shared folder, and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelake.llm import bpe, common, decontam, lines, quality, simhash


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this stage's labelled documents, doesn't reject.

    A null text is judged as an empty one; without labels of both classes the labels' mean decides for all, and without any label nothing is rejected.
    """
    return quality.filter_quality(docs, quality.fit(docs, common.read(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that occurred before; one that loses its every line goes.

    Null ids and null or empty texts stay as they are; of equal lines the first by doc_id stays.
    """
    return lines.filter_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least doc_id.

    Null ids, null texts and texts without a letter or digit are in no group and stay; rows of one doc_id stay or go together.
    """
    return simhash.filter_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no benchmark item lies with at most a tenth of its piece edited; null and empty texts stay, null and tiny items count for nothing."""
    return decontam.filter_leaks(docs, common.read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids of every document; null ids for a null text, none for an empty one."""
    return bpe.encode(docs)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: Classifier, signatures, alignment and pair merging are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table, nulls, empty and repeated rows included; all but the last stage's rows are written and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, name)
    return docs
