"""The corpus pipeline: quality, near duplicates, decontamination, secrets and encoding, in this order.

Each stage takes what its predecessor kept, with the columns of documents; the last one returns token ids. Columns beside
doc_id and text are carried along as they are, nulls and clashing names too; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from frameloom.llm import decontamination, jaccard_join, quality_classifier, secret_scan, sentencepiece_scan
from frameloom.llm.common import materialize, table
from frameloom.runtime import make_importable


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts are scored like others; rows without an identifier
    are never learned from; repeated rows stay. Without labels of both kinds all get one score, and are kept if it is 0.5
    or more."""
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest identifier; of rows with one identifier, one. Null
    and empty texts are duplicates of nothing, and rows without an identifier stay."""
    make_importable(spark)
    return jaccard_join.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark. Null and empty texts and items match nothing, so without items all stay;
    repeated rows share their fate."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark for each secret and n_chars counted anew where there is one. Null texts stay null; repeated
    rows change alike."""
    make_importable(spark)
    return secret_scan.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document; none for null and empty texts, and a row for each repeated one."""
    make_importable(spark)
    return sentencepiece_scan.token_lists(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("encode", encode)]
#: The classifier's training and the segmentation can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to what the one before it has written to the shared folder, so none runs twice."""
    docs = table(spark, sf_dir, "documents")
    *before, (_, last) = STAGES
    for name, stage in before:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return last(spark, docs, sf_dir)
