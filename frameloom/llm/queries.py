"""The queries opN_<name> over the whole text tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from frameloom.llm import collocations, conversation_repair, decontamination, hamming_index, jaccard_join, license_scan, quality_classifier, quality_rules, secret_scan, sentencepiece_scan, sstable, suffix_tree, token_counts
from frameloom.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with each benchmark item of which it has a passage: score, and the passage's words."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and checksum of each document's ids, and whether the text comes back from them."""
    return sentencepiece_scan.round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, the votes of the rules, the posterior and the verdict of each document."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, smallest linked identifier and number of links of each document."""
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each document by a machine that learns from labelled rows, but for held-out ones."""
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of base spans, their digest, and all spans of each document."""
    return secret_scan.secret_spans(table(spark, sf_dir, "documents"))


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and tree log-probabilities of each document."""
    return suffix_tree.lm_scores(table(spark, sf_dir, "documents"))


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of each document's ids as read back from the shards."""
    return sstable.token_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of each document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, places of base phrases, labels and score of each document."""
    return license_scan.licenses(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first phrases by how much their words go together."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_hamming_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows that the index finds for each fiftieth row."""
    return hamming_index.embedding_search(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of each conversation after damage, its cheapest repair, and a hash of what that gives."""
    return conversation_repair.repairs(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_sentencepiece, op3_quality_rules, op4_jaccard_join, op5_quality_classifier, op6_secret_scan, op7_suffix_tree, op8_token_shards, op9_token_counts, op10_license_scan, op11_collocations, op12_hamming_index, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op10_license_scan": license_scan.oracle_sql(), "op11_collocations": collocations.ORACLE}
