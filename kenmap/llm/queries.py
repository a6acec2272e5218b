"""The queries of this subpackage, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kenmap.llm import binary_output, bpe, hard_negatives, imatch, jaccard, licenses, packing, periodic, pii, quality, sharding, token_count, toxicity

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every document and decodes it again."""
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), WORD_BPE)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every document with every other, as components."""
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the labels that are not held out and scores every document."""
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_count.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op6_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into matrices of token ids."""
    return binary_output.packed_rows(table(spark, sf_dir, "documents"), WORD_BPE)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.report(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector; every seventh label is moved by one, as the contract has it."""
    moved = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")
    return hard_negatives.mine(hard_negatives.prepared(table(spark, sf_dir, "embeddings").withColumn("label", moved)))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every document."""
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document in which the contract of op13 repeats a stretch; without doc_id they stay."""
    if doc_id is None or not words or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document."""
    return periodic.digest(periodic.periodic_runs(table(spark, sf_dir, "documents"), planted))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_jaccard_join, op3_toxicity, op4_token_counts, op5_quality_rules, op6_binary_output, op7_best_fit_packing, op8_imatch, op9_pii, op10_sharding, op11_hard_negatives, op12_licenses, op13_periodic_runs)}
ORACLE_SQL: dict[str, str] = {"op2_jaccard_join": jaccard.ORACLE_SQL, "op5_quality_rules": quality.ORACLE_SQL, "op11_hard_negatives": hard_negatives.ORACLE_SQL}
