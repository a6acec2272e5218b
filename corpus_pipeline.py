"""A corpus pipeline of five stages, each on all that the stage before kept.

Each stage is a function of (spark, docs, sf_dir); ``run`` writes each result as Parquet in the shared
folder of the cluster and gives the reread table to the next stage.  All but the last return the
columns of ``documents``.

Defined results of every stage: a null text is the empty text; rows without doc_id pass through a filter like any other;
repeated rows give repeated results but for the join, which keeps one; an empty table stays empty; extra columns pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kenmap.llm import jaccard, packing, pii, quality, toxicity
from kenmap.llm.queries import WORD_BPE, table
from kenmap.plans import storage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that the rules reject."""
    return quality.clean(docs)


def toxicity_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the model is learnt from the labelled ones that are not held out."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one stays: that with the smallest doc_id.

    Documents without doc_id stay.  Where a doc_id repeats, its different texts are documents of their own (under a hash of id and
    text), so that none goes that links with nothing; its equal rows are one document and stay once.
    """
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").selectExpr("doc_id as again")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("key"), "text")
    repeats = not twice.isEmpty()
    if repeats:
        packed = packed.join(twice, F.col("key") == F.col("again"), "left").selectExpr("row", "if(again is null, key, xxhash64(key, text)) as key", "text", "again")
    joined = jaccard.jaccard_join(packed.selectExpr("key as doc_id", "text"))
    gone = joined.where("component_id <> doc_id").selectExpr("doc_id as key").distinct()
    left = packed.join(gone, "key", "left_anti")
    if repeats:
        numbered = left.where("again is not null").withColumn("copy", F.expr("row_number() over (partition by key order by again)")).where("copy = 1")
        left = left.where("again is null").select("row").union(numbered.select("row"))
    return left.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms are generalised."""
    return pii.sanitise(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, WORD_BPE, lean=True)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_scan),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("best-fit packing", best_fit),
]

#: SQL can't express the stages after the first; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{storage.folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
