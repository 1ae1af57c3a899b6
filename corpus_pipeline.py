"""From raw documents to packed training sequences: five stages, each written and read again.

Quality classifier and quality rules drop what they reject, one document of each
near-duplicate group stays, repeated passages are cut out, the rest is packed.

Defined results: a null text is judged like an empty one, which the quality rules
drop. Copies and near copies leave the smallest doc_id; of several rows with that
id the first of the scan stays. A document whose text is all cut is packed as its
end id. Further columns pass through all stages but the last. An empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm import chunks, packing, quality_rules, quality_trees, simhash
from strandwise.llm.common import shared_folder
from strandwise.llm.queries import BPE_50K


def beside(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`operator(docs)` with the columns of `docs`, whatever columns the operator adds.

    The caller's further columns travel under other names, so that none is taken for an operator's.
    """
    names = {c: f"caller_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    out = operator(docs.withColumnsRenamed(names))
    return out.select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    trees = quality_trees.fit_quality(docs, labels, F.lit(True))
    return beside(docs, lambda d: quality_trees.score_quality(d, trees).where("predicted = 1"))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # The stage before has rejected most rows of label 0: the fit reads the whole table.
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = quality_rules.fit_rules(whole, labels, F.lit(True))
    return beside(docs, lambda d: quality_rules.judge(d, rules).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints, by the shingle length and distance of op6."""
    return simhash.one_of_each(docs, size=simhash.SHINGLE, limit=simhash.DISTANCE)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; n_chars follows the text."""
    left = beside(docs, chunks.without_passages)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, BPE_50K)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules_stage),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", substring_dedup),
    ("packing", packed),
]
#: Model fits and rolling hashes have no SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
