"""Sequence, CDS, motif and metadata views over the plain text tables.

The tables hold no DNA. Letters map onto bases (or onto IUPAC codes) by fixed
`translate` strings, so that any SQL engine derives the same views.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.plans.lineage import by_record as partition_by_record
from strandwise.plans.lineage import spread

# --- fixed values: letter tables of the derived views ---------------------
LETTERS = "abcdefghijklmnopqrstuvwxyz"
TO_BASES = "ACGTACGTACGTACGTACGTACGTAC"
TO_IUPAC = "ACGTRYKMBDHVNSWACGTACGTACG"
TO_MOSTLY_BASES = "ACGTACGTACGTACGTACGTACGRNC"


def letters_only(text: Column | str, target: str) -> Column:
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), LETTERS, target)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def sequences(
    spark: SparkSession, sf_dir: str, by_record: bool = False, target: str = TO_BASES
) -> DataFrame:
    """`(seq_id, seq)`. `by_record` shuffles the raw text once by `seq_id`, so that
    later grouping by record needs no shuffle of the far larger exploded rows;
    without it the scan is only spread when it has fewer splits than task slots.
    """
    docs = documents(spark, sf_dir, F.concat(F.lit("D"), "doc_id").alias("seq_id"), "text")
    if by_record:
        # A plain scan, so counting its splits runs nothing.
        docs = partition_by_record(docs, "seq_id", splits=docs.rdd.getNumPartitions())
    else:
        docs = spread(docs)
    return docs.select("seq_id", letters_only("text", target).alias("seq"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(accession, label, groups)` of the labelled documents."""
    docs = documents(spark, sf_dir, "doc_id", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return docs.join(labels, "doc_id").select(
        F.concat(F.lit("D"), "doc_id").alias("accession"),
        F.when(F.col("toxic") == 1, -1).otherwise(F.col("quality")).cast("int").alias("label"),
        F.col("source").alias("groups"),
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record ids in the two header styles: piped, and the bare accession."""
    docs = documents(spark, sf_dir, "doc_id", "lang", "source", "n_chars")
    acc = F.concat(F.lit("D"), "doc_id")
    piped = F.concat_ws("|", F.lit("acc"), "source", acc, "lang")
    return docs.select(
        "doc_id",
        F.when(F.col("lang") == "en", piped).otherwise(acc).alias("header"),
        F.when(
            F.col("lang") == "en",
            F.concat(F.lit("join("), acc, F.lit(":1-"), "n_chars", F.lit(",9-20")),
        )
        .otherwise(F.concat(acc, F.lit(":1-"), "n_chars"))
        .alias("cds_id"),
    )


def cds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(seq_id, accession, seq)`: every document as one coding sequence; the
    documents of one source and language share an accession."""
    docs = documents(
        spark,
        sf_dir,
        F.concat(F.lit("D"), "doc_id").alias("seq_id"),
        F.concat_ws("_", "source", "lang").alias("accession"),
        "text",
    )
    return spread(docs).select("seq_id", "accession", letters_only("text", TO_BASES).alias("seq"))


def iupac_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`(motif)`: distinct words, spelled in IUPAC codes."""
    docs = spread(documents(spark, sf_dir, "text"))
    words = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    return (
        words.filter(F.length("word") > 0)
        .select(F.translate("word", LETTERS, TO_IUPAC).alias("motif"))
        .distinct()
    )
