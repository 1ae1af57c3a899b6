"""FASTA in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FASTA_GLOB = "*.{fna,fasta}*"


def _chunks(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    """Text between record marks, with the file and the row's place in the scan."""
    reader = spark.read.option("lineSep", "\n>")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("place"),
    )


def _preambles(chunks: DataFrame) -> DataFrame:
    """The first chunk of each file that does not begin with a record mark."""
    first = F.min(F.struct("place", F.col("value").startswith(">").alias("marked")))
    return (
        chunks.groupBy("file")
        .agg(first.alias("first"))
        .filter(~F.col("first.marked"))
        .select("file", F.col("first.place").alias("place"))
    )


def read_fasta(
    spark: SparkSession, path: str, glob: str | None = None, clean: bool = False
) -> DataFrame:
    """`sequences(seq_id, description, seq)` of a FASTA file or folder.

    `glob` limits a folder to matching names. Each record is one row however
    long it is; gzip files are decompressed on the fly. Text before a file's
    first `>` is dropped: one extra pass looks for such files, and only if it
    finds any are their first chunks taken out. `clean=True` skips that pass.
    """
    chunks = _chunks(spark, path, glob)
    if not clean:
        preambles = _preambles(chunks)
        if not preambles.isEmpty():
            chunks = chunks.join(preambles, ["file", "place"], "left_anti")
    record = F.regexp_replace("value", "^>", "")
    head = F.substring_index("record", "\n", 1)
    description = F.trim(F.regexp_replace(head, "\r", ""))
    seq = F.substr("record", F.length(head) + 2, F.length("record"))
    return (
        chunks.select(record.alias("record"))
        .select(
            F.get(F.split(description, r"\s+", 2), F.lit(0)).alias("seq_id"),
            description.alias("description"),
            F.regexp_replace(seq, r"\s", "").alias("seq"),
        )
    )


def read_fasta_folder(spark: SparkSession, path: str, clean: bool = False) -> DataFrame:
    """All files of a folder whose name contains `.fna` or `.fasta`."""
    return read_fasta(spark, path, FASTA_GLOB, clean)


def write_fasta(df: DataFrame, path: str, id_col: str, seq_col: str) -> None:
    """One record per row, id in the header and the sequence on one line."""
    record = F.concat(F.lit(">"), id_col, F.lit("\n"), seq_col)
    df.select(record.alias("value")).write.mode("overwrite").text(path)
