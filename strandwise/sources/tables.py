"""BED, metadata, coefficient, alphabet, grid and codon tables, in and out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions.nucleotide import accession
from strandwise.functions.protein import CODON_TABLE

BED_SCHEMA = "chr STRING, start INT, end INT, name STRING, score INT"
METADATA_SCHEMA = "accession STRING, label INT, species STRING, groups STRING"
# Bases of one sequence whose hits one task writes.
BED_STRETCH = 100_000
COEFFICIENT_SCHEMA = "motif STRING, coef DOUBLE"


def read_bed(spark: SparkSession, path: str, rvdb: bool = False) -> DataFrame:
    """One table of all headerless BED files in a folder (names contain `.bed`),
    and of both layouts of `write_bed`.

    `rvdb` turns piped sequence headers into their accession.
    """
    bed = (
        spark.read.schema(BED_SCHEMA)
        .option("sep", "\t")
        .option("recursiveFileLookup", True)
        .csv(path)
    )
    # Spark names the files; a folder's name tells BED files from others beside them.
    of_bed = F.col("_metadata.file_path").rlike(r"\.bed|/sequence=[^/]*/")
    bed = bed.filter(of_bed).select(*bed.columns)
    return bed.withColumn("chr", accession("chr")) if rvdb else bed


def write_bed(bed: DataFrame, path: str, per_sequence: bool = False) -> None:
    """Headerless BED files: one flat table, or one folder `sequence=<id>` per sequence.

    `|` in an id becomes `_` in the folder name. Rows are hashed by sequence and
    stretch of `BED_STRETCH` bases: a short sequence stays one file, a long one
    with most of the hits is written by many tasks. Very many sequences make
    very many folders; the flat table has no such limit.
    """
    columns = ["chr", "start", "end", "name", "score"]
    if not per_sequence:
        bed.select(*columns).write.mode("overwrite").option("sep", "\t").option(
            "header", False
        ).csv(f"{path}/all.bed")
        return
    (
        bed.select(
            F.replace("chr", F.lit("|"), F.lit("_")).alias("sequence"),
            F.floor(F.col("start") / BED_STRETCH).alias("stretch"),
            F.concat_ws("\t", *columns).alias("record"),
        )
        .repartition("sequence", "stretch")
        .drop("stretch")
        .write.mode("overwrite")
        .partitionBy("sequence")
        .text(path)
    )


def read_bed_folders(spark: SparkSession, path: str, rvdb: bool = False) -> DataFrame:
    """The table behind the per-sequence folders of `write_bed`; `read_bed` knows them too."""
    return read_bed(spark, path, rvdb)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Labels (`-1`, 0, 1) with optional `species` and `groups`, matched by name."""
    header = spark.read.option("header", True).option("sep", "\t").csv(path)
    fields = [f.split() for f in METADATA_SCHEMA.split(", ")]
    missing = {"accession", "label"} - set(header.columns)
    if missing:
        raise ValueError(f"metadata lacks {sorted(missing)}")
    # Labels written as 1.0, as when some are missing, are whole numbers too.
    number = F.col("label").cast("double")
    whole = F.when(number == F.floor(number), number).when(
        number.isNotNull(),
        F.raise_error(F.concat(F.lit("not a whole label: "), F.col("label"))).cast("double"),
    )
    columns = {n: F.col(n) if n in header.columns else F.lit(None) for n, _ in fields}
    return header.select(*[(whole if n == "label" else columns[n]).cast(t).alias(n) for n, t in fields])


def read_coefficients(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COEFFICIENT_SCHEMA).option("sep", "\t").csv(path)


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", header).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_degeneracy_summary(summary: DataFrame, path: str) -> None:
    """The two-line text report of `motif_degeneracy`."""
    # --- fixed values: report labels
    lines = F.array(
        F.concat(
            F.lit("Average number of degenerate positions:\t"), "avg_degenerate_positions"
        ),
        F.concat(
            F.lit("Average number of bases represented in degenerate motifs:\t"),
            "avg_represented_bases",
        ),
    )
    summary.select(F.explode(lines).alias("value")).write.mode("overwrite").text(path)


def write_complement_report(ratio: DataFrame, motifs: DataFrame, path: str) -> None:
    """Share of reverse-complement motifs, and the motifs themselves."""
    label = F.lit("Ratio of reverse complement motifs to total motifs in feature array: ")
    ratio.select(F.concat(label, "rev_comp_ratio").alias("value")).write.mode("overwrite").text(
        f"{path}/ratio"
    )
    write_tsv(motifs, f"{path}/motifs", header=False)


def read_alphabet(spark: SparkSession, path: str) -> dict[str, str]:
    """Residue -> class map of a small JSON object, X added."""
    text = "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())
    return {**json.loads(text), "X": "X"}


def alphabet_rows(spark: SparkSession, path: str) -> DataFrame:
    """The same map as rows `(residue, class)`."""
    obj = spark.read.option("wholetext", True).text(path)
    pairs = F.from_json("value", "map<string,string>")
    return obj.select(F.explode(pairs).alias("residue", "class"))


def read_grid(spark: SparkSession, path: str) -> dict[str, list]:
    """Parameter grid of the boosted trees: JSON object of lists."""
    text = "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())
    return {k: v if isinstance(v, list) else [v] for k, v in json.loads(text).items()}


def codon_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """`(codon, amino)`: the standard code, or a TSV with that header."""
    if path is None:
        return spark.createDataFrame(list(CODON_TABLE.items()), "codon STRING, amino STRING")
    return (
        spark.read.schema("codon STRING, amino STRING")
        .option("header", True)
        .option("sep", "\t")
        .csv(path)
    )


def write_kmer_matrix(matrix: DataFrame, path: str) -> None:
    """Long k-mer counts, one folder per replicon bin."""
    matrix.write.mode("overwrite").partitionBy("bin").parquet(path)


def read_kmer_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").parquet(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def unique_records(seqs: DataFrame, key: str = "seq_id") -> DataFrame:
    """One record per id (the largest by text), partial aggregation first."""
    others = [c for c in seqs.columns if c != key]
    return (
        seqs.groupBy(key)
        .agg(F.max(F.struct(*others)).alias("_r"))
        .select(key, *[F.col(f"_r.{c}").alias(c) for c in others])
    )


def duplicate_ids(seqs: DataFrame, key: str = "seq_id") -> DataFrame:
    """Ids that occur more than once, with their count."""
    return seqs.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
