"""Codon usage and keyed-table differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwise.operators.windows import TILE, window_text
from strandwise.sources.tables import codon_table


def codon_usage(cds: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """`accession, codon, cnt`: codons in frame that the table knows.

    Case-sensitive; a partial last codon is not in the table and falls out, as
    do accessions without any codon.
    """
    if table is None:
        table = codon_table(cds.sparkSession)
    width = TILE - TILE % 3
    tiles = cds.select(
        "accession",
        F.explode(F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{width}}}"), F.lit(0))).alias("text"),
    ).select("accession", F.col("text").cast("binary").alias("tile"))
    codons = (
        tiles.select(
            "accession",
            "tile",
            F.explode(F.sequence(F.lit(1), F.length("tile"), F.lit(3))).alias("i"),
        )
        .select("accession", window_text("tile", F.col("i"), 3).alias("codon"))
        .groupBy("accession", "codon")
        .agg(F.count("*").alias("cnt"))
    )
    return codons.join(table.select("codon"), "codon").select("accession", "codon", "cnt")


def relative_codon_freq(usage: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """`accession, codon, amino, rel_freq`: share among the synonymous codons.

    An amino acid an accession never uses has no rows (a missing feature is 0).
    """
    if table is None:
        table = codon_table(usage.sparkSession)
    named = usage.join(table.select("codon", "amino"), "codon")
    # At most six codons share an amino acid, so the window groups stay tiny.
    total = F.sum("cnt").over(Window.partitionBy("accession", "amino"))
    return named.select("accession", "codon", "amino", (F.col("cnt") / total).alias("rel_freq"))


def mapping_diff(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """`key, left_value, right_value` where two keyed tables disagree."""
    other = right.select(key, F.col(value).alias("right_value"))
    return (
        left.select(key, F.col(value).alias("left_value"))
        .join(other, key)
        .filter(~F.col("left_value").eqNullSafe(F.col("right_value")))
    )
