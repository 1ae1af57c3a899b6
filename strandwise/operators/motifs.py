"""Summaries over sets of motifs, and consensus motifs of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.functions.nucleotide import (
    bit_plane,
    degenerate_positions,
    iupac_from_planes,
    represented_bases,
    reverse_complement,
)
from strandwise.plans.lineage import rank_within


def motif_degeneracy(motifs: DataFrame) -> DataFrame:
    """One row: mean degenerate positions and mean represented bases per motif."""
    return motifs.agg(
        F.avg(degenerate_positions("motif")).alias("avg_degenerate_positions"),
        (F.sum(represented_bases("motif")) / F.count("*")).alias("avg_represented_bases"),
    )


def rev_comp_motifs(motifs: DataFrame) -> DataFrame:
    """Motifs whose reverse complement is in the set as well."""
    own = motifs.select("motif")
    return own.intersect(own.select(reverse_complement("motif").alias("motif")))


def rev_comp_ratio(motifs: DataFrame) -> DataFrame:
    """Share of distinct motifs that have their reverse complement in the set.

    A motif and its reverse complement meet in one group, so a single shuffle
    answers it without a self-join.
    """
    both = motifs.select("motif", reverse_complement("motif").alias("rc"))
    pair = both.groupBy(
        F.least("motif", "rc").alias("lo"), F.greatest("motif", "rc").alias("hi")
    ).agg(
        F.max((F.col("motif") <= F.col("rc")).cast("int")).alias("has_lo"),
        F.max((F.col("motif") >= F.col("rc")).cast("int")).alias("has_hi"),
    )
    is_self = F.col("lo") == F.col("hi")
    size = F.when(is_self, 1).otherwise(F.col("has_lo") + F.col("has_hi"))
    shared = F.when(is_self, 1).when(F.col("has_lo") + F.col("has_hi") == 2, 2).otherwise(0)
    return pair.agg((F.sum(shared) / F.sum(size)).alias("rev_comp_ratio"))


def consensus_motif(clusters: DataFrame, prefix: str = "motif", by: str | None = None) -> DataFrame:
    """`cluster_id, motif_id, motif`: the IUPAC consensus of each cluster.

    With `by` clusters are numbered inside each of its groups.

    `clusters` holds `cluster_id, kmer`. Per base one bit plane is OR-ed over
    the members: four BIGINTs per cluster, combined map-side, however large the
    cluster. Clusters are numbered by their smallest k-mer.
    """
    planes = {b: F.bit_or(bit_plane("kmer", b)).alias(f"_{b}") for b in "ACGT"}
    part = [by] if by else []
    merged = clusters.groupBy(*part, "cluster_id").agg(
        *planes.values(),
        F.max(F.length("kmer")).alias("_k"),
        F.min("kmer").alias("_first"),
    )
    motif = iupac_from_planes(*[F.col(f"_{b}") for b in "ACGT"], F.col("_k"))
    numbered = rank_within(
        merged.select(*part, "cluster_id", "_first", motif.alias("motif")), part, ["_first"], "_n"
    )
    return numbered.select(
        *part, "cluster_id", F.concat(F.lit(prefix), F.col("_n")).alias("motif_id"), "motif"
    )
