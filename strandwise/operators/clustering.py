"""Average-linkage clusters of k-mers, cut at a Hamming distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.operators.pairs import BUCKET_ROWS, cut_radius, hamming_pairs
from strandwise.plans.lineage import cut_lineage, drop_table, dense_index

BASES = "ACGT"


def _profile(kmer: str, k: int) -> Column:
    """4k counts: for each position one slot per base."""
    slots = [
        f"CAST(substr({kmer}, {p + 1}, 1) = '{b}' AS BIGINT)" for p in range(k) for b in BASES
    ]
    return F.expr(f"array({', '.join(slots)})")


def _scored(edges: DataFrame, clusters: DataFrame, k: int, cut: float) -> DataFrame:
    """Edges with their average distance, those above the cut dropped for good.

    The average Hamming distance of two clusters needs only their base counts
    per position: equal letter pairs are the dot product of the profiles.
    """
    a = clusters.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("profile").alias("pa"))
    b = clusters.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("profile").alias("pb"))
    # Spelled out term by term, the dot product stays inside generated code.
    equal = F.expr(" + ".join(f"pa[{i}] * pb[{i}]" for i in range(4 * k)))
    # One division of exact integers, so equal ratios compare equal.
    possible = k * F.col("na") * F.col("nb")
    return (
        edges.join(a, "a")
        .join(b, "b")
        .select("a", "b", ((possible - equal) / possible).alias("avg"))
        .filter(F.col("avg") <= cut)
    )


def _reciprocal(scored: DataFrame) -> DataFrame:
    """`hi, lo`: pairs in which each cluster is the other's nearest one."""
    best = F.min(F.struct("avg", "a", "b"))
    nearest = (
        scored.select(F.explode(F.array("a", "b")).alias("cid"), "avg", "a", "b")
        .groupBy("cid")
        .agg(best.alias("m"))
    )
    return (
        nearest.groupBy("m.a", "m.b")
        .agg(F.count("*").alias("votes"))
        .filter("votes = 2")
        .select(F.col("a").alias("lo"), F.col("b").alias("hi"))
    )


def _relabel(df: DataFrame, merges: DataFrame, col: str) -> DataFrame:
    """Replace absorbed cluster ids in `col` by the id that absorbed them."""
    to = merges.select(F.col("hi").alias(col), F.col("lo").alias("_to"))
    return df.join(to, col, "left").withColumn(col, F.coalesce("_to", col)).drop("_to")


def kmer_clusters(
    kmers: DataFrame,
    k: int,
    n: float = 4.0,
    seed: int = 0,
    bucket_rows: int = BUCKET_ROWS,
    by: str | None = None,
) -> DataFrame:
    """`kmer, cluster_id`: average-linkage clusters cut at `round(n / k, 2)`.

    With `by` each of its groups is clustered on its own, all in the same
    rounds; cluster ids differ between groups.

    Starts from the pairs within the cut and merges, round by round, every pair
    of clusters that are each other's nearest. Average linkage is reducible, so
    this equals the one-merge-at-a-time algorithm with the same tie order, and a
    pair of clusters can only come under the cut if one of its parts was: edges
    above it are dropped for good and no n x n matrix exists. Ties follow a
    seeded random order of the k-mers. Every step is a join or an aggregate;
    each round is written to the shared folder.
    """
    cut, radius = cut_radius(k, n)
    part = [by] if by else []
    ranked = dense_index(
        kmers.select("kmer", *part).distinct().withColumn("_h", F.xxhash64(F.lit(seed), "kmer")),
        ["_h", "kmer", *part],
        "cid",
    ).select("kmer", *part, "cid")
    members = cut_lineage(ranked)
    clusters = members.select("cid", F.lit(1).cast("bigint").alias("n"), _profile("kmer", k).alias("profile"))
    pairs = hamming_pairs(members.select("kmer", *part), radius, bucket_rows, by)
    ids = members.select(*part, F.col("kmer").alias("a"), F.col("cid").alias("ca"))
    ids_b = members.select(*part, F.col("kmer").alias("b"), F.col("cid").alias("cb"))
    edges = (
        pairs.join(ids, [*part, "a"])
        .join(ids_b, [*part, "b"])
        .select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
    )
    former: list[DataFrame] = []  # read by this round's edges, and by nothing once those are scored
    while True:
        scored = cut_lineage(_scored(edges, clusters, k, cut))
        for table in former:
            drop_table(table)
        merges = cut_lineage(_reciprocal(scored))
        if merges.isEmpty():
            break
        absorbed = (
            merges.join(clusters, F.col("hi") == F.col("cid"))
            .select(F.col("lo").alias("cid"), F.col("n").alias("n2"), F.col("profile").alias("p2"))
        )
        former = [scored, merges, clusters, members]
        summed = F.zip_with("profile", "p2", lambda x, y: x + y)
        clusters = cut_lineage(
            clusters.join(merges, F.col("cid") == F.col("hi"), "left_anti")
            .join(absorbed, "cid", "left")
            .select(
                "cid",
                (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"),
                F.when(F.col("p2").isNull(), F.col("profile")).otherwise(summed).alias("profile"),
            )
        )
        members = cut_lineage(_relabel(members, merges, "cid"))
        edges = (
            _relabel(_relabel(scored.select("a", "b"), merges, "a"), merges, "b")
            .filter("a != b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )
    return members.select(*part, "kmer", F.col("cid").alias("cluster_id"))
