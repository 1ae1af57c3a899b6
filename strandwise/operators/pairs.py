"""k-mer pairs within a Hamming radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions.nucleotide import bit_plane
from strandwise.plans.lineage import cut_lineage

# Members a bucket may have before it is split further.
BUCKET_ROWS = 128


def cut_radius(k: int, n: float) -> tuple[float, int]:
    """Distance cut `round(n / k, 2)` and the mismatches that stay within it."""
    cut = round(n / k, 2)
    return cut, max(m for m in range(k + 1) if m / k <= cut)


def _block(text: Column, number: Column, blocks: int) -> tuple[Column, Column]:
    """1-based start and the length of block `number` (0-based) of a text."""
    n = F.length(text)
    start = F.floor(number * n / blocks).cast("int")
    return start + 1, F.floor((number + 1) * n / blocks).cast("int") - start


def _split(rows: DataFrame, blocks: int) -> DataFrame:
    """One row per block of the letters not yet fixed.

    `bucket` grows by the block, `rest` loses it, and `before` gains the blocks
    in front of it: a pair belongs to the bucket of its first equal block only.
    """
    n = F.col("b")
    start, size = _block(F.col("rest"), n, blocks)
    text = F.substr("rest", start, size)

    def earlier(i: Column) -> Column:
        s, z = _block(F.col("rest"), i, blocks)
        return F.substr("rest", s, z)

    before = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), earlier)).otherwise(
        F.array().cast("array<string>")
    )
    # Lambdas see a select's own aliases first, so `before` and `bucket` are made
    # ahead of the new `rest`.
    return (
        rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .withColumn("before", F.concat("before", before))
        .withColumn(
            "bucket", F.concat_ws("/", "bucket", F.concat_ws(":", n.cast("string"), text))
        )
        .withColumn(
            "rest",
            F.concat(
                F.substr("rest", F.lit(1), start - 1),
                F.substr("rest", start + size, F.length("rest")),
            ),
        )
        .drop("b")
    )


def _bucket_pairs(rows: DataFrame, max_mismatches: int) -> DataFrame:
    a, b = rows.alias("a"), rows.alias("b")
    differing = F.bit_count(
        F.col("a.lo_plane").bitwiseXOR(F.col("b.lo_plane")).bitwiseOR(
            F.col("a.hi_plane").bitwiseXOR(F.col("b.hi_plane"))
        )
    )
    met_before = F.exists(
        F.zip_with(F.col("a.before"), F.col("b.before"), lambda x, y: x == y), lambda x: x
    )
    return (
        a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.kmer") < F.col("b.kmer")))
        .withColumn("mismatches", differing.cast("int"))
        .filter((F.col("mismatches") <= max_mismatches) & ~met_before)
        .select(F.col("a.kmer").alias("a"), F.col("b.kmer").alias("b"), "mismatches", F.col("a.part"))
    )


def hamming_pairs(
    kmers: DataFrame, max_mismatches: int, bucket_rows: int = BUCKET_ROWS, by: str | None = None
) -> DataFrame:
    """`a, b, mismatches` (a < b): all pairs of distinct ACGT k-mers of one length
    with at most `max_mismatches` differing positions. Exact.

    With `by` pairs are found inside each of its groups, all groups at once, and
    carry that column.

    A pair with m mismatches agrees on one of m+1 blocks, so k-mers meet in
    buckets of equal blocks. Buckets with more than `bucket_rows` members are
    not joined but split again by blocks of their remaining letters, and again
    until they are small or at most m letters remain; then all members are
    partners anyway and there are at most 4^m of them. Each pair is met in just
    one bucket, so no `distinct` is needed.
    """
    blocks = max_mismatches + 1
    rows = kmers.select(
        "kmer",
        bit_plane("kmer", "CT").alias("lo_plane"),
        bit_plane("kmer", "GT").alias("hi_plane"),
        (F.col(by).cast("string") if by else F.lit("")).alias("bucket"),
        (F.col(by) if by else F.lit(0)).alias("part"),
        F.col("kmer").alias("rest"),
        F.array().cast("array<string>").alias("before"),
    ).distinct()
    parts = []
    pending = cut_lineage(_split(rows, blocks))
    while True:
        sizes = pending.groupBy("bucket").agg(
            F.count("*").alias("members"), F.max(F.length("rest")).alias("left")
        )
        crowded = sizes.filter(
            (F.col("members") > bucket_rows) & (F.col("left") > max_mismatches)
        ).select("bucket")
        crowded = cut_lineage(crowded)
        if crowded.isEmpty():
            parts.append(_bucket_pairs(pending, max_mismatches))
            break
        parts.append(_bucket_pairs(pending.join(crowded, "bucket", "left_anti"), max_mismatches))
        pending = cut_lineage(_split(pending.join(crowded, "bucket", "left_semi"), blocks))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("part", by) if by else out.drop("part")
