"""Replicon binning by sequence length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.plans.lineage import broadcast_if_small, cut_lineage

# A bucket of lengths is one of 2**STEP_BITS equal parts of an octave (a length below that: itself).
STEP_BITS = 4


def _bucket(length: Column) -> Column:
    """Whole-number bucket of a length; never falls as the length grows."""
    digits = F.length(F.bin(length.cast("bigint")))
    shift = F.greatest(digits - (STEP_BITS + 1), F.lit(0))
    top = F.expr("1L") * F.floor(length / F.pow(F.lit(2.0), shift)).cast("bigint")
    return F.when(length <= 0, F.lit(-1)).otherwise(shift * (2 << STEP_BITS) + top).cast("int")


def _first_length(bucket: Column) -> Column:
    """Smallest length of a bucket."""
    shift = F.floor(bucket / (2 << STEP_BITS)).cast("int")
    return ((bucket % (2 << STEP_BITS)) * F.pow(F.lit(2.0), shift)).cast("bigint")


def _is_bucket(bucket: Column) -> Column:
    """Numbers between two octaves that no length has."""
    return (bucket < (2 << STEP_BITS)) | (bucket % (2 << STEP_BITS) >= (1 << STEP_BITS))


def length_bins(refs: DataFrame, p: float = 0.1) -> DataFrame:
    """`bucket, first, stop, bin`: disjoint ranges `first <= length < stop` inside a
    reference's range (strict on both sides), each with the lowest such bin.

    `refs` holds `bin, ref_len`. The ranges are cut at the bounds of all
    references and at the borders of buckets, so a reference makes a handful of
    rows however long it is, and a length is looked up by its bucket.
    """
    span = F.col("ref_len") * F.lit(p)
    # Whole lengths strictly above and below the bounds.
    low = F.greatest(F.floor(F.col("ref_len") - span) + 1, F.lit(1)).cast("bigint")
    stop = F.ceil(F.col("ref_len") + span).cast("bigint")
    ranges = refs.select("bin", low.alias("low"), stop.alias("high")).filter("low < high")
    bucket = F.explode(F.sequence(_bucket(F.col("low")), _bucket(F.col("high") - 1)))
    cut = ranges.withColumn("bucket", bucket).filter(_is_bucket(F.col("bucket"))).withColumn(
        "first", F.greatest("low", _first_length(F.col("bucket")))
    )
    # The next bucket's first length; past an octave's last number comes the next octave's first.
    after = F.when(_is_bucket(F.col("bucket") + 1), F.col("bucket") + 1).otherwise(
        F.col("bucket") + 1 + (1 << STEP_BITS)
    )
    cut = cut_lineage(cut.withColumn("stop", F.least("high", _first_length(after))).select("bucket", "first", "stop", "bin"))
    points = cut.select("bucket", F.explode(F.array("first", "stop")).alias("first")).distinct()
    within = Window.partitionBy("bucket").orderBy("first")
    pieces = points.withColumn("stop", F.lead("first").over(within)).filter("stop IS NOT NULL")
    covering = cut.select("bucket", F.col("first").alias("_first"), F.col("stop").alias("_stop"), "bin")
    return (
        pieces.join(covering, "bucket")
        .filter((F.col("_first") <= F.col("first")) & (F.col("first") < F.col("_stop")))
        .groupBy("bucket", "first", "stop")
        .agg(F.min("bin").alias("bin"))
    )


def replicon_bin(seqs: DataFrame, refs: DataFrame, p: float = 0.1) -> DataFrame:
    """Add `bin`: the first reference whose length is within `p` of the record's.

    Records near no reference are dropped. Which bin a record gets depends on
    its length alone: its bucket is looked up among the disjoint ranges, of
    which at most one holds it. The ranges are broadcast after a count.
    """
    # Written, so that counting them does not work out the references twice.
    bins = broadcast_if_small(cut_lineage(length_bins(refs, p)))
    # Never null: a null check of the join's keys would be pushed down to the scan
    # and derive the sequence there once for each use of its length.
    length = F.coalesce(F.length("seq"), F.lit(0)).cast("bigint")
    bucket = F.coalesce(_bucket(F.col("_len")), F.lit(-1))
    measured = seqs.withColumn("_len", length).withColumn("bucket", bucket)
    found = measured.join(bins, "bucket").filter((F.col("first") <= F.col("_len")) & (F.col("_len") < F.col("stop")))
    return found.drop("_len", "bucket", "first", "stop")
