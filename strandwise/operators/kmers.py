"""k-mer counting, prevalence and the high-frequency cut."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions.nucleotide import has_ambiguity
from strandwise.operators.codes import record_counts, record_prevalence
from strandwise.plans.lineage import broadcast_if_small, by_record, dense_index


def _both_strands(df: DataFrame, keep: Sequence[str], value: Column, name: str) -> DataFrame:
    """One row per strand of each (lo, hi) pair; a palindrome is one row."""
    single = F.array(F.col("lo"))
    strands = F.when(F.col("lo") == F.col("hi"), single).otherwise(F.array("lo", "hi"))
    return df.select(*keep, value.alias(name), F.explode(strands).alias("kmer")).select(
        *keep, "kmer", name
    )


def kmer_counts(
    seqs: DataFrame, k: int = 17, include_last: bool = False, key: Sequence[str] = ("seq_id",), number: bool = False
) -> DataFrame:
    """`key..., kmer, cnt`: canonical counts, stored under both strands.

    A k-mer and its reverse complement share one count; a palindrome seen n
    times counts 2n-1. Windows are counted by the unordered strand pair, a record
    at a time, and fan out to both strands, in tasks. `key` must name one record; when `seqs` is already
    hash-partitioned by it no row is shuffled. `number` adds a BIGINT that orders
    k-mers of up to 8 letters as their texts.
    """
    return record_counts(seqs, k, include_last, key, strands=True, number=number)


def drop_ambiguous(counts: DataFrame, kmer: str = "kmer") -> DataFrame:
    return counts.filter(~has_ambiguity(kmer))


def kmer_matrix(refs: DataFrame, binned: DataFrame, k: int = 17, number: bool = False) -> DataFrame:
    """Sparse matrix as rows `bin, draw_id, seq_id, kmer, cnt`.

    The reference sequence of each bin is always part of it; ambiguous k-mers
    are dropped after counting. Both inputs carry `bin, draw_id, seq_id, seq`.
    `number` as in `kmer_counts`.
    """
    key = ["bin", "draw_id", "seq_id"]
    rows = refs.select(*key, "seq").unionByName(binned.select(*key, "seq"))
    # Shuffling whole records here spares the shuffle of all their windows.
    return drop_ambiguous(kmer_counts(by_record(rows, *key), k, key=key, number=number))


def kmer_prevalence(counts: DataFrame) -> DataFrame:
    """`kmer, prevalence`: records with a non-zero count, from long counts."""
    return (
        counts.filter(F.col("cnt") != 0)
        .groupBy("kmer")
        .agg(F.count("*").alias("prevalence"))
    )


def sequence_prevalence(
    seqs: DataFrame, k: int = 17, include_last: bool = False, key: Sequence[str] = ("seq_id",)
) -> DataFrame:
    """The same prevalence straight from sequences.

    Both strands occur in the same records, so only strand pairs are counted:
    distinct per record, added up in each task and then per pair.
    """
    per_pair = record_prevalence(seqs, k, include_last, key)
    return drop_ambiguous(_both_strands(per_pair, [], F.col("n"), "prevalence"))


def weighted_prevalence(records: DataFrame, by: str, k: int = 17, include_last: bool = False) -> DataFrame:
    """`by, kmer, prevalence`: the weight of the records of each `by` that hold a k-mer.

    `records` holds `by, draw_id, seq_id, seq, weight`. A record that several
    draws took is cut into windows once and counts with its weight, as that many
    copies would.
    """
    key = [by, "draw_id", "seq_id", "weight"]
    spread = by_record(records.select(*key, "seq"), *key)
    per_pair = record_prevalence(spread, k, include_last, key, by, "weight")
    return drop_ambiguous(_both_strands(per_pair, [by], F.col("n"), "prevalence"))


def above_quantile(df: DataFrame, value: str, q: float, by: Sequence[str] = ()) -> DataFrame:
    """Rows whose value is strictly above the exact, interpolated quantile (of their `by` group).

    The quantile is taken from the histogram of values, which has far fewer
    rows than `df`.
    """
    histogram = df.groupBy(*by, value).agg(F.count("*").alias("_freq"))
    cut = histogram.groupBy(*by).agg(F.percentile(value, q, F.col("_freq")).alias("_cut"))
    if not by:
        return df.filter(F.col(value) > cut.scalar())
    return df.join(broadcast_if_small(cut), list(by)).filter(F.col(value) > F.col("_cut")).drop("_cut")


def high_freq_kmers(prevalence: DataFrame, q: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    return above_quantile(prevalence, "prevalence", q, by)


def kmer_index(kmers: DataFrame) -> DataFrame:
    """`kmer, idx`: sorted distinct vocabulary with a dense 0-based index."""
    return dense_index(kmers.select("kmer").distinct(), ["kmer"])
