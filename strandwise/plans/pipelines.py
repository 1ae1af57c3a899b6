"""End-to-end plans: discover motifs, map and featurise, predict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.operators.binning import replicon_bin
from strandwise.operators.clustering import kmer_clusters
from strandwise.operators.features import motif_features, score_sequences
from strandwise.operators.hits import motif_bed, motif_hits, motif_score_table
from strandwise.operators.kmers import high_freq_kmers, sequence_prevalence, weighted_prevalence
from strandwise.operators.models import INTERCEPT, load_model
from strandwise.operators.motifs import consensus_motif
from strandwise.operators.proteins import amino_kmer_counts
from strandwise.operators.sampling import latest_labels, resample_weights
from strandwise.plans.lineage import cut_lineage


def discover_motifs(
    seqs: DataFrame, k: int = 17, n: float = 4.0, q: float = 0.95, prefix: str = "motif", seed: int = 0
) -> DataFrame:
    """Sequences to degenerate motifs: prevalence, quantile cut, clusters, consensus."""
    prevalence = cut_lineage(sequence_prevalence(seqs, k))
    kmers = high_freq_kmers(prevalence, q).select("kmer")
    return consensus_motif(kmer_clusters(kmers, k, n, seed), prefix).select("motif_id", "motif")


def bin_records(
    seqs: DataFrame,
    refs: DataFrame,
    p: float = 0.1,
    draws: int = 0,
    meta: DataFrame | None = None,
    seed: int = 0,
) -> DataFrame:
    """`bin, draw_id, seq_id, seq, weight`: what each bin's k-mers are counted over.

    `refs` holds `bin, seq_id, seq`; a reference is always a record of its bin.
    With `draws` that many samples a bin are drawn with replacement, `groups` of
    `meta` in proportion; a sample drawn n times is one row of weight n. Samples
    without a row in `meta` are an error, as they belong to no group.
    """
    binned = replicon_bin(seqs, refs.select("bin", F.length("seq").alias("ref_len")), p)
    if draws:
        if meta is None:
            raise ValueError("draws need the groups of a metadata table")
        labels = latest_labels(meta).select(F.col("accession").alias("seq_id"), "groups")
        binned = cut_lineage(binned.join(labels, "seq_id", "left"))
        if not binned.filter("groups IS NULL").isEmpty():
            raise ValueError("sequences without a group; see sampling.unlabelled")
        taken = resample_weights(binned, draws, "groups", "seq_id", seed, by=["bin"])
        binned = binned.join(taken.select("bin", "seq_id", "weight"), ["bin", "seq_id"])
    else:
        binned = binned.withColumn("weight", F.lit(1).cast("bigint"))
    samples = binned.select("bin", F.lit("sample").alias("draw_id"), "seq_id", "seq", "weight")
    one = F.lit(1).cast("bigint").alias("weight")
    return refs.select("bin", F.lit("reference").alias("draw_id"), "seq_id", "seq", one).unionByName(samples)


def discover_motifs_by_bin(
    records: DataFrame, k: int = 17, n: float = 4.0, q: float = 0.95, prefix: str = "motif", seed: int = 0
) -> DataFrame:
    """`bin, motif_id, motif`: the motifs of each bin of `bin_records`, all bins at once.

    Prevalence, quantile, clusters and numbering are per bin, but each step is
    one job over all of them.
    """
    prevalence = cut_lineage(weighted_prevalence(records, "bin", k))
    kmers = high_freq_kmers(prevalence, q, ["bin"]).select("bin", "kmer")
    clusters = kmer_clusters(kmers, k, n, seed, by="bin")
    return consensus_motif(clusters, prefix, by="bin").select("bin", "motif_id", "motif")


def map_motifs(seqs: DataFrame, motifs: DataFrame) -> DataFrame:
    """Sequences and motifs to scored BED rows."""
    # Both are used more than once; as a written table of one row per motif the
    # scores are broadcast by their true size and no hit is shuffled by motif.
    hits = cut_lineage(motif_hits(seqs, motifs))
    scores = cut_lineage(motif_score_table(hits, motifs, seqs.select("seq_id")))
    return motif_bed(hits, scores)


def _split_intercept(coefs: DataFrame, intercept: float) -> tuple[DataFrame, float]:
    """A saved model keeps its intercept as a feature of its own; it is no motif."""
    is_it = F.col("motif") == INTERCEPT
    found = coefs.filter(is_it).agg(F.sum("coef")).first()[0] or 0.0
    return coefs.filter(~is_it), intercept + found


def predict_sequences(seqs: DataFrame, coefs: DataFrame, intercept: float = 0.0) -> DataFrame:
    """Score every sequence with a coefficient table, hit or not."""
    coefs, intercept = _split_intercept(coefs, intercept)
    features = motif_features(motif_hits(seqs, coefs.select("motif")))
    ids = seqs.select(F.col("seq_id").alias("accession"))
    return score_sequences(features, coefs, intercept, ids)


def predict_proteins(
    cds: DataFrame,
    coefs: DataFrame,
    alphabet: dict[str, str] | None = None,
    intercept: float = 0.0,
) -> DataFrame:
    """Score every accession of coding sequences by its protein words.

    Words are as long as the model's; each length is counted once. An accession
    without any known word gets the intercept's score.
    """
    coefs, intercept = _split_intercept(coefs, intercept)
    widths = sorted(r[0] for r in coefs.select(F.length("motif")).distinct().collect())
    counts = [
        amino_kmer_counts(cds, k, alphabet).withColumnRenamed("word", "motif") for k in widths
    ]
    ids = cds.select("accession").distinct()
    features = reduce(DataFrame.unionByName, counts) if counts else ids.selectExpr(
        "accession", "CAST(NULL AS STRING) AS motif", "0L AS cnt"
    )
    return score_sequences(features, coefs, intercept, ids)


def predict_saved(seqs: DataFrame, path: str) -> DataFrame:
    """Score every sequence with the linear model that `save_model` wrote."""
    model, _, coefs = load_model(seqs.sparkSession, path)
    return predict_sequences(seqs, coefs, float(getattr(model, "intercept", 0.0)))
