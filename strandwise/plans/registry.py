"""The registered queries: each operator run over the whole given tables.

Operators whose raw output has one row per window are rolled up at the end
(per k-mer or per record), so a check of the result covers every window.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions import nucleotide as nt
from strandwise.functions.protein import alphabet_encode, cds_accession
from strandwise.operators import (
    binning,
    clustering,
    codons,
    features,
    hits,
    kmers,
    models,
    motifs,
    pairs,
    proteins,
    sampling,
    windows,
)
from strandwise.plans import pipelines
from strandwise.plans.lineage import broadcast_if_small, cut_lineage, shared_folder
from strandwise.sources import derived, fasta, tables
from strandwise.streaming import scoring as streaming

K = 8
PAIR_K, PAIR_N, PAIR_Q = 10, 2.0, 0.99
DRAWS = 1000
BIN_DRAWS = 100
SPLITS = 10
# Binary fractions, so that sums are exact in every engine.
WEIGHTS = {"ACRTNA": 0.875, "GGYCAN": -0.625, "TTSAAK": 0.375, "CATGWA": -1.25}
# Several lengths, and one motif too wide to be expanded whole.
MIXED_MOTIFS = ["ACRTNA", "GGYCANT", "CANNNNNNNNGT", "TTSAAKR"]
FIT_MOTIFS = [*WEIGHTS, "AAYGRC", "GTKCAM", "TGGWCR", "CCASTN"]
# --- fixed values: a published 10-class residue alphabet ------------------
ALPHABET = {
    "F": "Y", "Y": "Y", "W": "Y", "M": "L", "L": "L", "I": "V", "V": "V",
    "A": "S", "T": "S", "S": "S", "N": "N", "H": "N", "Q": "E", "E": "E",
    "D": "E", "R": "K", "K": "K", "C": "C", "P": "P", "G": "G", "X": "X",
}
WORD_K = 3
AMINO_WEIGHTS = {"SSS": -0.375, "SLS": 0.25, "CKN": 1.125, "VKE": -0.5}
WORD_WEIGHTS = {"SSSS": 0.4, "VKEV": -0.7, "SLS": 0.25, "CKN": 1.1}


def _big(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


def _r9(name: str) -> Column:
    return F.round(name, 9).alias(name)


def motif_table(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(m,) for m in names], "motif STRING")


def weight_table(spark: SparkSession, weights: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(list(weights.items()), "motif STRING, coef DOUBLE")


# --- scalar functions ------------------------------------------------------
def accession_parse(spark, d):
    return derived.headers(spark, d).select(
        _big("doc_id"), nt.accession("header").alias("accession")
    )


def cds_accession_query(spark, d):
    return derived.headers(spark, d).select(
        _big("doc_id"), cds_accession("cds_id").alias("accession")
    )


def reverse_complement(spark, d):
    seqs = derived.sequences(spark, d, target=derived.TO_IUPAC)
    return seqs.select("seq_id", nt.reverse_complement("seq").alias("rc"))


def kmer_ambiguity_filter(spark, d):
    seqs = derived.sequences(spark, d, target=derived.TO_MOSTLY_BASES)
    counts = windows.kmer_windows(seqs, K).groupBy("kmer").agg(F.count("*").alias("cnt"))
    return kmers.drop_ambiguous(counts)


def dna_numeric_codec(spark, d):
    words = windows.kmer_windows(derived.sequences(spark, d), K).select("kmer").distinct()
    coded = words.withColumn("code", nt.encode_bases("kmer"))
    return coded.withColumn("decoded", nt.decode_bases("code"))


def motif_to_regex(spark, d):
    return derived.iupac_motifs(spark, d).select("motif", nt.motif_regex("motif").alias("regex"))


# --- windows, bins and k-mers ----------------------------------------------
def kmer_windows(spark, d):
    found = windows.kmer_windows(derived.sequences(spark, d), K)
    return found.groupBy("kmer").agg(
        F.count("*").alias("n"), F.sum("pos").alias("pos_sum"), F.max("pos").alias("last_pos")
    )


def kmer_counts(spark, d):
    counts = kmers.kmer_counts(derived.sequences(spark, d, by_record=True), K)
    return counts.groupBy("kmer").agg(
        F.sum("cnt").alias("total"), F.count("*").alias("records"), F.max("cnt").alias("most")
    )


def _references(spark, d) -> DataFrame:
    """One reference per source: its first document, whose id numbers the bin."""
    docs = derived.documents(spark, d, "doc_id", "source", "text")
    first = cut_lineage(docs.groupBy("source").agg(F.min("doc_id").alias("doc_id")))
    found = docs.join(broadcast_if_small(first), ["source", "doc_id"]).select(
        F.col("doc_id").cast("bigint").alias("bin"),
        F.concat(F.lit("D"), "doc_id").alias("seq_id"),
        derived.letters_only("text", derived.TO_BASES).alias("seq"),
    )
    # Written, because a filter on the length would be pushed down to the scan and
    # derive the sequence of every document there.
    return cut_lineage(found)


def _binned(spark, d) -> DataFrame:
    refs = _references(spark, d).select("bin", F.length("seq").alias("ref_len"))
    return binning.replicon_bin(derived.sequences(spark, d), refs)


def replicon_bin(spark, d):
    return _binned(spark, d).select("seq_id", "bin")


def kmer_matrix(spark, d):
    refs = _references(spark, d).withColumn("draw_id", F.lit("reference"))
    binned = _binned(spark, d).withColumn("draw_id", F.lit("sample"))
    # First and last by number, so that the rows of the windows are not sorted.
    matrix = kmers.kmer_matrix(refs, binned, K, number=True)
    return matrix.groupBy("bin", "draw_id", "seq_id").agg(
        F.count("*").alias("n_kmers"),
        F.sum("cnt").alias("total"),
        nt.number_text(F.min("number")).alias("first_kmer"),
        nt.number_text(F.max("number")).alias("last_kmer"),
    )


def _prevalence(spark, d, k=K) -> DataFrame:
    return kmers.sequence_prevalence(derived.sequences(spark, d, by_record=True), k)


def kmer_prevalence(spark, d):
    return _prevalence(spark, d)


def high_freq_kmers(spark, d):
    return kmers.high_freq_kmers(cut_lineage(_prevalence(spark, d)), 0.95)


def kmer_index(spark, d):
    return kmers.kmer_index(_prevalence(spark, d))


# --- motif sets ------------------------------------------------------------
def motif_degeneracy(spark, d):
    return motifs.motif_degeneracy(derived.iupac_motifs(spark, d)).select(
        _r9("avg_degenerate_positions"), _r9("avg_represented_bases")
    )


def motif_degeneracy_each(spark, d):
    return derived.iupac_motifs(spark, d).select(
        "motif",
        nt.degenerate_positions("motif").alias("degenerate_positions"),
        nt.represented_bases("motif").alias("represented_bases"),
    )


def rev_comp_motifs(spark, d):
    return motifs.rev_comp_motifs(derived.iupac_motifs(spark, d))


def rev_comp_ratio(spark, d):
    return motifs.rev_comp_ratio(derived.iupac_motifs(spark, d)).select(_r9("rev_comp_ratio"))


def consensus_motif(spark, d):
    groups = high_freq_kmers(spark, d).select(
        F.substring("kmer", 1, 4).alias("cluster_id"), "kmer"
    )
    return motifs.consensus_motif(groups, "motif")


# --- hits, BED and scores --------------------------------------------------
def _hits(spark, d, names) -> DataFrame:
    return hits.motif_hits(derived.sequences(spark, d), motif_table(spark, names))


def motif_hits(spark, d):
    return _hits(spark, d, list(WEIGHTS))


def motif_hits_mixed(spark, d):
    return _hits(spark, d, MIXED_MOTIFS)


def _scores(spark, d, found) -> DataFrame:
    # Distinct ids are all the score needs of the sequences.
    ids = derived.documents(spark, d, F.concat(F.lit("D"), "doc_id").alias("seq_id"))
    return hits.motif_score_table(found, motif_table(spark, [*WEIGHTS, "AAAAAAAAAAAAAAAA"]), ids)


def motif_score_table(spark, d):
    return _scores(spark, d, motif_hits(spark, d)).select(
        "motif", _r9("setcompletion"), _big("total_score")
    )


def motif_bed(spark, d):
    seqs, names = derived.sequences(spark, d), motif_table(spark, list(WEIGHTS))
    return pipelines.map_motifs(seqs, names).select(
        "chr", _big("start"), _big("end"), "name", _big("score")
    )


# --- features, labels and linear scores ------------------------------------
def motif_features(spark, d):
    return features.motif_features(motif_hits(spark, d))


def labelled_features(spark, d):
    joined = features.labelled_features(motif_features(spark, d), derived.metadata(spark, d))
    return joined.select("accession", "motif", "cnt", _big("label"), "groups")


def labelled_semi(spark, d):
    return features.labelled_semi(motif_features(spark, d), derived.metadata(spark, d))


def binarize_features(spark, d):
    return features.binarize_features(motif_features(spark, d))


def feature_align(spark, d):
    vocab = ["GGYCAN", "ACRTNA", "CATGWA", "AAAAAAAAAAAAAAAA"]
    aligned = features.feature_align(motif_features(spark, d), vocab)
    return aligned.select("accession", F.posexplode("x").alias("idx", "cnt")).select(
        "accession",
        _big("idx"),
        F.get(F.lit(vocab), F.col("idx")).alias("motif"),
        _big("cnt"),
    )


def _predictions(spark, d) -> DataFrame:
    ids = derived.documents(spark, d, F.concat(F.lit("D"), "doc_id").alias("accession"))
    return features.score_sequences(
        motif_features(spark, d), weight_table(spark, WEIGHTS), 0.0, ids
    )


def score_sequences(spark, d):
    return _predictions(spark, d).select("accession", _big("predict"), _r9("predict_proba"))


def misclassified(spark, d):
    wrong = features.misclassified(_predictions(spark, d), derived.metadata(spark, d))
    return wrong.select(
        "accession", _big("predict"), _r9("predict_proba"), _big("label"), "groups"
    )


def _evaluation(spark, d) -> DataFrame:
    return features.evaluate(_predictions(spark, d), derived.metadata(spark, d))


def model_accuracy(spark, d):
    return _evaluation(spark, d).select("n", _r9("accuracy"))


def brier_score(spark, d):
    return _evaluation(spark, d).select("n", _r9("neg_brier"))


def mapping_diff(spark, d):
    given = derived.metadata(spark, d).select("accession", F.col("label").alias("class"))
    guessed = _predictions(spark, d).select("accession", F.col("predict").alias("class"))
    return codons.mapping_diff(given, guessed, "accession", "class").select(
        "accession", _big("left_value"), _big("right_value")
    )


# --- sampling --------------------------------------------------------------
def _grouped_ids(spark, d) -> DataFrame:
    return derived.documents(
        spark, d, F.concat(F.lit("D"), "doc_id").alias("accession"), F.col("source").alias("groups")
    )


def stratified_resample(spark, d):
    return sampling.stratified_resample(
        _grouped_ids(spark, d), DRAWS, "groups", "accession", seed=7
    )


def stratified_resample_bins(spark, d):
    binned = _binned(spark, d).select(F.col("seq_id").alias("accession"), "bin")
    labelled = binned.join(_grouped_ids(spark, d), "accession")
    return sampling.stratified_resample(labelled, 100, "groups", "accession", seed=7, by=["bin"])


def group_shuffle_split(spark, d):
    return sampling.group_shuffle_split(_grouped_ids(spark, d), "groups", SPLITS, 0.1, seed=7).select(
        _big("split"), "groups", "is_test"
    )


def stratified_kfold(spark, d):
    return sampling.stratified_kfold(
        derived.metadata(spark, d), "label", "accession", 5, seed=7
    ).select("accession", _big("label"), "groups", _big("fold"))


# --- clustering ------------------------------------------------------------
def _retained(spark, d) -> DataFrame:
    prevalence = cut_lineage(_prevalence(spark, d, PAIR_K))
    return kmers.high_freq_kmers(prevalence, PAIR_Q).select("kmer")


def hamming_pairs(spark, d):
    _, radius = pairs.cut_radius(PAIR_K, PAIR_N)
    return pairs.hamming_pairs(_retained(spark, d), radius).select("a", "b", _big("mismatches"))


def kmer_clusters(spark, d):
    return clustering.kmer_clusters(_retained(spark, d), PAIR_K, PAIR_N, seed=7)


def discover_motifs(spark, d):
    seqs = derived.sequences(spark, d, by_record=True)
    return pipelines.discover_motifs(seqs, PAIR_K, PAIR_N, PAIR_Q, "motif", seed=7)


# --- motifs of each bin, over drawn samples --------------------------------
def _bin_records(spark, d) -> DataFrame:
    meta = _grouped_ids(spark, d)
    return pipelines.bin_records(
        derived.sequences(spark, d), _references(spark, d), draws=BIN_DRAWS, meta=meta, seed=7
    )


def resample_weights_bins(spark, d):
    """How often each sample of a bin is drawn; the references weigh 1."""
    return _bin_records(spark, d).select("bin", "draw_id", "seq_id", "weight")


def bin_prevalence(spark, d):
    return kmers.weighted_prevalence(_bin_records(spark, d), "bin", K)


def bin_high_freq(spark, d):
    prevalence = cut_lineage(bin_prevalence(spark, d))
    return kmers.high_freq_kmers(prevalence, 0.95, ["bin"])


def discover_motifs_bins(spark, d):
    return pipelines.discover_motifs_by_bin(_bin_records(spark, d), PAIR_K, PAIR_N, PAIR_Q, seed=7)


# --- proteins and codons ---------------------------------------------------
def cds_translate(spark, d):
    return proteins.cds_translate(derived.cds(spark, d), 6)


def alphabet_encode_query(spark, d):
    found = proteins.cds_translate(derived.cds(spark, d), 6)
    return found.select("seq_id", alphabet_encode("protein", ALPHABET).alias("encoded"))


def amino_kmer_counts(spark, d):
    return proteins.amino_kmer_counts(derived.cds(spark, d), WORD_K, ALPHABET)


def amino_high_abundance(spark, d):
    return proteins.amino_high_abundance(amino_kmer_counts(spark, d), 0.9)


def predict_amino(spark, d):
    """The protein words of a linear model, scored for every accession."""
    weights = weight_table(spark, AMINO_WEIGHTS)
    scored = pipelines.predict_proteins(derived.cds(spark, d), weights, ALPHABET)
    return scored.select("accession", _big("predict"), _r9("predict_proba"))


def amino_motif_locations(spark, d):
    return proteins.amino_motif_locations(
        derived.cds(spark, d), weight_table(spark, WORD_WEIGHTS), ALPHABET
    )


def codon_usage(spark, d):
    return codons.codon_usage(derived.cds(spark, d))


def relative_codon_freq(spark, d):
    return codons.relative_codon_freq(codons.codon_usage(derived.cds(spark, d))).select(
        "accession", "codon", "amino", _r9("rel_freq")
    )


# --- sources and sinks -----------------------------------------------------
def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def fasta_scan(spark, d):
    path = _scratch(spark, "fasta")
    fasta.write_fasta(derived.sequences(spark, d), path, "seq_id", "seq")
    return fasta.read_fasta(spark, path).select(
        "seq_id", F.length("seq").cast("bigint").alias("len"), F.md5("seq").alias("digest")
    )


def bed_scan(spark, d):
    path = _scratch(spark, "bed")
    tables.write_bed(motif_bed(spark, d), path)
    return tables.read_bed(spark, path).select(
        "chr", _big("start"), _big("end"), "name", _big("score")
    )


def metadata_scan(spark, d):
    path = _scratch(spark, "metadata")
    tables.write_tsv(derived.metadata(spark, d), path)
    return tables.read_metadata(spark, path).select("accession", _big("label"), "groups")


def stream_scores(spark, d):
    """The batch scores again, from a stream over the documents table."""
    out, state = _scratch(spark, "stream"), _scratch(spark, "stream-state")
    # A stream reads folders; as a pattern the table may be one file or a folder of files.
    docs = spark.readStream.schema("doc_id BIGINT, text STRING").parquet(f"{d}/[d]ocuments.parquet")
    seqs = docs.select(
        F.concat(F.lit("D"), "doc_id").alias("seq_id"),
        derived.letters_only("text", derived.TO_BASES).alias("seq"),
    )
    query = streaming.score_stream(seqs, weight_table(spark, WEIGHTS), out, state)
    query.awaitTermination()
    return streaming.read_scores(spark, out).select(
        "accession", _big("predict"), _r9("predict_proba")
    )


# --- models ----------------------------------------------------------------
# Splits, test share, penalties and iterations are the functions' defaults.
FIT_SEED = 7


def _fit_features(spark, d) -> DataFrame:
    return features.motif_features(_hits(spark, d, FIT_MOTIFS))


def _record_cds(spark, d) -> DataFrame:
    seqs = derived.sequences(spark, d)
    return seqs.withColumn("accession", F.col("seq_id"))


def _l1_gss(spark, d) -> models.FitResult:
    return models.fit_l1_gss(_fit_features(spark, d), derived.metadata(spark, d), seed=FIT_SEED)


def fit_l1_gss(spark, d):
    return _l1_gss(spark, d).cv_results


def cv_results(spark, d):
    """The search over resampled rows: a row drawn n times weighs n."""
    result = models.fit_l1_gss(
        _fit_features(spark, d), derived.metadata(spark, d), resample=DRAWS, seed=FIT_SEED
    )
    return result.cv_results


def model_coefficients(spark, d):
    return _l1_gss(spark, d).coefficients


def fit_l1_cv(spark, d):
    return models.fit_l1_cv(
        _fit_features(spark, d), derived.metadata(spark, d), seed=FIT_SEED
    ).cv_results


def fit_elastic_net(spark, d):
    return models.fit_elastic_net(
        _fit_features(spark, d), derived.metadata(spark, d), seed=FIT_SEED
    ).cv_results


def fit_amino_gss(spark, d):
    counts = proteins.amino_kmer_counts(_record_cds(spark, d), 2, ALPHABET)
    words = counts.withColumnRenamed("word", "motif")
    return models.fit_l1_gss(
        words, derived.metadata(spark, d), binary=True, seed=FIT_SEED
    ).cv_results


def fit_codon_gss(spark, d):
    shares = codons.relative_codon_freq(codons.codon_usage(_record_cds(spark, d)))
    named = shares.select("accession", F.col("codon").alias("motif"), "rel_freq")
    return models.fit_l1_gss(
        named, derived.metadata(spark, d), value="rel_freq", seed=FIT_SEED
    ).cv_results


def _boosted(spark, d) -> models.FitResult:
    grid = {"max_depth": [2, 3], "n_estimators": [5], "learning_rate": [0.2]}
    return models.fit_boosted_gss(
        _fit_features(spark, d), derived.metadata(spark, d), grid, n_splits=2, test_size=0.2, seed=7
    )


def fit_boosted_gss(spark, d):
    return _boosted(spark, d).cv_results


def feature_importances(spark, d):
    return _boosted(spark, d).coefficients


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "accession_parse": accession_parse,
    "cds_accession": cds_accession_query,
    "reverse_complement": reverse_complement,
    "kmer_ambiguity_filter": kmer_ambiguity_filter,
    "dna_numeric_codec": dna_numeric_codec,
    "motif_to_regex": motif_to_regex,
    "motif_degeneracy": motif_degeneracy,
    "motif_degeneracy_each": motif_degeneracy_each,
    "rev_comp_motifs": rev_comp_motifs,
    "rev_comp_ratio": rev_comp_ratio,
    "kmer_windows": kmer_windows,
    "replicon_bin": replicon_bin,
    "kmer_counts": kmer_counts,
    "kmer_matrix": kmer_matrix,
    "kmer_prevalence": kmer_prevalence,
    "high_freq_kmers": high_freq_kmers,
    "kmer_index": kmer_index,
    "hamming_pairs": hamming_pairs,
    "kmer_clusters": kmer_clusters,
    "consensus_motif": consensus_motif,
    "discover_motifs": discover_motifs,
    "resample_weights_bins": resample_weights_bins,
    "bin_prevalence": bin_prevalence,
    "bin_high_freq": bin_high_freq,
    "discover_motifs_bins": discover_motifs_bins,
    "motif_hits": motif_hits,
    "motif_hits_mixed": motif_hits_mixed,
    "motif_score_table": motif_score_table,
    "motif_bed": motif_bed,
    "motif_features": motif_features,
    "labelled_features": labelled_features,
    "labelled_semi": labelled_semi,
    "binarize_features": binarize_features,
    "feature_align": feature_align,
    "score_sequences": score_sequences,
    "misclassified": misclassified,
    "model_accuracy": model_accuracy,
    "brier_score": brier_score,
    "mapping_diff": mapping_diff,
    "stratified_resample": stratified_resample,
    "stratified_resample_bins": stratified_resample_bins,
    "group_shuffle_split": group_shuffle_split,
    "stratified_kfold": stratified_kfold,
    "cds_translate": cds_translate,
    "alphabet_encode": alphabet_encode_query,
    "amino_kmer_counts": amino_kmer_counts,
    "amino_high_abundance": amino_high_abundance,
    "amino_motif_locations": amino_motif_locations,
    "predict_amino": predict_amino,
    "codon_usage": codon_usage,
    "relative_codon_freq": relative_codon_freq,
    "fasta_scan": fasta_scan,
    "bed_scan": bed_scan,
    "metadata_scan": metadata_scan,
    "stream_scores": stream_scores,
    "fit_l1_cv": fit_l1_cv,
    "fit_elastic_net": fit_elastic_net,
    "fit_l1_gss": fit_l1_gss,
    "fit_amino_gss": fit_amino_gss,
    "fit_codon_gss": fit_codon_gss,
    "fit_boosted_gss": fit_boosted_gss,
    "cv_results": cv_results,
    "model_coefficients": model_coefficients,
    "feature_importances": feature_importances,
}
