"""Feature tables in long form, labels, alignment to a model, and scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.functions.scoring import accuracy, binarize, negative_brier, sigmoid
from strandwise.plans.lineage import broadcast_if_small

# A model's feature list lives on the driver, like its coefficient vector.
MAX_VOCABULARY = 5_000_000


def motif_features(hits: DataFrame, id_col: str = "seq_id", motif: str = "motif") -> DataFrame:
    """`accession, motif, cnt`: hits per sequence (BED rows or `motif_hits` rows)."""
    return hits.groupBy(F.col(id_col).alias("accession"), F.col(motif).alias("motif")).agg(
        F.count("*").alias("cnt")
    )


def labelled_features(features: DataFrame, meta: DataFrame) -> DataFrame:
    """Features joined to `label` and `groups`; ambiguous or missing labels go.

    Sequences without any feature row are absent, as are unlabelled ones.
    """
    labels = meta.filter(F.col("label") > -1).select("accession", "label", "groups")
    return features.join(labels, "accession")


def labelled_semi(features: DataFrame, meta: DataFrame) -> DataFrame:
    """Feature rows of sequences that have a usable label, nothing added."""
    return features.join(meta.filter(F.col("label") > -1), "accession", "left_semi")


def binarize_features(features: DataFrame) -> DataFrame:
    return features.withColumn("cnt", binarize("cnt"))


def vocabulary(features: DataFrame, name: str = "motif") -> DataFrame:
    """`idx, feature`: sorted distinct features with their vector position."""
    from strandwise.plans.lineage import dense_index

    return dense_index(features.select(F.col(name).alias("feature")).distinct(), ["feature"])


def vocabulary_list(vocab: DataFrame, limit: int = MAX_VOCABULARY) -> list[str]:
    """Features in vector order, for a model; its size is checked, never cut."""
    rows = vocab.select("idx", "feature").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} features; raise the quantile cut first")
    return [r["feature"] for r in sorted(rows, key=lambda r: r["idx"])]


def feature_align(
    features: DataFrame,
    vocab: Sequence[str],
    accessions: DataFrame | None = None,
    name: str = "motif",
    value: str = "cnt",
) -> DataFrame:
    """`accession, x`: one array per accession in the model's feature order.

    Absent features are 0, features the model does not know are dropped. The
    zero fill happens inside each row, so no accession x feature rows are made.
    """
    order = F.lit(list(vocab))
    known = features.filter(F.col(name).isin(list(vocab)))
    if accessions is None:
        accessions = features.select("accession").distinct()
    packed = known.groupBy("accession").agg(
        F.map_from_entries(F.collect_list(F.struct(name, F.col(value).cast("double")))).alias("m")
    )
    filled = F.transform(
        order, lambda f: F.coalesce(F.element_at(F.col("m"), f), F.lit(0.0))
    )
    return accessions.join(packed, "accession", "left").select("accession", filled.alias("x"))


def score_sequences(
    features: DataFrame,
    coefs: DataFrame,
    intercept: float = 0.0,
    accessions: DataFrame | None = None,
) -> DataFrame:
    """`accession, predict, predict_proba` of a linear model given as a table.

    With `accessions` the sequences without any known feature are scored too;
    otherwise every accession of `features` is.
    """
    weighted = (
        features.join(broadcast_if_small(coefs), "motif", "left")
        .groupBy("accession")
        .agg(F.sum(F.col("cnt") * F.coalesce("coef", F.lit(0.0))).alias("z"))
    )
    if accessions is not None:
        weighted = accessions.select("accession").join(weighted, "accession", "left")
    p = sigmoid(F.coalesce("z", F.lit(0.0)) + F.lit(float(intercept)))
    return weighted.select("accession", p.alias("predict_proba")).select(
        "accession",
        F.when(F.col("predict_proba") > 0.5, 1).otherwise(0).alias("predict"),
        "predict_proba",
    )


def labelled_predictions(predictions: DataFrame, meta: DataFrame) -> DataFrame:
    labels = meta.filter(F.col("label") > -1).select("accession", "label", "groups")
    return predictions.join(labels, "accession")


def misclassified(predictions: DataFrame, meta: DataFrame) -> DataFrame:
    return labelled_predictions(predictions, meta).filter(F.col("label") != F.col("predict"))


def evaluate(predictions: DataFrame, meta: DataFrame) -> DataFrame:
    """One row: labelled sequences, accuracy and (negative) Brier score."""
    return labelled_predictions(predictions, meta).agg(
        F.count("*").alias("n"),
        accuracy("label", "predict").alias("accuracy"),
        negative_brier("predict_proba", "label").alias("neg_brier"),
    )
