"""Sparse linear and boosted-tree models with group-aware cross-validation.

Features stay long until the vector boundary. A grid search of linear models
solves all splits and penalties together (`solver`); the chosen parameter is
refitted by a distributed `pyspark.ml` job. The driver holds vocabularies, a
bounded block of coefficient vectors and one score per split and parameter.
Resampled rows aren't copied: a row drawn n times weighs n.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
)
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions.scoring import accuracy, negative_brier
from strandwise.operators import solver
from strandwise.operators.features import (
    MAX_VOCABULARY,
    binarize_features,
    feature_align,
    labelled_features,
    vocabulary,
    vocabulary_list,
)
from strandwise.operators.sampling import (
    group_shuffle_split,
    resample_weights,
    stratified_kfold,
)
from strandwise.plans.lineage import cut_lineage

# --- fixed values: default parameter grids --------------------------------
GROUP_SPLIT_CS = [0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0]
KFOLD_CS = [10.0 ** (-4 + 8 * i / 9) for i in range(10)]
ELASTIC_NET_ALPHAS = [0.1, 0.01, 0.001, 0.0001, 0.00001, 0.000001]
ELASTIC_NET_L1_RATIO = 0.15
# Boosted-tree grid names and the Spark parameters they set.
TREE_PARAMETERS = {
    "max_depth": "maxDepth",
    "n_estimators": "maxIter",
    "learning_rate": "stepSize",
    "eta": "stepSize",
    "subsample": "subsamplingRate",
    "min_child_weight": "minInstancesPerNode",
    "gamma": "minInfoGain",
    "max_bin": "maxBins",
}
INTERCEPT = "(intercept)"
# Training rows worth a task of their own; every solver step is one job, so a
# small training set in many partitions only pays scheduling.
ROWS_PER_TASK = 20_000
# Margins (rows x models) worth a task of their own in a pass of the batched search.
CELLS_PER_TASK = 1_000_000


@dataclass
class FitResult:
    """A refitted model with what the search found on the way."""

    model: object
    vocab: list[str]
    coefficients: DataFrame
    cv_results: DataFrame
    best: object
    train_accuracy: float
    n_rows: int = 0


@dataclass
class _Training:
    """Long features, one weighted label row per example, and vectors, all by `accession`."""

    features: DataFrame
    rows: DataFrame
    vectors: DataFrame
    vocab: list[str]
    #: Sum of the rows' weights, and rows.
    n: int
    n_rows: int


def to_vectors(
    features: DataFrame, vocab: Sequence[str], accessions: DataFrame, value: str = "cnt"
) -> DataFrame:
    """`accession, x`: one ML vector per accession, built inside the JVM.

    Counts become sparse vectors through a fixed-vocabulary token count, real
    values a dense vector (meant for short vocabularies such as codons).
    """
    if dict(features.dtypes)[value] in ("bigint", "int"):
        tokens = features.groupBy("accession").agg(
            F.flatten(
                F.collect_list(F.array_repeat("motif", F.col(value).cast("int")))
            ).alias("tokens")
        )
        filled = accessions.select("accession").join(tokens, "accession", "left").select(
            "accession", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")
        )
        counter = CountVectorizerModel.from_vocabulary(
            list(vocab), inputCol="tokens", outputCol="x"
        )
        return counter.transform(filled).select("accession", "x")
    dense = feature_align(features, vocab, accessions.select("accession"), "motif", value)
    return dense.select("accession", array_to_vector("x").alias("x"))


def _training(
    features: DataFrame,
    meta: DataFrame,
    value: str,
    resample: int,
    seed: int,
    max_features: int,
    constant: bool = False,
    binary: bool = False,
) -> _Training:
    # Used for the rows and for the cells; written so features are made once.
    labelled = cut_lineage(
        labelled_features(features.select("accession", "motif", F.col(value).alias("cnt")), meta)
    )
    rows = labelled.select("accession", "label", "groups").distinct()
    # A null feature keeps an accession that has none; it is no vocabulary entry.
    cells = labelled.filter(F.col("motif").isNotNull()).select("accession", "motif", "cnt")
    if binary:
        cells = binarize_features(cells)
    if resample:
        weights = resample_weights(rows, resample, "groups", "accession", seed)
        rows = rows.join(weights.select("accession", "weight"), "accession")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    if constant:
        one = F.lit(1).cast(dict(cells.dtypes)["cnt"])
        cells = cells.unionByName(
            rows.select("accession", F.lit(INTERCEPT).alias("motif"), one.alias("cnt"))
        )
    doubles = {c: F.col(c).cast("double") for c in ("label", "weight")}
    rows = cut_lineage(rows.withColumns(doubles))
    # Features of rows that weren't drawn are none of the model's.
    cells = cut_lineage(cells.join(rows.select("accession"), "accession", "left_semi"))
    vocab = vocabulary_list(vocabulary(cells), max_features)
    sizes = rows.agg(F.count("*"), F.sum("weight")).first()
    vectors = _packed(to_vectors(cells, vocab, rows).join(rows, "accession"), sizes[0])
    return _Training(cells, rows, cut_lineage(vectors), vocab, int(sizes[1] or 0), sizes[0])


def _packed(df: DataFrame, n: int) -> DataFrame:
    """`df` in no more partitions than its n rows can keep busy."""
    return df.coalesce(max(1, -(-n // ROWS_PER_TASK)))


def _parallel(tasks: Sequence[Callable], parallelism: int) -> list:
    """Run fits side by side; each one is its own set of Spark jobs."""
    session = SparkSession.getActiveSession()
    with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
        return pool.map(lambda t: inheritable_thread_target(session)(t)(), tasks)


def cv_results(scores: DataFrame) -> DataFrame:
    """Mean and spread of the test score per parameter, from `split, param, score`
    rows; the best parameter comes last."""
    return (
        scores.groupBy("param")
        .agg(
            F.avg("score").alias("mean_test_score"),
            F.stddev_pop("score").alias("std_test_score"),
            F.count("*").alias("n_splits"),
        )
        .orderBy("mean_test_score", "param")
    )


def _best(table: DataFrame) -> object:
    top = table.orderBy(F.col("mean_test_score").desc(), "param").limit(1).collect()
    return top[0]["param"]


def _nonzero(model, vocab: Sequence[str]) -> list[tuple[str, float]]:
    vector = model.coefficients.toArray()
    return [(vocab[i], float(vector[i])) for i in vector.nonzero()[0]]


def _search_linear(
    t: _Training,
    held: DataFrame,
    by: str,
    params: Sequence[float],
    estimator: Callable[[float, float], LogisticRegression],
    metric: str,
    max_iter: int,
    tol: float,
) -> FitResult:
    """Grid search of linear models: every split and parameter in one batch.

    `held` lists what each split holds out (`split` and the column `by` of the
    rows). The penalties are those of `estimator`, so search and refit agree.
    """
    spark = t.rows.sparkSession
    held = cut_lineage(held.select(F.col("split").cast("int").alias("split"), by))
    numbers = spark.createDataFrame(list(enumerate(t.vocab)), "idx BIGINT, feature STRING")
    data = cut_lineage(solver.design(t.features, t.rows, numbers, held, by))
    sizes = {
        r["split"]: r["w"]
        for r in data.select("weight", F.explode("held").alias("split"))
        .groupBy("split").agg(F.sum("weight").alias("w")).collect()
    }
    searched = [(split, float(p)) for split in sorted(sizes) for p in params]
    first = estimator(float(params[0]), t.n)
    free = first.getFitIntercept()
    width = len(t.vocab) + free
    if free:  # a constant feature without a penalty
        one = F.lit(len(t.vocab)).cast("int")
        data = data.withColumn("idx", F.concat("idx", F.array(one))).withColumn("val", F.concat("val", F.array(F.lit(1.0))))
    l1, l2 = np.zeros((len(searched), width)), np.zeros((len(searched), width))
    for i, (split, param) in enumerate(searched):
        e = estimator(param, t.n - sizes[split])
        share = e.getElasticNetParam()
        l1[i, : len(t.vocab)], l2[i, : len(t.vocab)] = e.getRegParam() * share, e.getRegParam() * (1 - share)
    tasks = -(-t.n_rows * max(1, min(len(searched), solver.SOLVE_CELLS // max(width, 1))) // CELLS_PER_TASK)
    # Each task sends a matrix in every pass: no more of them than run at once.
    tasks = min(tasks, -(-t.n_rows // 64), spark.sparkContext.defaultParallelism)
    data = data.repartition(max(1, tasks)).persist()
    split = np.array([s for s, _ in searched], np.int64)
    w = solver.solve(data, solver.Models(split, l1, l2), max_iter, tol)
    brier, right = solver.held_out_scores(data, w, split)
    data.unpersist()
    scores = brier if metric == "neg_brier" else right
    found = [(s, p, float(x)) for (s, p), x in zip(searched, scores)]
    table = cut_lineage(cv_results(spark.createDataFrame(found, "split INT, param DOUBLE, score DOUBLE")))
    best = _best(table)
    model = estimator(best, t.n).fit(t.vectors)
    kept = _nonzero(model, t.vocab)
    coefficients = spark.createDataFrame(kept, "motif STRING, coef DOUBLE")
    return FitResult(model, t.vocab, coefficients, table, best, _train_accuracy(model, t), t.n)


def _train_accuracy(model, t: _Training) -> float:
    right = (F.col("label") == F.col("prediction")).cast("double") * F.col("weight")
    return model.transform(t.vectors).agg((F.sum(right) / F.sum("weight")).alias("a")).first()["a"]


def _group_train(t: _Training, splits: DataFrame) -> Callable[[int], DataFrame]:
    def train(split: int) -> DataFrame:
        held_out = splits.filter(F.col("is_test") & (F.col("split") == split))
        return t.vectors.join(held_out.select("groups"), "groups", "left_anti")

    return train


def _penalised(max_iter: int, tol: float) -> Callable[[float, float], LogisticRegression]:
    """`|w|_1 + C * sum(loss)` is Spark's `mean(loss) + |w|_1 / (C * n)`, n the sum of weights."""
    def estimator(c: float, n: float) -> LogisticRegression:
        return LogisticRegression(
            featuresCol="x", labelCol="label", weightCol="weight", family="binomial", elasticNetParam=1.0,
            regParam=1.0 / (c * n), fitIntercept=False, standardization=False,
            maxIter=max_iter, tol=tol,
        )

    return estimator


def fit_l1_gss(
    features: DataFrame,
    meta: DataFrame,
    cs: Sequence[float] = GROUP_SPLIT_CS,
    n_splits: int = 100,
    test_size: float = 0.1,
    resample: int = 0,
    seed: int = 0,
    max_iter: int = 500,
    tol: float = 1e-8,
    value: str = "cnt",
    binary: bool = False,
    max_features: int = MAX_VOCABULARY,
) -> FitResult:
    """L1 logistic regression without intercept, C chosen by group splits and
    negative Brier score, refitted on all rows.

    Used for motif counts, amino words and relative codon frequencies alike.
    """
    t = _training(features, meta, value, resample, seed, max_features, binary=binary)
    splits = group_shuffle_split(t.rows, "groups", n_splits, test_size, seed).filter("is_test")
    return _search_linear(t, splits, "groups", cs, _penalised(max_iter, tol), "neg_brier", max_iter, tol)


def _search_folds(t, folds, seed, params, estimator, max_iter, tol) -> FitResult:
    dealt = stratified_kfold(t.rows, "label", "accession", folds, seed).withColumnRenamed("fold", "split")
    return _search_linear(t, dealt, "accession", params, estimator, "accuracy", max_iter, tol)


def fit_l1_cv(
    features: DataFrame,
    meta: DataFrame,
    folds: int = 5,
    cs: Sequence[float] = KFOLD_CS,
    max_iter: int = 500,
    tol: float = 1e-8,
    seed: int = 0,
    value: str = "cnt",
    max_features: int = MAX_VOCABULARY,
) -> FitResult:
    """L1 logistic regression, C chosen by stratified folds and accuracy.

    The intercept is penalised like a weight: it is a feature that is always 1.
    """
    t = _training(features, meta, value, 0, seed, max_features, constant=True)
    return _search_folds(t, folds, seed, cs, _penalised(max_iter, tol), max_iter, tol)


def fit_elastic_net(
    features: DataFrame,
    meta: DataFrame,
    folds: int = 5,
    alphas: Sequence[float] = ELASTIC_NET_ALPHAS,
    max_iter: int = 1000,
    tol: float = 1e-8,
    seed: int = 0,
    value: str = "cnt",
    max_features: int = MAX_VOCABULARY,
) -> FitResult:
    """Elastic-net logistic regression with a free intercept, alpha by folds."""
    t = _training(features, meta, value, 0, seed, max_features)

    def estimator(alpha: float, n: float) -> LogisticRegression:
        return LogisticRegression(
            featuresCol="x", labelCol="label", weightCol="weight", family="binomial",
            elasticNetParam=ELASTIC_NET_L1_RATIO, regParam=alpha, fitIntercept=True,
            standardization=False, maxIter=max_iter, tol=tol,
        )

    return _search_folds(t, folds, seed, alphas, estimator, max_iter, tol)


def tree_grid(grid: dict[str, Sequence]) -> list[dict]:
    """All combinations of a boosted-tree grid, in Spark parameter names."""
    unknown = set(grid) - set(TREE_PARAMETERS) - set(TREE_PARAMETERS.values())
    if unknown:
        raise ValueError(f"no tree parameter for {sorted(unknown)}")
    names = [TREE_PARAMETERS.get(k, k) for k in grid]
    return [dict(zip(names, values)) for values in product(*grid.values())]


def fit_boosted_gss(
    features: DataFrame,
    meta: DataFrame,
    grid: dict[str, Sequence],
    n_splits: int = 100,
    test_size: float = 0.1,
    seed: int = 0,
    value: str = "cnt",
    parallelism: int = 2,
    max_features: int = MAX_VOCABULARY,
) -> FitResult:
    """Gradient-boosted trees, parameters chosen by group splits and negative
    Brier score; `coefficients` holds the non-zero feature importances."""
    t = _training(features, meta, value, 0, seed, max_features)
    spark = t.rows.sparkSession
    splits = cut_lineage(group_shuffle_split(t.rows, "groups", n_splits, test_size, seed))
    train = _group_train(t, splits)
    combos = tree_grid(grid)
    probability = F.get(vector_to_array("probability"), F.lit(1))

    def estimator(params: dict) -> GBTClassifier:
        return GBTClassifier(featuresCol="x", labelCol="label", seed=seed, **params)

    scores = []
    for split in range(n_splits):
        part = _packed(train(split), t.n).persist()
        held_out = splits.filter(F.col("is_test") & (F.col("split") == split)).select("groups")
        test = t.vectors.join(held_out, "groups", "left_semi")
        test = _packed(test, t.n).persist()

        def fit(i: int, part: DataFrame = part, test: DataFrame = test) -> tuple[int, float]:
            model = estimator(combos[i]).fit(part)
            tested = model.transform(test).withColumn("p", probability)
            return i, tested.agg(negative_brier("p", "label").alias("s")).first()["s"]

        for i, s in _parallel([lambda i=i: fit(i) for i in range(len(combos))], parallelism):
            scores.append((split, str(combos[i]), s))
        part.unpersist()
        test.unpersist()
    table = cut_lineage(
        cv_results(spark.createDataFrame(scores, "split INT, param STRING, score DOUBLE"))
    )
    best = _best(table)
    model = estimator(next(c for c in combos if str(c) == best)).fit(t.vectors)
    weights = model.featureImportances.toArray()
    found = [(t.vocab[i], float(weights[i])) for i in weights.nonzero()[0]]
    importances = spark.createDataFrame(found, "motif STRING, importance DOUBLE")
    right = model.transform(t.vectors).agg(accuracy("label", "prediction").alias("a")).first()["a"]
    return FitResult(model, t.vocab, importances, table, best, right, t.n)


def save_model(result: FitResult, path: str) -> None:
    """Model, feature vector, coefficients and CV table under one folder."""
    spark = result.coefficients.sparkSession
    result.model.write().overwrite().save(f"{path}/model")
    rows = list(enumerate(result.vocab))
    spark.createDataFrame(rows, "idx BIGINT, feature STRING").write.mode("overwrite").parquet(
        f"{path}/vocab"
    )
    for name, table in (("coefficients", result.coefficients), ("cv_results", result.cv_results)):
        table.coalesce(1).write.mode("overwrite").option("sep", "\t").option(
            "header", name == "cv_results"
        ).csv(f"{path}/{name}")


def load_model(spark: SparkSession, path: str) -> tuple[object, list[str], DataFrame]:
    """What `save_model` wrote: the model, its feature order and coefficients."""
    kind = spark.read.text(f"{path}/model/metadata").first()["value"]
    loader = GBTClassificationModel if "GBTClassificationModel" in kind else LogisticRegressionModel
    vocab = vocabulary_list(spark.read.parquet(f"{path}/vocab"))
    coefs = spark.read.schema("motif STRING, coef DOUBLE").option("sep", "\t").csv(
        f"{path}/coefficients"
    )
    return loader.load(f"{path}/model"), vocab, coefs
