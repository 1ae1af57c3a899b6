import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.operators import models, sampling, solver
from strandwise.sources import tables
from strandwise.streaming import scoring


@pytest.fixture(scope="module")
def data(spark):
    """Motif M0 makes label 1 likely; a twelfth of the rows is ambiguous."""
    rnd = random.Random(6)
    meta, feats = [], []
    for i in range(120):
        label = i % 2
        meta.append((f"r{i}", -1 if i % 12 == 0 else label, "s", f"g{i % 8}"))
        for m in range(5):
            n = rnd.randrange(3) + (3 * label if m == 0 else 0)
            if n:
                feats.append((f"r{i}", f"M{m}", n))
    return (
        spark.createDataFrame(feats, "accession STRING, motif STRING, cnt BIGINT"),
        spark.createDataFrame(meta, tables.METADATA_SCHEMA),
    )


def l1_loss_minimum(x, y, c):
    """Proximal gradient on |w|_1 + C * sum(log loss), no intercept."""
    w = np.zeros(x.shape[1])
    step = 1.0 / (c * 0.25 * np.linalg.norm(x, 2) ** 2)
    for _ in range(20_000):
        grad = c * x.T @ (1 / (1 + np.exp(-x @ w)) - y)
        z = w - step * grad
        w = np.sign(z) * np.maximum(np.abs(z) - step, 0)
    return w


def test_l1_group_splits(spark, data, tmp_path):
    feats, meta = data
    fit = models.fit_l1_gss(feats, meta, [0.01, 1.0], n_splits=3, test_size=0.25, seed=5)
    assert fit.n_rows == 110 and fit.vocab == [f"M{i}" for i in range(5)]
    table = fit.cv_results.orderBy("mean_test_score").collect()
    assert [r["n_splits"] for r in table] == [3, 3] and table[-1]["param"] == fit.best == 1.0
    assert fit.train_accuracy > 0.8
    coef = {r["motif"]: r["coef"] for r in fit.coefficients.collect()}
    assert coef["M0"] > 0
    wide = (
        feats.join(meta.filter("label > -1"), "accession")
        .groupBy("accession", "label").pivot("motif", fit.vocab).sum("cnt").fillna(0).toPandas()
    )
    want = l1_loss_minimum(wide[fit.vocab].to_numpy(float), wide["label"].to_numpy(float), fit.best)
    got = np.array([coef.get(m, 0.0) for m in fit.vocab])
    assert np.allclose(got, want, atol=1e-3), (got, want)
    models.save_model(fit, str(tmp_path / "fit"))
    model, vocab, coefs = models.load_model(spark, str(tmp_path / "fit"))
    assert vocab == fit.vocab and {r["motif"]: r["coef"] for r in coefs.collect()} == pytest.approx(coef)
    assert np.allclose(model.coefficients.toArray(), got)


def test_resampled_rows(data):
    feats, meta = data
    fit = models.fit_l1_gss(feats, meta, [1.0], n_splits=2, test_size=0.25, resample=150, seed=5)
    assert fit.n_rows == 150


def test_folds_and_elastic_net(data):
    feats, meta = data
    fit = models.fit_l1_cv(feats, meta, folds=3, cs=[0.001, 1.0], max_iter=100, seed=1)
    assert models.INTERCEPT in fit.vocab and fit.best == 1.0
    fit = models.fit_elastic_net(feats, meta, folds=3, alphas=[0.001], max_iter=100, seed=1)
    assert fit.train_accuracy > 0.8 and fit.model.intercept != 0


def test_boosted_trees(data):
    feats, meta = data
    grid = {"max_depth": [2], "n_estimators": [3, 5]}
    fit = models.fit_boosted_gss(feats, meta, grid, n_splits=2, test_size=0.25, seed=1)
    assert fit.train_accuracy > 0.8
    best = fit.coefficients.orderBy(F.col("importance").desc()).first()
    assert best["motif"] == "M0"
    with pytest.raises(ValueError):
        models.tree_grid({"no_such_name": [1]})


def test_real_valued_features(spark, data):
    feats, meta = data
    shares = feats.withColumn("rel_freq", F.col("cnt") / 6).drop("cnt")
    fit = models.fit_l1_gss(shares, meta, [10.0], n_splits=2, test_size=0.25, seed=5, value="rel_freq")
    assert fit.train_accuracy > 0.8


def test_stream_scores_each_file_once(spark, tmp_path):
    coefs = spark.createDataFrame([("ACG", 0.5)], "motif STRING, coef DOUBLE")
    schema = "seq_id STRING, seq STRING"
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for batch in ([("a", "ACGACG")], [("b", "TTT")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        seqs = spark.readStream.schema(schema).parquet(folder)
        scoring.score_stream(seqs, coefs, out, state).awaitTermination()
    got = {r["accession"]: r["predict_proba"] for r in scoring.read_scores(spark, out).collect()}
    assert got["a"] == pytest.approx(1 / (1 + np.exp(-1.0))) and got["b"] == 0.5 and len(got) == 2


def wide_rows(feats, meta, vocab):
    return (
        feats.join(meta.filter("label > -1"), "accession")
        .groupBy("accession", "label", "groups").pivot("motif", vocab).sum("cnt").fillna(0).toPandas()
    )


def test_batched_search_equals_single_fits(data):
    """Every split and penalty against a plain solve of its own training rows."""
    feats, meta = data
    cs = [0.05, 1.0, 50.0]
    fit = models.fit_l1_gss(feats, meta, cs, n_splits=4, test_size=0.25, seed=5)
    rows = wide_rows(feats, meta, fit.vocab)
    x, y = rows[fit.vocab].to_numpy(float), rows["label"].to_numpy(float)
    held = sampling.group_shuffle_split(meta.filter("label > -1"), "groups", 4, 0.25, 5).filter("is_test").toPandas()
    scores = {c: [] for c in cs}
    for _, names in held.groupby("split")["groups"]:
        out = rows["groups"].isin(names).to_numpy()
        for c in cs:
            w = l1_loss_minimum(x[~out], y[~out], c)
            p = 1 / (1 + np.exp(-x[out] @ w))
            scores[c].append(-np.mean((p - y[out]) ** 2))
    for r in fit.cv_results.collect():
        assert r["mean_test_score"] == pytest.approx(np.mean(scores[r["param"]]), abs=2e-5)
        assert r["std_test_score"] == pytest.approx(np.std(scores[r["param"]]), abs=2e-5)


def test_solver_matches_ml_fits_and_blocks(spark, data, monkeypatch):
    """Elastic net with a free coordinate, sparse path, several blocks of models: the same minima."""
    feats, meta = data
    labels = meta.filter("label > -1").withColumn("weight", F.lit(1.0))
    vocab = spark.createDataFrame([(i, f"M{i}") for i in range(5)], "idx BIGINT, feature STRING")
    cells = feats.join(labels, "accession", "left_semi")
    found = solver.design(cells, labels, vocab, None).persist()
    l1, l2 = np.full((3, 5), 0.02), np.full((3, 5), 0.05)
    l1[2] = l2[2] = 0.0
    m = solver.Models(np.full(3, -1), l1, l2)
    w = solver.solve(found, m)
    rows = wide_rows(feats, meta, [f"M{i}" for i in range(5)])
    x, y = rows[[f"M{i}" for i in range(5)]].to_numpy(float), rows["label"].to_numpy(float)
    for k in range(3):
        slope = x.T @ (1 / (1 + np.exp(-x @ w[k])) - y) / len(y) + l2[k] * w[k]
        used = w[k] != 0
        assert np.allclose(slope[used] + l1[k][used] * np.sign(w[k][used]), 0, atol=1e-5)
        assert (np.abs(slope[~used]) <= l1[k][~used] + 1e-6).all()
    monkeypatch.setattr(solver, "SOLVE_CELLS", 5)
    assert np.allclose(solver.solve(found, m), w, atol=1e-5)
    batch = found.toArrow().combine_chunks().to_batches()[0]
    dense = solver._Rows(batch, 5, np.zeros(0, np.int64))
    sparse = solver._Rows(batch, 5, np.zeros(0, np.int64))
    sparse.dense = None
    rest = np.linspace(-1, 1, batch.num_rows * 3).reshape(-1, 3)
    assert np.allclose(dense.margins(w), sparse.margins(w))
    assert np.allclose(dense.gradient(rest, 5), sparse.gradient(rest, 5))
    assert sum(c.num_rows for c in solver._chunks(iter([batch]), 5, 3)) == batch.num_rows


def test_weighted_rows_equal_copied_rows(spark, data):
    """A row drawn n times weighs n: the same model, scores and sizes as n copies."""
    feats, meta = data
    kept = meta.filter("label > -1")
    fit = models.fit_l1_gss(feats, meta, [0.1, 10.0], n_splits=3, test_size=0.25, resample=150, seed=5)
    used = feats.select("accession").distinct().join(kept, "accession")
    drawn = sampling.stratified_resample(used, 150, "groups", "accession", 5)
    weights = sampling.resample_weights(used, 150, "groups", "accession", 5)
    assert drawn.count() == 150 == weights.agg(F.sum("weight")).first()[0] and weights.count() < 150
    copies = drawn.withColumn("copy", F.concat_ws("#", "accession", "draw_no"))
    copied = copies.join(feats, "accession").select(F.col("copy").alias("accession"), "motif", "cnt")
    named = copies.select(F.col("copy").alias("accession"), "label", "species", "groups")
    plain = models.fit_l1_gss(copied, named, [0.1, 10.0], n_splits=3, test_size=0.25, seed=5)
    assert fit.n_rows == plain.n_rows == 150 and fit.best == plain.best
    assert fit.train_accuracy == pytest.approx(plain.train_accuracy)
    for a, b in zip(fit.cv_results.collect(), plain.cv_results.collect()):
        assert a["param"] == b["param"] and a["mean_test_score"] == pytest.approx(b["mean_test_score"], abs=1e-5)
    own = {r["motif"]: r["coef"] for r in fit.coefficients.collect()}
    assert own == pytest.approx({r["motif"]: r["coef"] for r in plain.coefficients.collect()}, abs=1e-4)


@pytest.mark.parametrize("files", [0, 3])
def test_stream_scores_read_a_file_or_a_folder(spark, tmp_path, files):
    """The documents table is one file, or a folder of files."""
    from strandwise.plans.registry import REGISTRY

    docs = spark.createDataFrame([(i, "acgt" * i + "gtc") for i in range(20)], "doc_id BIGINT, text STRING")
    if files:
        docs.repartition(files).write.parquet(str(tmp_path / "documents.parquet"))
    else:
        docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    got = REGISTRY["stream_scores"](spark, str(tmp_path))
    want = REGISTRY["score_sequences"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 20


def test_sums_reach_the_driver_as_one_matrix(spark, monkeypatch):
    """However many partitions the rows have; no task per so many rows is made either."""
    from strandwise.operators import solver

    rows = [(float(i % 2), 1.0, [], [i % 3], [1.0]) for i in range(90)]
    schema = "label DOUBLE, weight DOUBLE, held ARRAY<INT>, idx ARRAY<INT>, val ARRAY<DOUBLE>"
    data = spark.createDataFrame(rows, schema)
    w, split, collected = np.zeros((2, 3)), np.array([-1, -1]), []
    kept = type(data).collect

    def collect(df):
        collected.append(kept(df))
        return collected[-1]

    monkeypatch.setattr(type(data), "collect", collect)
    sums = [solver._sums(data.repartition(n), w, split, solver._losses, 5) for n in (1, 30)]
    assert [len(c) for c in collected] == [1, 1] and np.allclose(sums[0], sums[1])
