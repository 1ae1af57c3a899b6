"""Stages of the pipeline on what the stage before has left."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from strandwise.llm import quality_rules, simhash


def test_rules_learn_from_rows_that_an_earlier_stage_dropped(spark, tmp_path):
    rng = random.Random(9)

    def text(good):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(70)]
        return " ".join(words if good else [w + rng.choice("#$%") + rng.choice("*|") for w in words])

    rows = [(i, text(i % 3 > 0)) for i in range(240)] + [(900, text(False)), (901, text(True))]
    whole = spark.createDataFrame(rows, "doc_id long, text string")
    whole.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    left = whole.where("doc_id % 3 > 0 or doc_id >= 900")
    kept = {r.doc_id for r in corpus_pipeline.quality_rules_stage(spark, left, str(tmp_path)).collect()}
    assert kept == {i for i in range(240) if i % 3 > 0} | {901}


def test_near_duplicates_by_the_distance_of_fingerprints(spark, tmp_path):
    """One row a component of fingerprints at three bits or fewer, nulls and repeated rows included."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=400))) for i in range(30)]
    rows += [(100 + i, t + " end") for i, t in rows[:12]] + [(200, rows[3][1]), (3, rows[3][1]), (300, None), (301, ""), (None, "x")]
    table = [(k, t, 7.5, "a") for k, t in rows]
    made = spark.createDataFrame(table, "doc_id long, text string, score double, removed string")
    made.write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    left = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    prints = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            group[i] = min(group[j] for j, b in enumerate(prints) if (a ^ b).bit_count() <= 3)
    want = {min((rows[i][0] is None, rows[i][0] or 0, rows[i][0]) for i in range(len(rows)) if group[i] == g)[2] for g in set(group)}
    got = [r.doc_id for r in left.collect()]
    assert len(got) == len(set(got)) and set(got) - {None} == want - {None} and len(want) < 40
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_stages_keep_the_columns_of_the_caller(spark, tmp_path):
    rows = [(i, ("some plain words of prose %d " % i) * 30, -1.0, "mine", i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, removed string, predicted int")

    def same(d):
        return d.withColumns({"score": F.lit(0.5), "removed": F.lit("its own"), "predicted": F.lit(1)}).where("predicted = 1")

    out = corpus_pipeline.beside(docs, same)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(rows)
    cut = corpus_pipeline.substring_dedup(spark, docs, str(tmp_path))
    assert cut.columns == docs.columns
    assert {(r.score, r.removed, r.predicted - r.doc_id) for r in cut.collect()} == {(-1.0, "mine", 0)}


def test_the_fit_reaches_the_least_loss_of_its_rows(spark):
    """The tasks' passes against plain gradient descent over the same bags, all on one machine."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["aa", "ab", "ba", "bb"][i % 2 :: 2] + ["cc"], k=12)), i % 2) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    rules = quality_rules.fit_rules(docs, labels, F.lit(True))
    folds = docs.select("doc_id", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(4)).alias("f")).collect()
    learnt = {r["doc_id"] for r in folds if r["f"] != 3}
    size = quality_rules.BUCKETS * 5
    used = [(r[1], r[2]) for r in rows if r[0] in learnt]
    x = np.zeros((len(used), size + 1))
    for i, (columns, shares) in enumerate(quality_rules.bags(pa.array([t for t, _ in used]))):
        x[i, columns], x[i, size] = shares, 1
    y = np.array([label for _, label in used], float)
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    penalty = np.r_[np.full(size, quality_rules.PENALTY), 0]

    def loss(w):
        z = x @ w
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + (penalty * w * w).sum() / 2

    own = np.r_[rules.weights, rules.intercept]
    w = np.zeros(size + 1)
    for _ in range(3000):
        w -= 2.0 * (x.T @ (weight * (1 / (1 + np.exp(-x @ w)) - y)) + penalty * w)
    assert loss(own) <= loss(w) + 1e-4 and loss(own) < 0.05
    kept = {r.doc_id: r.probability for r in quality_rules.judge(docs, rules).collect()}
    assert all((kept[i] > 0.5) == bool(label) for i, _, label in rows)
