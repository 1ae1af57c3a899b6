"""Runs of candidates against brute force, what they leave out, and how blocks are dealt."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwise.llm import pivots


def brute(row, q, c_row, c_id, x, k):
    out = []
    for i in range(len(q)):
        score = x @ q[i]
        order = [j for j in np.lexsort((c_id, -score)) if c_row[j] != row[i]][:k]
        out += [(i, int(c_id[j]), int(score[j])) for j in order]
    return out


class Watched:
    """Rows of a matrix; notes which are taken."""

    def __init__(self, x):
        self.x, self.taken = x, []

    def __getitem__(self, rows):
        self.taken.append(rows.stop - rows.start)
        return self.x[rows]


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_runs_equal_brute_force(monkeypatch, kind):
    """A run is met by all queries in one product; ties go to the smaller id, the own row is left out."""
    monkeypatch.setattr(pivots, "RUN", 16)
    rng = np.random.default_rng(4)
    x = rng.integers(-6, 7, (500, 3)).astype(float)  # many ties
    row, ids = np.arange(500), rng.permutation(500)
    space = pivots.Space(pivots.choose_pivots(x), (x**2).sum(1).max())
    block = pivots.Block(row, ids, x.astype(kind), space)
    block.x = watched = Watched(block.x)
    own, floor = row[:200], np.full(200, -np.inf)
    q = x[own].astype(kind)
    i, j, score = pivots.search(own, q, space.of_queries(q), floor, block, space.most, 5)
    assert list(zip(i, block.id[j], score)) == brute(own, x[own], row, ids, x, 5)
    assert len(watched.taken) <= len(block.low) < 60  # not once a query


def test_far_runs_are_left_out():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-9, 9, (4000, 4)) + c for c in ([900, 0, 0, 0], [0, 900, 0, 0], [-900, 0, 0, 0])]).astype(float)
    row = np.arange(len(x))
    space = pivots.Space(pivots.choose_pivots(x), (x**2).sum(1).max())
    block = pivots.Block(row, row, x, space)
    block.x = watched = Watched(block.x)
    own = row[:50]
    i, j, score = pivots.search(own, x[own], space.of_queries(x[own]), np.full(50, -np.inf), block, space.most, 5)
    assert list(zip(i, block.id[j], score)) == brute(own, x[own], row, row, x, 5)
    assert sum(watched.taken) <= 4000


def test_each_block_is_a_task(spark, tmp_path, capsys):
    """Dealt by hash, several blocks met in one task, which then took several times as long as the others."""
    spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(100)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "v"))
    vectors = spark.read.parquet(str(tmp_path / "v"))
    pivots.top_k(vectors, "vec_id", "embedding", F.col("vec_id") % 50 == 0).explain()
    dealt = [line for line in capsys.readouterr().out.splitlines() if "REPARTITION_BY_NUM" in line]
    assert len(dealt) == 1 and "hashpartitioning" not in dealt[0]


def test_equal_vectors_are_not_all_sorted(monkeypatch):
    """Of very many equal scores a task goes on with those that can be among the k best by id."""
    monkeypatch.setattr(pivots, "RUN", 64)
    monkeypatch.setattr(pivots, "GROUP", 8)
    rng = np.random.default_rng(6)
    x, row, ids = np.ones((2000, 4)), np.arange(2000), rng.permutation(2000)
    ids[7] = np.iinfo(np.int64).max  # a null id
    space = pivots.Space(pivots.choose_pivots(x), 4.0)
    block = pivots.Block(row, ids, x, space)
    sorted_, sort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: (sorted_.append(len(keys[0])), sort(keys))[1])
    i, j, score = pivots.search(row[:8], x[:8], space.of_queries(x[:8]), np.full(8, 4.0), block, 4.0, 5)
    monkeypatch.undo()
    assert list(zip(i, block.id[j], score)) == brute(row[:8], x[:8], row, ids, x, 5)
    assert sum(sorted_) < 4000  # of 16,000 scores
