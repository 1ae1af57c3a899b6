"""Ranked lexical search against scores of all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from strandwise.llm import ball_tree as bt
from strandwise.llm import queries
from strandwise.llm.terms import word_lists

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return Counter(t.translate(UPPER) for t in TERM.findall(text or ""))


def brute(docs, items, k=10):
    counted = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 100 - 90 + (90 * c.total() * n_docs) // n_terms if n_terms else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                for t in terms(text) if t in c
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def texts(rng, n, vocabulary=120):
    own = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    return [" ".join(rng.choices(own, weights, k=rng.randrange(0, 40))) for _ in range(n)]


def frames(spark, docs, items):
    return (
        spark.createDataFrame(docs, "doc_id BIGINT, text STRING"),
        spark.createDataFrame(items, "item_id BIGINT, text STRING"),
    )


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("span", [1, 4, 7])
def test_no_bound_is_below_a_score(span):
    rng = np.random.default_rng(span)
    for _ in range(20):
        n, width = int(rng.integers(1, 120)), 40
        sizes = rng.integers(1, 12, n)
        rows = [np.sort(rng.choice(width, s, replace=False)) for s in sizes]
        values = rng.integers(1, 1_000_000, sizes.sum())
        tree = bt.BallTree(np.r_[0, np.cumsum(sizes)], np.concatenate(rows), values.copy(), width, span)
        assert sorted(tree.rows.tolist()) == list(range(n))
        terms = rng.choice(width, 6, replace=False)
        dense = np.zeros(width, np.int64)
        dense[terms] = rng.integers(0, 12_000, 6)
        bound = tree.bounds(terms, dense[terms].astype(float))
        at = np.r_[0, np.cumsum(sizes)]
        exact = [int((dense[rows[i]] * values[at[i] : at[i + 1]]).sum()) for i in range(n)]
        for node, (first, end, left, _) in enumerate(tree.nodes):
            own = [exact[r] for r in tree.rows[first:end]]
            assert max(own) <= bound[node]
            if not left:
                assert sorted(tree.scores(node, dense)[1].tolist()) == sorted(own)


def test_equals_all_pairs_and_passes_nodes_over(spark, monkeypatch):
    from pyspark.accumulators import AccumulatorParam

    class Sums(AccumulatorParam):
        def zero(self, value):
            return np.zeros(2, np.int64)

        def addInPlace(self, a, b):
            return a + b

    rng = random.Random(3)
    docs = list(enumerate(texts(rng, 900)))
    items = list(enumerate(texts(rng, 25)))
    tally = spark.sparkContext.accumulator(np.zeros(2, np.int64), Sums())
    d, q = frames(spark, docs, items)
    got = bt.top_documents(d.coalesce(1), q, "doc_id", "item_id", tally=tally)
    assert found(got) == brute(docs, items)
    monkeypatch.setattr(bt, "BLOCK_TERMS", 30)  # several blocks of queries
    assert found(bt.top_documents(d, q, "doc_id", "item_id")) == brute(docs, items)
    assert 0 < tally.value[0] < tally.value[1]


def test_ties_repeats_nulls_and_long_texts(spark, tmp_path):
    docs = [(i, "same words here") for i in range(30, 0, -1)]
    docs += [(None, "same words here"), (None, None), (100, None), (101, ""), (102, "..."), (3, "same words here")]
    docs += [(103, "long same " * 300_000), (104, "x" * 3_000_000), (105, "ÀÉ École 7 z_z")]
    items = [(1, "SAME words"), (1, "SAME words"), (2, None), (3, ""), (None, "école ÀÉ Z 7"), (5, "absent"), (6, "x" * 3_000_000)]
    d, q = frames(spark, docs, items)
    assert found(bt.top_documents(d, q, "doc_id", "item_id", k=33)) == brute(docs, items, 33)
    d.selectExpr("*", "1 AS rank", "'a' AS score", "2 AS _n").write.parquet(f"{tmp_path}/documents.parquet")
    q.selectExpr("*", "1 AS id", "2 AS _terms").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = queries.op11_lexical_search(spark, str(tmp_path))
    assert rows.columns == ["item_id", "rank", "doc_id", "score"] and found(rows) == brute(docs, items)


def test_empty_tables(spark):
    d, q = frames(spark, [], [(1, "a")])
    assert bt.top_documents(d, q, "doc_id", "item_id").collect() == []
    d, q = frames(spark, [(1, "a")], [])
    assert bt.top_documents(d, q, "doc_id", "item_id").collect() == []


def test_words_are_whole_across_stretches():
    text = ("Ab-ç1 " * 50 + "z" * 300).encode()
    parts = list(word_lists(text, 64))
    assert len(parts) > 2 and [w for p in parts for w in p] == [w for p in word_lists(text) for w in p]
