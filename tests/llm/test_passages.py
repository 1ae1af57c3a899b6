"""Repeated passages are cut to their true ends."""

import random

import pytest
from pyspark.sql import functions as F

from strandwise.llm import chunks


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


def true_span(first, at, second, own, size):
    """The repeat around a planted passage, to where the texts differ, drawn in to whole characters."""
    b, e, p, q = own, own + size, at, at + size
    while b and p and second[b - 1] == first[p - 1]:
        b, p = b - 1, p - 1
    while e < len(second) and q < len(first) and second[e] == first[q]:
        e, q = e + 1, q + 1
    while second[b] & 0xC0 == 0x80:
        b += 1
    while e < len(second) and second[e] & 0xC0 == 0x80:
        e -= 1
    return b, e - b


@pytest.mark.parametrize("margin", [128, 1])
def test_short_passages_go_whole(spark, monkeypatch, margin):
    monkeypatch.setattr(chunks, "MARGIN", margin)
    rng, rows, want = random.Random(3), [], {}
    for n in [*range(51, 61), 90, 150] * 5:
        passage = words(rng, n - 2) + rng.choice([" ñé", " xy"]) + " " + words(rng, 1)
        pair = []
        for letter in "êè":
            before, after = words(rng, rng.randint(0, 60)) + letter, letter + words(rng, rng.randint(0, 60))
            pair.append((len(before.encode()), (before + passage + after).encode()))
        k = len(rows)
        rows += [(k, pair[0][1].decode()), (k + 1, pair[1][1].decode())]
        want[k], want[k + 1] = [], [true_span(pair[0][1], pair[0][0], pair[1][1], pair[1][0], len(passage.encode()))]
    once = words(rng, 60)
    rows += [(5000, once + " middle " + once), (None, words(rng, 40)), (None, None), (5001, "")]
    out = chunks.without_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r.doc_id: [(x.begin, x.length) for x in r.removed] for r in out if r.doc_id is not None}
    missed = [k for k in want if got[k] != want[k]]
    assert not missed
    assert got[5000] and got[5000][-1][1] >= len(once)
    assert len(out) == len(rows)


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string").withColumn("removed", F.lit(1))
    assert chunks.without_passages(none).count() == 0
