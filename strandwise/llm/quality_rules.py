"""Quality rules: hashed word and character n-gram logistic regression, calibrated, with thresholds.

A text is a bag of hashed word 1- and 2-grams and character 3-, 4- and 5-grams
(bytes), each kind normalised to sum to one over the text. A logistic
regression is fitted on a bounded sample of labelled quality rows, one part of
which is held back to calibrate the probability (Platt scaling). Scoring takes
whole texts in Arrow batches: hashes of all n-grams of a batch come from array
operations, weights are looked up and summed by text. A text is kept if it
passes the base rules and its calibrated probability reaches the threshold.

Defined results: a null or empty text has no words, fails the base rules and is
not kept. Without labelled rows, or with one class only, the probability is the
share of label 1 (1 without rows) and the base rules decide. Repeated rows are
judged each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import SPACES, byte_view, cut_lineage, drop_table, extended, pieces, texts_of
from strandwise.llm.quality_trees import labelled_sample
from strandwise.operators import solver

#: Labelled rows that the regression is fitted on, at most.
MAX_LABELLED = 2_000
#: Quasi-Newton steps of the fit, the weight of its squared penalty, and tasks that share the bounded sample.
STEPS = 100
PENALTY = 1e-5
FIT_TASKS = 4
#: Text bytes of a step; its n-grams take about 100 times that.
STEP = 1 << 20
BUCKETS = 1 << 15
CHAR_SIZES = (3, 4, 5)
MIN_PROBABILITY = 0.3
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
_KINDS = 2 + len(CHAR_SIZES)
_ODD = 0x9E3779B97F4A7C15
_STEP = 0x100000001B3
_LETTER = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0xA0761D6478BD642F)
_IS_SPACE = np.isin(np.arange(256), list(SPACES))


def _mix(h: np.ndarray, kind: int) -> np.ndarray:
    """Bucket of a 64-bit hash; each kind of n-gram has buckets of its own."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_ODD)
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64) + kind * BUCKETS


def grams(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: the text's number and the bucket of every n-gram of a column."""
    data, at = byte_view(column)
    n, size = len(at) - 1, len(data)
    text = np.repeat(np.arange(n), np.diff(at))
    letters = _LETTER[data]
    space = _IS_SPACE[data]
    out = []
    # Words: a polynomial hash of the bytes from the word's start.
    first = ~space
    first[1:] &= space[:-1] | (text[1:] != text[:-1])
    starts = np.flatnonzero(first)
    power = np.full(4096, _STEP, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    number = np.cumsum(first) - 1
    inside = ~space
    words = np.zeros(len(starts), np.uint64)
    if len(starts):
        place = np.arange(size)[inside] - starts[number[inside]]
        valued = letters[inside] * power[place & 4095]
        edges = np.flatnonzero(np.diff(number[inside], prepend=-1))
        words = np.add.reduceat(valued, edges)
    owner = text[starts]
    out.append((owner, _mix(words, 0)))
    pair = words[:-1] * np.uint64(_STEP) + words[1:] * np.uint64(_ODD) if len(words) else words
    same = owner[:-1] == owner[1:]
    out.append((owner[:-1][same], _mix(pair[same], 1)))
    for kind, k in enumerate(CHAR_SIZES, 2):
        m = max(size - k + 1, 0)
        h = np.zeros(m, np.uint64)
        for j in range(k):
            h = h * np.uint64(_STEP) + letters[j : j + m]
        same = text[:m] == text[k - 1 : k - 1 + m]
        out.append((text[:m][same], _mix(h[same], kind)))
    return out


@dataclass(frozen=True)
class Rules:
    """Weights of the buckets, the intercept, and the two numbers of the calibration."""

    weights: np.ndarray
    intercept: float
    slope: float
    shift: float

    def margin(self, column: pa.Array) -> np.ndarray:
        total = np.full(len(column), self.intercept)
        for owner, bucket in grams(column):
            sums = np.bincount(owner, self.weights[bucket], len(column))
            total += sums / np.maximum(np.bincount(owner, minlength=len(column)), 1)
        return total

    def probability(self, column: pa.Array) -> np.ndarray:
        return _logistic(self.slope * self.margin(column) + self.shift)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def bags(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text: its buckets, ascending, and their shares within their kinds."""
    n = len(column)
    keys, shares = [], []
    for kind, (owner, bucket) in enumerate(grams(column)):
        key, count = np.unique(owner * (BUCKETS * _KINDS) + bucket, return_counts=True)
        keys.append(key)
        shares.append(count / np.bincount(owner, minlength=n)[key // (BUCKETS * _KINDS)])
    key, share = np.concatenate(keys), np.concatenate(shares)
    order = np.argsort(key, kind="stable")
    key, share = key[order], share[order]
    at = np.searchsorted(key, np.arange(n + 1) * (BUCKETS * _KINDS))
    return [(key[a:b] % (BUCKETS * _KINDS), share[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps, with targets drawn in by the counts."""
    up, down = label.sum(), len(label) - label.sum()
    target = np.where(label > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _logistic(a * margin + b)
        g = np.array([((p - target) * margin).sum() + 1e-3 * (a - 1), (p - target).sum()])
        w = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(w * margin**2).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        step /= max(1.0, np.abs(step).max())
        a, b = a - step[0], b - step[1]
    return float(max(a, 0.0)), float(b)


def fit_rules(
    docs: DataFrame, labels: DataFrame, usable: Column, text: str = "text", most: int = MAX_LABELLED
) -> Rules:
    """A regression from documents with a usable label; the sample's ids and labels are broadcast.

    The bags of the sample are a written table. Each step of the fit is a pass
    over it in tasks, which send back one slope a bucket; the driver sees no bag.
    """
    spark = docs.sparkSession
    sample = labelled_sample(labels, "quality", usable, most)
    size = BUCKETS * _KINDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text, STEP):
                own = bags(part.column(text))
                # The last entry is the intercept's.
                idx = pa.array([np.r_[c, size].astype("<i4").tobytes() for c, _ in own], pa.binary())
                val = pa.array([np.r_[v, 1.0].astype("<f4").tobytes() for _, v in own], pa.binary())
                yield pa.record_batch([part.column("label"), part.column("fold"), idx, val], ["label", "fold", "idx", "val"])

    rows = docs.select("doc_id", F.col(text).cast("string").alias(text)).join(F.broadcast(sample), "doc_id")
    fold = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(4)).cast("int").alias("fold")
    bagged = cut_lineage(
        rows.select(F.col("label").cast("int").alias("label"), fold, text)
        .mapInArrow(run, "label int, fold int, idx binary, val binary")
    )
    # A quarter of the rows calibrates, if both parts hold both labels.
    counts = {(r[0], r[1]): r[2] for r in bagged.groupBy("label", F.col("fold") == 3).count().collect()}
    share = {label: sum(n for (x, _), n in counts.items() if x == label) for label in (0, 1)}
    if not share[0] or not share[1]:
        return Rules(np.zeros(size), 0.0, 0.0, -35.0 if share[0] else 35.0)
    apart = all(counts.get((label, part)) for label in (0, 1) for part in (False, True))
    learnt = {label: counts[label, False] if apart else share[label] for label in (0, 1)}
    calibrates = (F.col("fold") == 3) if apart else F.lit(False)
    # Both classes weigh the same while the direction is learnt; calibration restores the shares.
    weight = F.when(F.col("label") > 0, 0.5 / learnt[1]).otherwise(0.5 / learnt[0])
    none = F.array().cast("array<int>")
    data = bagged.select(
        F.col("label").cast("double").alias("label"),
        weight.alias("weight"),
        F.when(calibrates, F.array(F.lit(0))).otherwise(none).alias("held"),
        "idx",
        "val",
    ).repartition(FIT_TASKS).persist()
    flat = np.zeros((1, size + 1))
    penalty = np.full((1, size + 1), PENALTY)
    penalty[0, size] = 0.0
    found = solver.solve(data, solver.Models(np.array([0 if apart else -1]), flat, penalty), STEPS, 1e-6, narrow=True)[0]
    sent = spark.sparkContext.broadcast(found)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for idx, val in zip(batch.column("idx"), batch.column("val")):
                numbers = np.frombuffer(idx.as_py(), "<i4"), np.frombuffer(val.as_py(), "<f4")
                sums.append(float(sent.value[numbers[0]] @ numbers[1]))
            yield pa.record_batch([batch.column("label"), pa.array(sums, pa.float64())], ["label", "margin"])

    chosen = data.where(F.size("held") == 1) if apart else data
    pairs = chosen.mapInArrow(margins, "label double, margin double").toPandas()
    data.unpersist()
    drop_table(bagged)
    return Rules(found[:size], float(found[size]), *_platt(pairs["margin"].to_numpy(), pairs["label"].to_numpy()))


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated 3-word windows."""
    words = text.split()
    points = sum(len(w.decode()) for w in words) if not text.isascii() else sum(map(len, words))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        often = {w for w, k in Counter(windows).items() if k > 1}
        last = -1
        for i, w in enumerate(windows):
            if w in often:
                repeated += i + 3 - max(i, last)
                last = i + 3
    return len(words), points, symbols, len(lines) - len(set(lines)), repeated


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = (*BASE, "base_failed", "probability", "kept")


def judge(
    docs: DataFrame,
    rules: Rules,
    text: str = "text",
    min_probability: float = MIN_PROBABILITY,
    min_words: int = MIN_WORDS,
    max_repeated_percent: int = MAX_REPEATED_PERCENT,
) -> DataFrame:
    """`docs` with the columns `ADDED`; columns of these names are replaced."""
    docs = docs.drop(*ADDED)
    fields = docs.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text, STEP):
                counts = [base_counts(t) for t in texts_of(part.column(text))]
                base = np.array(counts, np.int64).reshape(-1, len(BASE))
                failed = (base[:, 0] < min_words) | (100 * base[:, 4] > max_repeated_percent * base[:, 0])
                chance = rules.probability(part.column(text))
                kept = ~failed & (chance >= min_probability)
                yield pa.record_batch(
                    [*part.columns, *map(pa.array, base.T), pa.array(failed), pa.array(chance), pa.array(kept)],
                    [*fields, *ADDED],
                )

    counted = ", ".join(f"{name} long" for name in BASE)
    schema = extended(docs, f"{counted}, base_failed boolean, probability double, kept boolean")
    return docs.mapInArrow(run, schema)
