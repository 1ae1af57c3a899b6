"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

Every text becomes a fixed row of statistics in one vectorised pass over its
bytes. Trees are grown on a bounded sample of labelled rows, whose statistics
(not texts) come to the driver, and are laid out as flat arrays of complete
binary trees, so scoring is a few array look-ups a level and needs no Python
loop over documents.

Defined results: a null or empty text has the statistics of a text without
words and gets their score; without labelled rows, or with one class only, all
documents get the share of label 1 (0.5 without rows). Rows with a null label
or outside {0, 1} are not learnt from. Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import byte_view, extended, pieces

#: Labelled rows that the trees are grown on, at most.
MAX_LABELLED = 20_000
ACCEPT = 0.3
STATISTICS = (
    "log_bytes", "log_words", "upper", "lower", "digits", "spaces", "symbols", "stops", "other_ascii",
    "high_bytes", "log_lines", "word_length", "word_length_spread", "longest_word", "distinct_words",
    "repeated_next", "top_word", "repeated_lines", "repeated_triples", "byte_entropy",
    "letters_in_words", "ends_with_stop",
)
_CLASSES = {
    1: b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    2: b"abcdefghijklmnopqrstuvwxyz",
    3: b"0123456789",
    4: b" \t\n\v\f\r",
    5: b"#*$%&|<>",
    6: b".,;:!?",
}


def _class_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[128:] = 7
    for k, members in _CLASSES.items():
        table[list(members)] = k
    return table


_CLASS = _class_table()


def statistics(column: pa.Array) -> np.ndarray:
    """One row of `STATISTICS` for each text of an Arrow column."""
    data, at = byte_view(column)
    n = len(at) - 1
    out = np.zeros((n, len(STATISTICS)))
    whole = data.tobytes()
    for i in range(n):
        lo, hi = at[i], at[i + 1]
        size = max(int(hi - lo), 1)
        bytes_, text = data[lo:hi], whole[lo:hi]
        shares = np.bincount(_CLASS[bytes_], minlength=8) / size
        count = np.bincount(bytes_, minlength=256)
        share = count[count > 0] / size
        words = text.split()
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        numbers: dict[bytes, int] = {}
        coded = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        lines = [x for x in text.split(b"\n") if x.strip()]
        m, row = len(words), out[i]
        row[0] = np.log1p(hi - lo)
        row[1] = np.log1p(m)
        row[2:10] = shares[[1, 2, 3, 4, 5, 6, 0, 7]]
        row[10] = np.log1p(len(lines))
        row[19] = -(share * np.log2(share)).sum()
        row[21] = text.rstrip()[-1:] in (b".", b"!", b"?")
        if m:
            row[11:14] = lengths.mean(), lengths.std(), np.log1p(lengths.max())
            row[14] = len(numbers) / m
            row[15] = (coded[1:] == coded[:-1]).mean() if m > 1 else 0.0
            row[16] = np.bincount(coded).max() / m
            row[20] = (shares[1] + shares[2] + shares[7]) * size / max(lengths.sum(), 1)
        if lines:
            row[17] = 1 - len(set(lines)) / len(lines)
        if m > 2:
            triple = (coded[:-2] * len(numbers) + coded[1:-1]) * len(numbers) + coded[2:]
            row[18] = 1 - len(np.unique(triple)) / len(triple)
    return out


def statistics_table(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """`keep` columns of `docs` and an array of statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                rows = statistics(part.column(text))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1])
                yield pa.record_batch(
                    [*(part.column(c) for c in keep), flat.cast(pa.list_(pa.float64()))],
                    [*keep, "statistics"],
                )

    schema = extended(docs.select(*keep), "statistics array<double>")
    return docs.select(*keep, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


@dataclass(frozen=True)
class Trees:
    """Complete binary trees as arrays: inner nodes `feature` and `limit`, then `leaf` values."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    start: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1; the loop is over trees and levels, not rows."""
        total = np.full(len(rows), self.start)
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        every = np.arange(len(rows))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (rows[every, feature[node]] > limit[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def grow(
    rows: np.ndarray,
    label: np.ndarray,
    trees: int = 80,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    smooth: float = 1.0,
    least: float = 0.25,
) -> Trees:
    """Newton boosting of the logistic loss with histogram splits."""
    n, p = rows.shape if rows.ndim == 2 else (0, len(STATISTICS))
    share = float(label.mean()) if n else 0.5
    inner, leaves = 2**depth - 1, 2**depth
    if n == 0 or share in (0.0, 1.0):
        start = float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6))))
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), start)
    edges = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(p)]
    binned = np.stack([np.searchsorted(edges[j], rows[:, j], "left") for j in range(p)], 1)
    start = float(np.log(share / (1 - share)))
    total = np.full(n, start)
    feature = np.zeros((trees, inner), np.int64)
    limit = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    for t in range(trees):
        chance = 1 / (1 + np.exp(-total))
        slope, bend = chance - label, np.maximum(chance * (1 - chance), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.full(width, 1e-6)
            for j in range(p):
                if not len(edges[j]):
                    continue
                k = len(edges[j]) + 1
                cell = at * k + binned[:, j]
                g = np.bincount(cell, slope, width * k).reshape(width, k)
                h = np.bincount(cell, bend, width * k).reshape(width, k)
                gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
                ga, ha = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                gr, hr = ga - gl, ha - hl
                gain = gl**2 / (hl + smooth) + gr**2 / (hr + smooth) - ga**2 / (ha + smooth)
                gain[(hl < least) | (hr < least)] = -1
                cut = gain.argmax(1)
                top = gain[np.arange(width), cut]
                for w in np.flatnonzero(top > best):
                    best[w] = top[w]
                    feature[t, first + w], limit[t, first + w] = j, edges[j][cut[w]]
            node = 2 * node + 1 + (rows[np.arange(n), feature[t, node]] > limit[t, node])
        at = node - inner
        g, h = np.bincount(at, slope, leaves), np.bincount(at, bend, leaves)
        leaf[t] = -rate * g / (h + smooth)
        total += leaf[t, at]
    return Trees(feature, limit, leaf, start)


def labelled_sample(labels: DataFrame, column: str, usable: Column, most: int = MAX_LABELLED) -> DataFrame:
    """At most about `most` of the usable labelled ids, one label an id, picked by a hash of the id."""
    rows = (
        labels.where(usable & F.col(column).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(column).cast("int").alias("label"))
    )
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int((1 << 20) * most / n))


def fit_quality(
    docs: DataFrame, labels: DataFrame, usable: Column, text: str = "text", most: int = MAX_LABELLED
) -> Trees:
    """Trees from documents with a usable label; the sample's ids and labels are broadcast."""
    sample = labelled_sample(labels, "quality", usable, most)
    rows = docs.select("doc_id", text).join(F.broadcast(sample), "doc_id")
    found = statistics_table(rows, text, ["doc_id", "label"]).toPandas()
    found = found.sort_values(["doc_id", "label"], kind="stable")
    x = np.array(found["statistics"].tolist(), float).reshape(-1, len(STATISTICS))
    return grow(x, found["label"].to_numpy(float))


def score_quality(docs: DataFrame, trees: Trees, text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """`docs` with `score` and `predicted`; columns of these names are replaced."""
    docs = docs.drop("score", "predicted")
    fields = docs.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                score = trees.score(statistics(part.column(text)))
                yield pa.record_batch(
                    [*part.columns, pa.array(score), pa.array((score >= accept).astype(np.int32))],
                    [*fields, "score", "predicted"],
                )

    schema = extended(docs, "score double, predicted int")
    return docs.mapInArrow(run, schema)
