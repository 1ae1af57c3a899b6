"""Many sparse logistic regressions over the same rows, solved side by side.

All splits and penalties of a search are models over one table: a row carries
its weight and the splits that hold it out. The coefficients are one matrix, a
row a model, and every pass over the data gives each unfinished model the loss
and gradient at its own trial point. Between passes a quasi-Newton step with
orthant projection (for the L1 part) is taken for all models at once. A search
therefore costs as many passes as its slowest model needs, not one fit a model.

Rows stay distributed: a task adds up its rows' losses and gradients, and what
comes back is a matrix or a few a pass. Models are taken in blocks, so that a block's
matrices stay within SOLVE_CELLS numbers, whatever the number of features.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Coefficients (models x features) of a block of models; the solver keeps some 25 such matrices.
SOLVE_CELLS = 1_000_000
#: Numbers of the intermediate matrices of a task (rows x models or features, or entries).
STEP_CELLS = 2_000_000
#: Up to so many features a task works on dense rows.
DENSE = 1024
#: Partial sums that come to the driver at once; more are added up in a task first.
GATHER_PARTS = 4
#: Lengths of a step that a pass tries, once few models are unfinished.
TRIALS = 6
#: Former steps that the curvature estimate rests on.
MEMORY = 10


@dataclass
class Models:
    """What tells the models of a search apart: arrays with an entry (or row) a model."""

    split: np.ndarray  # the split whose held-out rows are left out; -1: none
    l1: np.ndarray  # models x features: penalty on |w|
    l2: np.ndarray  # models x features: penalty on w^2 / 2

    def part(self, which: np.ndarray | slice) -> Models:
        return Models(self.split[which], self.l1[which], self.l2[which])


def design(cells: DataFrame, rows: DataFrame, vocab: DataFrame, held: DataFrame | None, by: str = "groups") -> DataFrame:
    """`label, weight, held, idx, val`: one row an example, features in ascending order.

    `cells` holds `accession, motif, cnt`, `rows` `accession, label, weight` and
    `by`, `vocab` `feature, idx`, and `held` `by, split` for the rows to be held out.
    """
    from strandwise.plans.lineage import broadcast_if_small

    numbered = cells.join(broadcast_if_small(vocab.withColumnRenamed("feature", "motif")), "motif")
    pair = F.struct(F.col("idx").cast("int").alias("idx"), F.col("cnt").cast("double").alias("val"))
    packed = numbered.groupBy("accession").agg(F.sort_array(F.collect_list(pair)).alias("x"))
    out = rows.join(packed, "accession", "left")
    if held is None:
        out = out.withColumn("held", F.array().cast("array<int>"))
    else:
        lists = held.groupBy(by).agg(F.collect_list(F.col("split").cast("int")).alias("held"))
        out = out.join(broadcast_if_small(lists), by, "left")
    none = F.array()
    return out.select(
        F.col("label").cast("double").alias("label"),
        F.col("weight").cast("double").alias("weight"),
        F.coalesce("held", none.cast("array<int>")).alias("held"),
        F.coalesce("x.idx", none.cast("array<int>")).alias("idx"),
        F.coalesce("x.val", none.cast("array<double>")).alias("val"),
    )


def _lists(column: pa.Array, kind: str = "<i4") -> tuple[np.ndarray, np.ndarray]:
    """Start of each row's numbers (and the end of the last), and all numbers.

    The column holds arrays, or binaries of little-endian 32-bit numbers, which
    Spark hands over without a look at each one.
    """
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        numbers = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        return (at - at[0]) // 4, numbers.view(kind)
    at = column.offsets.to_numpy()
    return at - at[0], column.flatten().to_numpy()


class _Rows:
    """Some rows of the design, ready for products with coefficient matrices."""

    def __init__(self, batch: pa.RecordBatch, width: int, splits: np.ndarray):
        self.label, self.weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        held_starts, own = _lists(batch.column(2))
        n = batch.num_rows
        # A column a split, and one for models that hold out nothing.
        self.out = np.zeros((n, len(splits) + 1), bool)
        row = np.repeat(np.arange(n), np.diff(held_starts))
        known = np.isin(own, splits)  # splits of other blocks don't count
        self.out[row[known], np.searchsorted(splits, own[known])] = True
        starts, self.idx = _lists(batch.column(3))
        self.val = _lists(batch.column(4), "<f4")[1].astype(np.float64)
        self.row = np.repeat(np.arange(n), np.diff(starts))
        self.dense = None
        if width <= DENSE:
            self.dense = np.zeros((n, width))
            np.add.at(self.dense, (self.row, self.idx), self.val)

    def margins(self, w: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense @ w.T
        n = len(self.label)
        return np.column_stack([np.bincount(self.row, self.val * own[self.idx], n) for own in w])

    def gradient(self, rest: np.ndarray, width: int) -> np.ndarray:
        """Models x features: the rows weighted by `rest` (rows x models)."""
        if self.dense is not None:
            return rest.T @ self.dense
        return np.stack([np.bincount(self.idx, self.val * own[self.row], width) for own in rest.T])


def _chunks(batches: Iterator[pa.RecordBatch], width: int, models: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that no intermediate matrix is above STEP_CELLS (or one row's)."""
    for batch in batches:
        begin, offsets = 0, _lists(batch.column(3))[0]
        while begin < batch.num_rows:
            end = begin + max(1, STEP_CELLS // max(models, width if width <= DENSE else 1))
            if width > DENSE:
                end = min(end, int(np.searchsorted(offsets, offsets[begin] + STEP_CELLS, "right")) - 1)
            end = min(max(end, begin + 1), batch.num_rows)
            # Taken, not sliced: list offsets then start at the chunk.
            yield batch.take(pa.array(np.arange(begin, end)))
            begin = end


def _losses(rows: _Rows, w: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Per model: gradient, loss and weight over its training rows."""
    z = rows.margins(w)
    weight = rows.weight[:, None] * ~rows.out[:, column]
    loss = weight * (np.logaddexp(0, z) - rows.label[:, None] * z)
    rest = weight * (1 / (1 + np.exp(-np.clip(z, -700, 700))) - rows.label[:, None])
    return np.column_stack([rows.gradient(rest, w.shape[1]), loss.sum(0), weight.sum(0)])


def _tests(rows: _Rows, w: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Per model: squared error, right answers and weight over its held-out rows."""
    z = rows.margins(w)
    weight = rows.weight[:, None] * rows.out[:, column]
    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    right = (p > 0.5) == (rows.label[:, None] > 0.5)
    error = (p - rows.label[:, None]) ** 2
    return np.column_stack([(weight * error).sum(0), (weight * right).sum(0), weight.sum(0)])


def _squares(rows: _Rows, w: np.ndarray, column: np.ndarray) -> np.ndarray:
    """For all models: the weighted squares of each feature, and the weight."""
    out = np.bincount(rows.idx, rows.weight[rows.row] * rows.val**2, w.shape[1])
    return np.r_[out, rows.weight.sum()][None, :]


def _sums(
    data: DataFrame, w: np.ndarray, split: np.ndarray, per_rows, cells: int, narrow: bool = False
) -> np.ndarray:
    """The sum of `per_rows` over all rows: one pass over the data.

    `narrow` sends all but the last two columns in single precision.
    """
    splits = np.unique(split[split >= 0])
    column = np.where(split >= 0, np.searchsorted(splits, split), len(splits))
    sent = data.sparkSession.sparkContext.broadcast((w, splits, column))
    shape, wide = (len(w), cells), 2 if narrow else cells

    def packed(total: np.ndarray) -> bytes:
        return total[:, : cells - wide].astype("<f4").tobytes() + total[:, cells - wide :].astype("<f8").tobytes()

    def unpacked(part: bytes) -> np.ndarray:
        cut = 4 * shape[0] * (cells - wide)
        left = np.frombuffer(part, "<f4", offset=0, count=cut // 4).reshape(shape[0], -1) if cut else np.zeros((shape[0], 0))
        return np.column_stack([left, np.frombuffer(part, "<f8", offset=cut).reshape(shape[0], -1)])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, splits, column = sent.value
        total = np.zeros(shape)
        for part in _chunks(batches, w.shape[1], len(w)):
            total += per_rows(_Rows(part, w.shape[1], splits), w, column)
        yield pa.RecordBatch.from_arrays([pa.array([packed(total)], pa.binary())], names=["part"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in batch.column(0):
                own = unpacked(part.as_buffer())
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([packed(total)], pa.binary())], names=["part"])

    parts = data.mapInArrow(partial, "part BINARY")
    if data.rdd.getNumPartitions() > GATHER_PARTS:
        # Added up by a task, so one matrix a pass reaches the driver.
        parts = parts.repartition(1).mapInArrow(added, "part BINARY")
    total = sum((unpacked(r["part"]) for r in parts.collect()), np.zeros(shape))
    sent.destroy()
    return total


class _Steps:
    """Quasi-Newton steps with orthant projection for a block of models."""

    def __init__(self, models: Models, metric: np.ndarray):
        m, width = models.l1.shape
        self.metric = metric  # of each feature: one over its greatest possible curvature
        self.models, self.w = models, np.zeros((m, width))
        self.f, self.g = np.full(m, np.inf), np.zeros((m, width))
        self.s, self.y = np.zeros((MEMORY, m, width)), np.zeros((MEMORY, m, width))
        self.direction = np.zeros((m, width))
        self.pseudo, self.orthant = np.zeros((m, width)), np.zeros((m, width))
        self.t, self.steps, self.still = np.ones(m), np.zeros(m, int), np.zeros(m, int)
        self.open = np.ones(m, bool)

    def _pseudo(self, at: np.ndarray) -> None:
        """The steepest one-sided slope, and the orthant that a step stays in."""
        w, g, l1 = self.w[at], self.g[at], self.models.l1[at]
        up, down = g + l1, g - l1
        slope = np.where(w > 0, up, np.where(w < 0, down, np.where(up < 0, up, np.where(down > 0, down, 0))))
        self.pseudo[at] = slope
        self.orthant[at] = np.where(w != 0, np.sign(w), -np.sign(slope))

    def _aim(self, at: np.ndarray) -> None:
        """New directions from the curvature so far."""
        # The curvature among the coordinates that may move; the others stay at 0.
        moving = (self.w[at] != 0) | (self.pseudo[at] != 0)
        s, y = (self.s, self.y) if len(at) == len(self.open) else (self.s[:, at], self.y[:, at])
        if not moving.all():
            s, y = s * moving, y * moving
        curve, turn = np.einsum("kmd,kmd->km", s, y), np.einsum("kmd,d,kmd->km", y, self.metric, y)
        known = curve > 1e-12 * np.sqrt(turn * np.einsum("kmd,d,kmd->km", s, 1 / self.metric, s))
        rho = np.where(known, 1 / np.where(known, curve, 1), 0)
        newest = known.argmax(0), np.arange(len(at))
        scale = np.where(known.any(0), curve[newest] / np.where(known[newest], turn[newest], 1), 1)
        q, alpha = self.pseudo[at].copy(), np.zeros((MEMORY, len(at)))
        for k in range(MEMORY):
            alpha[k] = rho[k] * np.einsum("md,md->m", s[k], q)
            q -= alpha[k][:, None] * y[k]
        q *= scale[:, None] * self.metric
        for k in reversed(range(MEMORY)):
            beta = rho[k] * np.einsum("md,md->m", y[k], q)
            q += s[k] * (alpha[k] - beta)[:, None]
        # A coordinate leaves 0 down the slope only; the others may go along with the curvature,
        # as long as the whole goes down.
        slope = self.pseudo[at]
        against = q * slope <= 0
        free = np.where(against & (self.w[at] == 0) & (self.models.l1[at] > 0), 0, -q)
        down = np.einsum("md,md->m", free, slope) < 0
        self.direction[at] = np.where(down[:, None], free, np.where(against, 0, -q))
        self.t[at] = 1.0

    def trials(self, at: np.ndarray, count: int) -> np.ndarray:
        """`count` trial points of each model: its step, half of it, a quarter and so on."""
        t = self.t[at] * 0.5 ** np.arange(count)[:, None]
        moved = self.w[at] + t[:, :, None] * self.direction[at]
        crossed = (self.models.l1[at] > 0) & (np.sign(moved) != self.orthant[at])
        return np.where(crossed, 0, moved)

    def take(self, at: np.ndarray, trials: np.ndarray, sums: np.ndarray, tol: float, max_iter: int) -> None:
        """Use the sums at the trial points (trial x model x feature) of the models `at`."""
        weight = np.maximum(sums[..., -1], 1e-12)
        own = self.models.part(at)
        f = sums[..., -2] / weight + (own.l1 * np.abs(trials) + own.l2 / 2 * trials * trials).sum(2)
        begun = np.isfinite(self.f[at])
        fall = np.einsum("md,kmd->km", self.pseudo[at], trials - self.w[at])
        fits = ~begun | (f <= self.f[at] + 1e-4 * fall)
        # The longest step that falls enough, if any does.
        first, good = fits.argmax(0), fits.any(0)
        pick = first, np.arange(len(at))
        trial, f = trials[pick], f[pick]
        g = sums[pick][:, :-2] / weight[pick][:, None] + own.l2 * trial
        taken = at[good]
        if len(taken):
            step, turn = (trial - self.w[at])[good], (g - self.g[at])[good]
            bent = begun[good] & (np.einsum("md,md->m", step, turn) > 0)
            kept = taken[bent]
            for old, new in ((self.s, step), (self.y, turn)):
                old[1:, kept] = old[:-1, kept]
                old[0, kept] = new[bent]
            with np.errstate(invalid="ignore"):
                slow = self.f[taken] - f[good] <= tol * np.maximum(np.abs(f[good]), 1e-12)
            self.still[taken] = np.where(begun[good] & slow, self.still[taken] + 1, 0)
            self.steps[taken] += begun[good]
            self.w[taken], self.f[taken], self.g[taken] = trial[good], f[good], g[good]
            self._pseudo(taken)
            self._aim(taken)
        self.t[at[~good]] *= 0.5 ** len(trials)
        flat = np.abs(self.pseudo[at]).max(1, initial=0) <= 1e-3 * tol
        # Three falls under the tolerance in a row, a flat slope, or a step too short to be one.
        self.open[at] = ~(flat | (self.still[at] >= 3) | (self.steps[at] >= max_iter) | (self.t[at] < 1e-12))


def solve(
    data: DataFrame, models: Models, max_iter: int = 500, tol: float = 1e-8, narrow: bool = False
) -> np.ndarray:
    """Coefficients, models x features, of

        mean training loss + l1 * |w| + l2 / 2 * w^2

    for every model. `data` is a `design`, read once a pass, so it should be
    persisted; its `idx` and `val` may be binaries of little-endian int32 and float32. With `narrow` slopes travel
    in single precision, which suffices for tolerances of 1e-6 and more.
    """
    m, width = models.l1.shape
    found = np.zeros((m, width))
    if not width:
        return found
    squares = _sums(data, np.zeros((1, width)), np.array([-1]), _squares, width + 1)[0]
    metric = 4 * max(squares[-1], 1e-12) / np.maximum(squares[:-1], 1e-12)
    size = max(1, SOLVE_CELLS // width)
    for first in range(0, m, size):
        block = slice(first, min(first + size, m))
        steps = _Steps(models.part(block), metric)
        while steps.open.any():
            at = np.flatnonzero(steps.open)
            # Few models left are cheap: several lengths of each step go into one pass.
            count = 1 if len(at) * TRIALS > len(steps.open) else TRIALS
            trials = steps.trials(at, count)
            sums = _sums(data, trials.reshape(-1, width), np.tile(steps.models.split[at], count), _losses, width + 2, narrow)
            steps.take(at, trials, sums.reshape(count, len(at), -1), tol, max_iter)
        found[block] = steps.w
    return found


def held_out_scores(data: DataFrame, w: np.ndarray, split: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Negative Brier score and accuracy of each model on the rows its split holds out; nan without rows."""
    split = np.asarray(split)
    sums = _sums(data, w, split, _tests, 3)
    with np.errstate(invalid="ignore", divide="ignore"):
        return -sums[:, 0] / sums[:, 2], sums[:, 1] / sums[:, 2]
