"""Exact top-k by inner product: distances to pivots bound every score, best bounds first.

With x' = (x, sqrt(M^2 - |x|^2)), M the largest norm, and q' = (q, 0) the score
is q.x = (|q|^2 + M^2 - |q' - x'|^2) / 2. For every pivot p the triangle
inequality gives |q' - x'| >= | |q' - p'| - |x' - p'| |; the largest of these
lower bounds over many pivots is an upper bound of the score.

Candidates lie in blocks of a bounded number of rows, one block a task; all
queries stream past each block in batches. Rows of a block with the same
nearest pivot and a like distance to it form runs, and the range of a run's
distances to every pivot bounds all of its scores. Queries with the same nearest
pivot go together: they meet the runs in the order of the bound, a run is
evaluated exactly, by one product of matrices, for those queries whose bound
reaches the k-th best score found, and they end when no bound does. A query carries
the k-th best score over a bounded sample of candidates as its first limit. Each block
returns k rows a query, a window ranks those. The work is queries by candidates where
bounds exclude nothing, as in many dimensions; the product makes it cheap.

Defined results: vectors that are null or hold a null, NaN or infinite
component take no part, as queries or candidates; an empty vector scores 0. A
shorter vector counts as filled up with zeros. A query's own row is no
candidate, a repeated row of it is. Ties go to the smaller id, nulls last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandwise.llm.common import cut_lineage

PIVOTS = 32
#: Candidates of a block at most on average, and rows of the samples for pivots and first limits.
BLOCK = 65_536
SAMPLE = 2_048
#: Candidates that one bound covers, and queries that meet them at once.
RUN, GROUP = 1_024, 256
#: Whole numbers below it, and sums of them that stay below, are exact in single precision.
SINGLE = 1 << 24


def quantized(vectors: DataFrame, id_column: str, column: str, is_query: Column, scale: int = 256) -> DataFrame:
    """(row, id, query, v): floor(scale * x) of the vectors that take part; `row` numbers the scan's rows."""
    x = F.col("x")
    good = x.isNotNull() & ~F.exists(
        x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))
    )
    return (
        vectors.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_column).cast("long").alias("id"),
            F.coalesce(is_query, F.lit(False)).alias("query"),
            F.col(column).alias("x"),
        )
        .where(good)
        .select("row", "id", "query", F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"))
    )


def _matrix(column: pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    """Integer rows as floats, filled up with zeros; whole numbers stay exact."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), kind)
    if (size == width).all():
        return flat.reshape(-1, width)
    row = np.repeat(np.arange(len(column)), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[row, place] = flat
    return out


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Points of the sample far from each other: each next one is farthest from those before it."""
    if not len(sample):
        return sample
    chosen = [0]
    nearest = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


class Space:
    """The lifted space: pivots with their last coordinate, and the largest squared norm."""

    def __init__(self, pivots: np.ndarray, most: float):
        self.pivots, self.most = pivots, most
        self.norms = (pivots**2).sum(1)
        self.last = np.sqrt(np.maximum(most - self.norms, 0))

    def of_candidates(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        norms = (x**2).sum(1)
        last = np.sqrt(np.maximum(self.most - norms, 0))
        flat = norms[:, None] + self.norms - 2 * (x @ self.pivots.T)
        return np.sqrt(np.maximum(flat + (last[:, None] - self.last) ** 2, 0))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        q = q.astype(float)
        flat = (q**2).sum(1)[:, None] + self.most - 2 * (q @ self.pivots.T)
        return np.sqrt(np.maximum(flat, 0))


class Block:
    """Candidates in runs of near rows, with the range of each run's distances to every pivot."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, x: np.ndarray, space: Space):
        table = space.of_candidates(x)
        nearest = table.argmin(1)
        order = np.lexsort((table[np.arange(len(x)), nearest], nearest))
        self.row, self.id, self.x = row[order], ids[order], x[order]
        table, nearest = table[order], nearest[order]
        place = np.arange(len(x)) - np.searchsorted(nearest, nearest)
        first = np.flatnonzero(place % RUN == 0)
        self.cuts = np.append(first, len(x))
        self.low, self.high = np.minimum.reduceat(table, first), np.maximum.reduceat(table, first)

    def bounds(self, q: np.ndarray, to_pivots: np.ndarray, most: float) -> np.ndarray:
        """No score of a query (row) with a candidate of a run (column) is above its number."""
        away = np.zeros((len(q), len(self.low)))
        for t, low, high in zip(to_pivots.T, self.low.T, self.high.T, strict=True):
            np.maximum(away, np.maximum(low - t[:, None], t[:, None] - high), out=away)
        norms = (q.astype(float) ** 2).sum(1)[:, None]
        # The last term covers the rounding of the distances.
        return (norms + most - away**2) / 2 + (1e-9 * (abs(most) + norms) + 1e-6)


def search(
    row: np.ndarray, q: np.ndarray, to_pivots: np.ndarray, floor: np.ndarray, block: Block, most: float, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`query, candidate, score`: places of the k best of a block for each query, by falling score, then id."""
    upper, floor = block.bounds(q, to_pivots, most), floor.copy()
    last = np.full(len(q), np.iinfo(np.int64).max)  # the id of the k-th best
    best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    found, waiting = [best], 0

    def kept() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, score = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((block.id[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        full = rank == k - 1
        floor[i[full]], last[i[full]] = score[full], block.id[j[full]]
        return i[rank < k], j[rank < k], score[rank < k]

    top = upper.max(0)
    for r in np.argsort(-top, kind="stable"):
        if top[r] < floor.min():
            break
        open_ = np.flatnonzero(upper[:, r] >= floor)
        first, end = block.cuts[r], block.cuts[r + 1]
        scores = q[open_] @ block.x[first:end].T
        i, j = np.nonzero(scores >= floor[open_, None])
        score = scores[i, j].astype(float)
        i, j = open_[i], j + first
        wanted = (block.row[j] != row[i]) & ((score > floor[i]) | (block.id[j] <= last[i]))
        found.append((i[wanted], j[wanted], score[wanted]))
        waiting += len(found[-1][0])
        if waiting > GROUP * k:
            found, waiting = [kept()], 0
    return kept()


def top_k(vectors: DataFrame, id_column: str, column: str, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, id, score): for each query row its k best other rows."""
    rows = cut_lineage(quantized(vectors, id_column, column, is_query, scale))
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(square).alias("most")).first()
    width, most = facts["width"] or 0, facts["most"] or 0.0
    picked = rows.orderBy(F.xxhash64("row", F.lit(3)), "row").limit(SAMPLE).select("row", "v").collect()
    sample_rows = np.array([r["row"] for r in picked], np.int64)
    sample = np.zeros((len(picked), width))
    for i, r in enumerate(picked):
        sample[i, : len(r["v"])] = r["v"]
    space = Space(choose_pivots(sample), most)
    blocks = max(-(-facts["n"] // BLOCK), rows.sparkSession.sparkContext.defaultParallelism)
    # Sums of products of two rows' components are at most `most`.
    kind = np.float32 if most < SINGLE else np.float64
    # Beyond doubles' whole numbers, products of other shapes may be rounded otherwise.
    slack = 0.0 if most < 1 << 53 else 1e-9 * most

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k-th best score of each query over the sample."""
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            q = _matrix(batch.column("v"), width)
            score = q @ sample.T
            score[batch.column("row").to_numpy()[:, None] == sample_rows] = -np.inf
            floor = np.partition(score, -k, 1)[:, -k] if len(sample) >= k else np.full(len(q), -np.inf)
            yield pa.record_batch([*batch.columns, pa.array(floor - slack)], [*batch.schema.names, "floor"])

    queries = rows.where("query").select("row", "id", "v").mapInArrow(limits, "row long, id long, v array<long>, floor double")
    block = F.pmod(F.xxhash64("row", F.lit(5)), F.lit(blocks)).cast("int")
    candidates = rows.select(block.alias("block"), F.lit(0).alias("kind"), "row", "id", "v", F.lit(0.0).alias("floor"))
    every = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "row", "id", "v", "floor")
    # By number: dealt by hash, several blocks would meet in one task.
    met = candidates.union(every).repartitionById(blocks, "block").sortWithinPartitions("block", "kind", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for batch in batches:
            which, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(which) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(which)], strict=True):
                part = batch.slice(a, b - a)
                if which[a] != now:
                    now, held, ready = which[a], [], None
                row, x = part.column("row").to_numpy(), _matrix(part.column("v"), width, kind)
                ids = part.column("id").fill_null(np.iinfo(np.int64).max).to_numpy()
                if kinds[a] == 0:
                    held.append((row, ids, x))
                    continue
                if ready is None:
                    if not held:
                        continue
                    ready, held = Block(*(np.concatenate(c) for c in zip(*held, strict=True)), space), []
                yield from _answers(part, row, x, ready, most, k, space)

    out = met.mapInArrow(run, "query_row long, query_id long, id long, score long")
    window = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _answers(part: pa.RecordBatch, row, q, block: Block, most: float, k: int, space: Space) -> Iterator[pa.RecordBatch]:
    to_pivots, floors = space.of_queries(q), part.column("floor").to_numpy()
    near = np.argsort(to_pivots.argmin(1), kind="stable")
    for at in range(0, len(near), GROUP):
        own = near[at : at + GROUP]
        i, j, score = search(row[own], q[own], to_pivots[own], floors[own], block, most, k)
        if not len(i):
            continue
        take, ids = pa.array(own[i]), block.id[j]
        yield pa.record_batch(
            [
                pa.array(row).take(take),
                part.column("id").take(take),
                pa.array(ids, mask=ids == np.iinfo(np.int64).max),
                pa.array(score.astype(np.int64)),
            ],
            ["query_row", "query_id", "id", "score"],
        )
