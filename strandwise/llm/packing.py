"""Packing into sequences of fixed length by cutting-stock column generation.

A document's ids are cut into full pieces and a remainder. Remainders are
items of the cutting-stock problem; only the histogram of their lengths (at
most `size` numbers, whatever the input) reaches the driver. There a linear
program over patterns is solved by column generation: it starts from patterns
that take the longest lengths first, the dual prices of the lengths go into a
knapsack by dynamic programming, whose best fill becomes the next pattern, until
no pattern prices out or the gap to the bound is closed; nothing else ends it.
Patterns are rounded down to whole numbers, what that leaves is patterned as the
start was, and only nearly full patterns are used.

Remainders are ranked within their length by (task, place in the task), which
needs one small count table and no sort. A rank picks its pattern, instance
and slot by binary search in the rounded patterns. Remainders that no pattern
takes form one stream that is cut at every `size` ids; its last stretch is cut
into powers of two, which need no padding.

Defined results: a null or empty text is its end id alone. Repeated rows are
packed each. Columns other than doc_id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import cut_lineage, extended, pieces
from strandwise.llm.tokens import encoder

SIZE = 1024
END = 0
#: Share of a sequence that a pattern must fill to be used.
FILL = 0.99
#: Column generation ends when the number of sequences is within this share of its lower bound.
GAP = 1e-7
#: Rows of three numbers that are broadcast at most, 24 MB; beyond that the join shuffles.
BROADCAST_COUNTS = 1_000_000


def cut_documents(docs: DataFrame, path: str, text: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    """One row a piece: full pieces, then the remainder with its ids.

    `part`, `rank`: the writing task and the place among its pieces of this length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        task = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            for part in pieces(batch, text):
                row, start, length, crc, total, rank, kept = [], [], [], [], [], [], []
                for i, t in enumerate(part.column(text).to_pylist()):
                    ids = encode(t or "") + tail
                    n = len(ids) // 4
                    for at in range(0, n, size):
                        piece = ids[4 * at : 4 * (at + size)]
                        k = len(piece) // 4
                        row.append(i)
                        start.append(at)
                        length.append(k)
                        crc.append(crc32(piece))
                        total.append(n)
                        rank.append(int(seen[k]))
                        seen[k] += 1
                        kept.append(piece if k < size else None)
                yield pa.record_batch(
                    [
                        part.column("doc_id").take(pa.array(row, pa.int64())),
                        *(pa.array(x, pa.int64()) for x in (start, length, crc, total, rank)),
                        pa.array(np.full(len(row), task, np.int32)),
                        pa.array(kept, pa.binary()),
                    ],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "part", "ids"],
                )

    numbers = "start long, length long, ids_crc32 long, doc_tokens long, rank long"
    schema = extended(docs.select("doc_id"), f"{numbers}, part int, ids binary")
    return docs.select("doc_id", F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


def best_fill(price: np.ndarray, lengths: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the dearest multiset of lengths that fits, as counts."""
    value = np.zeros(size + 1)
    taken = np.full(size + 1, -1)
    for room in range(1, size + 1):
        fits = int(np.searchsorted(lengths, room, "right"))
        value[room] = value[room - 1]
        if fits:
            options = price[:fits] + value[room - lengths[:fits]]
            best = int(options.argmax())
            if options[best] > value[room] + 1e-12:
                value[room], taken[room] = options[best], best
    count, room = np.zeros(len(lengths), np.int64), size
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            count[taken[room]] += 1
            room -= int(lengths[taken[room]])
    return float(value[size]), count


def next_pattern(left: np.ndarray, size: int, whole: bool) -> np.ndarray:
    """Counts of a pattern for `left[L]` pieces of each length L: the longest first, the end filled exactly if one or two can.

    `whole`: use no more pieces than are left. Otherwise a length that is left may come any number of times.
    """
    count = np.zeros(len(left), np.int64)
    room, spare = size, left.astype(float)
    while room > 0:
        have = spare[: room + 1] >= 1 if whole else spare[: room + 1] > 0
        if not have.any():
            break
        if count.any():
            short = np.arange(1, room // 2 + 1)
            both = np.minimum(spare[short], spare[room - short]) * (have[short] & have[room - short])
            if whole and room % 2 == 0 and spare[room // 2] < 2:
                both[-1] = 0
            if have[room]:
                taken = [room]
            elif both.any():
                k = int(short[both.argmax()])
                taken = [k, room - k]
            else:
                taken = [int(np.flatnonzero(have)[-1])]
        else:
            taken = [int(np.flatnonzero(have)[-1])]
        for n in taken:
            count[n] += 1
            room -= n
            spare[n] -= whole
    return count


def first_basis(lengths: np.ndarray, demand: np.ndarray, size: int) -> np.ndarray:
    """Columns to start from. Each pattern uses up a length that no later one holds, so the columns are independent."""
    m = len(lengths)
    left = np.zeros(size + 1)
    left[lengths] = demand
    basis = np.zeros((m, m))
    for _ in range(m):
        if not left.any():
            break
        count = next_pattern(left, size, False)
        own = np.flatnonzero(count)
        times = left[own] / count[own]
        gone = own[int(times.argmin())]
        left[own] -= times.min() * count[own]
        left[gone] = 0
        left[left < 1e-9] = 0
        basis[:, np.searchsorted(lengths, gone)] = count[lengths]
    for i in np.flatnonzero(~basis.any(axis=0)):  # used up together with another length
        basis[i, i] = size // lengths[i]
    return basis


def generate_patterns(
    lengths: np.ndarray, demand: np.ndarray, size: int = SIZE, gap: float = GAP
) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (rows of counts), their fractional numbers and a lower bound of their sum, by revised simplex.

    Columns are priced at a mean of the present and the best prices so far, which swings less, and at the
    present ones where that finds none. Ends when the sum is within `gap` of the bound or no column prices out.
    """
    m = len(lengths)
    demand = demand + np.linspace(1e-7, 2e-7, m)  # no two amounts alike, so that no basis comes again
    basis = first_basis(lengths, demand, size)
    inverse = np.linalg.inv(basis)
    amount = np.maximum(inverse @ demand, 0)
    # Prices by length are dual feasible; any others are once divided by the worth of their best fill.
    best = lengths / size
    bound = float(best @ demand)
    pivots = 0
    while True:
        price = inverse.sum(0)
        for guess in (0.7 * best + 0.3 * np.maximum(price, 0), np.maximum(price, 0)):
            worth, column = best_fill(guess, lengths, size)
            if guess @ demand > bound * worth:
                bound, best = float(guess @ demand) / worth, guess / worth
            if price @ column > 1 + 1e-7:
                break
        else:
            break
        if amount.sum() <= bound * (1 + gap):
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
        pivots += 1
        if pivots % 200:
            row = inverse[out] / step[out]
            step[out] = 0
            inverse -= np.outer(step, row)
            inverse[out] = row
        else:
            inverse = np.linalg.inv(basis)
        amount = np.maximum(inverse @ demand, 0)
    return basis.T.round().astype(np.int64).reshape(m, m), amount, bound


@dataclass(frozen=True)
class Plan:
    """Where the ranks of each length go; arrays of bounded size.

    For length L the rows of `where` from `at[L]` to `at[L + 1]` are (first rank, copies in a
    sequence, first sequence, offset in the sequence), the first ranks ascending. Ranks from
    `placed[L]` on are in the stream from `stream_at[L]`. Full pieces come first of all sequences.
    """

    size: int
    at: np.ndarray
    where: np.ndarray
    placed: np.ndarray
    stream_at: np.ndarray
    stream_sequence: int
    stream_length: int

    def sequence_of(self, position: int) -> tuple[int, int, int]:
        """Sequence, offset in it and its end in the stream, of a place in the stream."""
        whole = self.stream_length // self.size * self.size
        if position < whole:
            number, offset = divmod(position, self.size)
            return self.stream_sequence + number, offset, (number + 1) * self.size
        number, at, rest = self.stream_sequence + whole // self.size, whole, self.stream_length - whole
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                if position < at + (1 << bit):
                    return number, position - at, at + (1 << bit)
                number, at = number + 1, at + (1 << bit)
        raise ValueError(position)


def make_plan(counts: np.ndarray, size: int = SIZE, fill: float = FILL) -> Plan:
    """A plan for `counts[L]` pieces of each length L up to `size`."""
    left = counts.astype(np.int64).copy()
    left[size] = 0
    lengths = np.flatnonzero(left)
    rows: list[tuple[int, int, int, int, int]] = []
    sequence, placed = int(counts[size]), np.zeros(size + 1, np.int64)
    placed[size] = counts[size]
    if len(lengths):
        patterns, amount, _ = generate_patterns(lengths, left[lengths].astype(float), size)

        def use(counts: np.ndarray, times: int) -> None:
            nonlocal sequence
            offset = 0
            for n in np.flatnonzero(counts)[::-1].tolist():
                k = int(counts[n])
                rows.append((n, int(placed[n]), k, sequence, offset))
                placed[n] += k * times
                left[n] -= k * times
                offset += k * n
            sequence += times

        filled = patterns @ lengths
        for p in np.lexsort((np.arange(len(filled)), -filled)):  # the rounded patterns
            times = int(amount[p] + 1e-6)
            if times and fill * size <= filled[p] <= size:
                counts = np.zeros(size + 1, np.int64)
                counts[lengths] = patterns[p]
                own = counts > 0
                use(counts, min(times, int((left[own] // counts[own]).min())))
        open_ = left.copy()
        while open_.any():  # what the rounding has left: at most a sequence a pattern
            counts = next_pattern(open_, size, True)
            own = counts > 0
            if counts @ np.arange(size + 1) >= fill * size:
                times = int((open_[own] // counts[own]).min())
                use(counts, times)
                open_[own] -= counts[own] * times
            else:
                open_[np.flatnonzero(own)[-1]] = 0  # no good pattern begins with this length: it stays for the stream
    rows.sort()
    where = np.array(rows, np.int64).reshape(-1, 5)
    at = np.searchsorted(where[:, 0], np.arange(size + 2))
    amount_left = left * np.arange(size + 1)
    stream_at = np.cumsum(amount_left) - amount_left
    return Plan(size, at, where[:, 1:].copy(), placed, stream_at, sequence, int(amount_left.sum()))


OUT = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, text: str = "text", size: int = SIZE, end: int = END) -> DataFrame:
    """One row a piece: doc_id, its place in the document, and its sequence and offset there."""
    cut = cut_lineage(cut_documents(docs, path, text, size, end))
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    # Ranks of a task's pieces start after those of the tasks before it; a length has a row a task.
    before = cut_lineage(counts.select("part", "length", "n", _running("part", "length", "n").alias("first")))
    histogram = np.zeros(size + 1, np.int64)
    for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    plan = make_plan(histogram, size)
    starts = before.select("part", "length", "first")
    if before.count() <= BROADCAST_COUNTS:
        starts = F.broadcast(starts)
    ranked = cut.join(starts, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("first"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _place(batch, plan)

    return ranked.select(*columns).mapInArrow(run, extended(cut.select("doc_id"), OUT))


def _running(order: str, group: str, value: str):
    from pyspark.sql import Window

    return F.coalesce(F.sum(value).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _place(batch: pa.RecordBatch, plan: Plan) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    start, length, crc, total, rank = (batch.column(c).to_numpy() for c in names[1:5] + ["rank"])
    sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
    full = length == plan.size
    sequence[full] = rank[full]
    planned = ~full & (rank < plan.placed[length])
    for n in np.unique(length[planned]):
        own = np.flatnonzero(planned & (length == n))
        where = plan.where[plan.at[n] : plan.at[n + 1]]
        k = np.searchsorted(where[:, 0], rank[own], "right") - 1
        first, copies, base, shift = where[k].T
        instance, slot = np.divmod(rank[own] - first, copies)
        sequence[own], offset[own] = base + instance, shift + slot * n
    whole = full | planned
    if whole.any():
        keep = pa.array(whole)
        yield pa.record_batch(
            [
                *(batch.column(c).filter(keep) for c in names[:5]),
                pa.array(sequence[whole]),
                pa.array(offset[whole]),
            ],
            names,
        )
    rows = []
    for i in np.flatnonzero(~whole).tolist():
        ids = batch.column("ids")[i].as_py()
        n = int(length[i])
        position = int(plan.stream_at[n] + (rank[i] - plan.placed[n]) * n)
        done = 0
        while done < n:
            number, at, stop = plan.sequence_of(position + done)
            k = min(n - done, stop - position - done)
            piece = ids[4 * done : 4 * (done + k)]
            rows.append((i, int(start[i]) + done, k, crc32(piece), int(total[i]), number, at))
            done += k
    if rows:
        r = np.array(rows, np.int64).T
        yield pa.record_batch([batch.column("doc_id").take(pa.array(r[0])), *map(pa.array, r[1:])], names)
