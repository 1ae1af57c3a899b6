"""Windows of sequences as integer codes, cut and counted in tasks.

A window of up to `MAX_K` letters ACGT is a number with two bits a letter, in
text order; numpy makes all codes of a batch of records at once. Windows with
other letters are kept as text. Spark deals and sorts the records and adds up
what the tasks found.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwise.functions.nucleotide import COMPLEMENT_FROM, COMPLEMENT_TO, reverse_complement

#: Longest window that fits a BIGINT.
MAX_K = 31
#: Letters that one vectorised step handles; longer records go in pieces.
STEP_LETTERS = 4 << 20
#: Letters of whole records that are counted at once, and rows that a task hands on at once: what a record
#: holds is a row a window, so a task's memory is that of its batches and not that of its records.
COUNT_LETTERS, COUNT_ROWS = 1 << 20, 1 << 16
#: Counts of all codes are kept as one array up to so many of them.
DENSE_CODES = 1 << 22

_DIGIT = np.full(256, 4, np.uint8)
_DIGIT[np.frombuffer(b"ACGT", np.uint8)] = range(4)
_COMPLEMENT = bytes.maketrans(COMPLEMENT_FROM.encode(), COMPLEMENT_TO.encode())
_PAIRED = np.frombuffer(_COMPLEMENT, np.uint8)
#: The letters of each code of four.
_FOUR = np.frombuffer(b"ACGT", np.uint8)[np.arange(256)[:, None] >> np.array([6, 4, 2, 0]) & 3]


def code_text(code: Column | str, k: int) -> Column:
    """The letters of a window's code."""
    return F.translate(F.lpad(F.conv(code, 10, 4), k, "0"), "0123", "ACGT")


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All text bytes of an Arrow column (null: none), and the n + 1 offsets of its rows."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def window_codes(digits: np.ndarray, k: int, reverse: bool = False) -> np.ndarray:
    """Code of the window at each place; `reverse`: of its reverse complement."""
    n, kind = len(digits) - k + 1, np.int32 if k < 16 else np.int64
    if n <= 0:
        return np.zeros(0, kind)
    part, width = (3 - digits if reverse else digits).astype(kind), 1
    out, done = np.zeros(n, kind), 0
    while True:
        if k >> (width.bit_length() - 1) & 1:
            # `out` holds the first `done` letters of a window, `part` the next ones.
            own = part[done : done + n]
            out = out | own << 2 * done if reverse else out << 2 * width | own
            done += width
        if done == k:
            return out
        first, second = part[:-width], part[width:]
        part = second << 2 * width | first if reverse else first << 2 * width | second
        width *= 2


def row_pieces(
    batch: pa.RecordBatch, k: int, spare: int, most: int | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """`data, start, windows, row, offset` of pieces of about STEP_LETTERS letters.

    A piece is a run of rows, or a part of one long row: where in `data` each
    one starts, how many windows of k letters begin in it, its row in the batch,
    and the letters in front of it. The last `spare` windows of a row are left out.
    A run of several rows has about `most` letters, if that is less.
    """
    most = min(STEP_LETTERS, most or STEP_LETTERS)
    data, at = byte_view(batch.column("seq"))
    begin = 0
    while begin < batch.num_rows:
        end = max(int(np.searchsorted(at, at[begin] + most, "right")) - 1, begin + 1)
        windows = np.maximum(np.diff(at[begin : end + 1]) - k + 1 - spare, 0)
        rows = np.arange(begin, end)
        if end == begin + 1 and windows[0] > STEP_LETTERS:
            for offset in range(0, int(windows[0]), STEP_LETTERS):
                size = min(STEP_LETTERS, int(windows[0]) - offset)
                first = at[begin] + offset
                yield data[first : first + size + k - 1], np.array([0]), np.array([size]), rows, np.array([offset])
        else:
            yield data[at[begin] : at[end]], at[begin:end] - at[begin], windows, rows, np.zeros(len(rows), np.int64)
        begin = end


def places(start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the run and place in the data of each window."""
    run = np.repeat(np.arange(len(windows)), windows)
    return run, np.arange(len(run)) + np.repeat(start - (np.cumsum(windows) - windows), windows)


def run_of(at: np.ndarray, start: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the run that each place (in order) lies in, and whether a window of it begins there."""
    run = np.searchsorted(start, at, "right") - 1
    return run, (run >= 0) & (at - start[run] < windows[run])


class CodeSet:
    """Codes of `bits` bits to look up in, by a table over their lowest bits and a sorted list."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes = np.unique(codes)
        self.low = min(bits, DENSE_CODES.bit_length() - 1)
        self.exact = bits == self.low
        self.table = np.zeros(1 << self.low, bool)
        self.table[self.codes & (1 << self.low) - 1] = True

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Where in `codes` a member stands."""
        at = np.flatnonzero(self.table[codes if self.exact else codes & (1 << self.low) - 1])
        if self.exact or not len(at):
            return at
        own = codes[at].astype(np.int64)
        slot = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        return at[self.codes[slot] == own]


def look_up(
    seqs: DataFrame, key: str, shapes: Sequence[tuple[int, int, int]], members: Sequence[np.ndarray]
) -> DataFrame:
    """`key, pos, width, offset, size, text`: the windows that hold a wanted code.

    Shape i is a window of `width` letters whose `size` letters from `offset` on
    (the first `MAX_K` of them) have a code among `members[i]`. Letters
    outside ACGT are in no code.
    """
    sets = [CodeSet(codes, 2 * min(size, MAX_K)) for (_, _, size), codes in zip(shapes, members)]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (width, offset, size), wanted in zip(shapes, sets):
                n = min(size, MAX_K)
                for data, start, windows, rows, before in row_pieces(batch, width, 0):
                    digits = _DIGIT[data]
                    at = wanted.places(window_codes(digits & 3, n))
                    other = np.flatnonzero(digits > 3)
                    if len(other):
                        at = at[np.searchsorted(other, at) == np.searchsorted(other, at + n)]
                    at = at - offset
                    run, inside = run_of(at, start, windows)
                    run, at = run[inside], at[inside]
                    if not len(at):
                        continue
                    keys = batch.column(key).take(pa.array(rows[run]))
                    pos = pa.array(at - start[run] + before[run], pa.int64())
                    shape = [pa.array(np.full(len(at), x, np.int32)) for x in (width, offset, size)]
                    text = byte_texts(data[at[:, None] + np.arange(width)])
                    yield pa.RecordBatch.from_arrays([keys, pos, *shape, text], names=[key, "pos", "width", "offset", "size", "text"])

    rows = seqs.select(key, "seq")
    return rows.mapInArrow(found, _schema(rows, [key], "pos BIGINT, width INT, offset INT, size INT, text STRING"))


def byte_texts(letters: np.ndarray) -> pa.Array:
    """A text a row of a matrix of ASCII letters."""
    ends = np.arange(len(letters) + 1, dtype=np.int32) * letters.shape[1]
    return pa.StringArray.from_buffers(len(letters), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(letters)))


def _canonical(data: np.ndarray, start: np.ndarray, windows: np.ndarray, k: int):
    """`run, lo` of the windows of ACGT alone, and `run, text` of the others."""
    run, at = places(start, windows)
    odd: list[tuple[int, bytes]] = []
    digits = _DIGIT[data]
    if k > MAX_K:
        plain = np.zeros(len(at), bool)
    else:
        other = np.concatenate([[0], np.cumsum(digits > 3)])
        plain = other[at + k] == other[at]
    if not plain.all():
        raw = data.tobytes()
        for r, p in zip(run[~plain].tolist(), at[~plain].tolist()):
            text = raw[p : p + k]
            odd.append((r, min(text, text.translate(_COMPLEMENT)[::-1])))
        run, at = run[plain], at[plain]
    if k > MAX_K:
        return run, np.zeros(0, np.int64), odd
    digits = digits & 3
    return run, np.minimum(window_codes(digits, k), window_codes(digits, k, True))[at].astype(np.int64), odd


def _tally(group: np.ndarray, code: np.ndarray, k: int, weight: np.ndarray | None = None):
    """`group, code, n`: distinct pairs in order, with how often (or how heavily) they occur."""
    if not len(code):
        return group[:0], code[:0], np.zeros(0, np.int64)
    if int(group[-1]).bit_length() + 2 * k <= 62:
        values, size = None, 1 << 2 * k
        joint = group << 2 * k | code
    else:
        values, code = np.unique(code, return_inverse=True)
        size = len(values)
        joint = group * size + code
    if weight is None:
        joint = np.sort(joint)
    else:
        order = np.argsort(joint, kind="stable")
        joint, weight = joint[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], joint[1:] != joint[:-1]]))
    n = np.diff(np.append(first, len(joint))) if weight is None else np.add.reduceat(weight, first)
    group, code = np.divmod(joint[first], size)
    return group, code if values is None else values[code], n


class _Found:
    """The windows of some whole records: keys, a row a record, and what each record holds."""

    def __init__(self, keys: pa.Table, group, code, n, odd: Counter):
        self.keys, self.group, self.code, self.n, self.odd = keys, group, code, n, odd


def _by_record(
    batches: Iterator[pa.RecordBatch], key: Sequence[str], k: int, spare: int, most: int | None = None
) -> Iterator[_Found]:
    """Windows per record, of rows sorted by record and numbered in it by `_n`.

    The last record of a piece may go on in the next one and is carried along.
    `most` as in `row_pieces`.
    """
    carried = None  # keys (one row), code, n, odd
    for batch in batches:
        own = pa.Table.from_batches([batch.select(list(key))]) if key else None
        opens = batch.column("_n").to_numpy() == 1
        for data, start, windows, rows, offset in row_pieces(batch, k, spare, most):
            # Group 0 is the carried record; a row that opens no record belongs to the one before.
            opening = opens[rows] & (offset == 0)
            number = np.cumsum(opening)
            run, code, odd = _canonical(data, start, windows, k)
            group, code, n = _tally(number[run], code, k)
            others = Counter((int(number[r]), text) for r, text in odd)
            keys = own.take(pa.array(rows[opening])) if key else None
            if carried is not None:
                head, codes, counts, texts = carried
                cut = int(np.searchsorted(group, 1))
                if cut:
                    old = np.zeros(len(codes) + cut, np.int64)
                    _, codes, counts = _tally(old, np.concatenate([codes, code[:cut]]), k, np.concatenate([counts, n[:cut]]))
                group = np.concatenate([np.zeros(len(codes), np.int64), group[cut:]])
                code, n = np.concatenate([codes, code[cut:]]), np.concatenate([counts, n[cut:]])
                others.update({(0, t): c for t, c in texts.items()})
                if key:
                    keys = pa.concat_tables([head, keys])
            else:
                group, others = group - 1, Counter({(g - 1, t): c for (g, t), c in others.items()})
            last = int(number[-1]) - (carried is None)
            cut = int(np.searchsorted(group, last))
            texts = Counter({t: c for (g, t), c in others.items() if g == last})
            rest = Counter({at: c for at, c in others.items() if at[0] < last}) if others else others
            if last:
                yield _Found(keys, group[:cut], code[:cut], n[:cut], rest)
            carried = keys.slice(last, 1) if key else None, code[cut:], n[cut:], texts
    if carried is not None:
        head, code, n, texts = carried
        yield _Found(head, np.zeros(len(code), np.int64), code, n, Counter({(0, t): c for t, c in texts.items()}))


def _letters(code: np.ndarray, k: int, odd: Sequence[bytes], reverse: bool) -> pa.Array:
    """The windows as text, then the odd ones; `reverse`: their reverse complements."""
    fours = -(-k // 4)
    text = np.zeros((0, 4 * fours), np.uint8)
    if len(code):
        text = _FOUR[code[:, None] >> 8 * np.arange(fours - 1, -1, -1) & 255].reshape(len(code), -1)
    text = text[:, 4 * fours - k :]
    plain = byte_texts(_PAIRED[text[:, ::-1]] if reverse else text)
    others = [t.translate(_COMPLEMENT)[::-1] if reverse else t for t in odd]
    return pa.concat_arrays([plain, pa.array([t.decode() for t in others], pa.string())])


def _sorted_by_record(seqs: DataFrame, key: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """`keep..., seq, _n`: records together in a task; rows already dealt by `key` aren't shuffled."""
    number = F.row_number().over(Window.partitionBy(*key).orderBy(*key))
    return seqs.select(*key, "seq", number.alias("_n")).select(*keep, "seq", "_n")


def _schema(df: DataFrame, names: Sequence[str], ddl: str) -> T.StructType:
    return T.StructType([*[df.schema[c] for c in names], *T.StructType.fromDDL(ddl).fields])


def record_counts(
    seqs: DataFrame, k: int, include_last: bool, key: Sequence[str], strands: bool = False, number: bool = False
) -> DataFrame:
    """`key..., lo, hi, n`: how often each strand pair occurs in each record.

    `strands`: `key..., kmer, cnt`, a row for each strand of a pair; a palindrome is
    one row and counts 2n-1. `number` adds the letters' bytes as a BIGINT, which
    orders windows as their texts: Spark sorts all rows for the least text of a
    group, and keeps one number a group for the least number.
    """
    key, spare, number = list(key), int(not include_last), number and strands
    if number and k > 8:
        raise ValueError("the letters of a window longer than 8 do not fit a BIGINT")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in _by_record(batches, key, k, spare, COUNT_LETTERS):
            odd = list(f.odd.items())
            none = f.group[:0], f.code[:0], f.n[:0]
            for at in range(0, len(f.code), COUNT_ROWS):
                own = slice(at, at + COUNT_ROWS)
                yield rows_of(f.keys, f.group[own], f.code[own], f.n[own], [])
            for at in range(0, len(odd), COUNT_ROWS):
                yield rows_of(f.keys, *none, odd[at : at + COUNT_ROWS])

    def rows_of(keys: pa.Table, group, code, n, odd: list) -> pa.RecordBatch:
        texts = [t for (_, t), _ in odd]
        at = np.concatenate([group, np.array([g for (g, _), _ in odd], np.int64)])
        n = np.concatenate([n, np.array([c for _, c in odd], np.int64)])
        lo, hi = (_letters(code, k, texts, reverse) for reverse in (False, True))
        if strands:
            single = pc.equal(lo, hi).to_numpy(zero_copy_only=False)
            lo = pa.concat_arrays([lo, hi.filter(pa.array(~single))])
            at, n = np.concatenate([at, at[~single]]), np.concatenate([np.where(single, 2 * n - 1, n), n[~single]])
        taken = keys.take(pa.array(at))
        columns = [taken.column(c).combine_chunks() for c in key]
        found = [lo, pa.array(n, pa.int64())] if strands else [lo, hi, pa.array(n, pa.int64())]
        if number:
            bytes_ = np.zeros((len(lo), 8), np.uint8)
            bytes_[:, 8 - k :] = byte_view(lo)[0].reshape(-1, k)
            found.append(pa.array(bytes_.view(">i8").ravel().astype(np.int64)))
        return pa.RecordBatch.from_arrays([*columns, *found], names=[*key, *names])

    ddl = "kmer STRING, cnt BIGINT" + ", number BIGINT" * number if strands else "lo STRING, hi STRING, n BIGINT"
    names = T.StructType.fromDDL(ddl).names
    rows = _sorted_by_record(seqs, key, key)
    return rows.mapInArrow(count, _schema(rows, key, ddl))


def record_prevalence(
    seqs: DataFrame, k: int, include_last: bool, key: Sequence[str], by: str | None = None, weight: str | None = None
) -> DataFrame:
    """`by, lo, hi, n`: records that hold each strand pair, or their weight (both columns of `key`)."""
    spare, part = int(not include_last), [by] if by else []
    keep = [*part, *([weight] if weight else [])]

    def part_rows(keys: pa.Table | None, at, code, odd: Counter, n) -> pa.RecordBatch:
        columns = [keys.take(pa.array(at)).column(c).combine_chunks() for c in part]
        codes = pa.concat_arrays([pa.array(code, pa.int64()), pa.nulls(len(odd), pa.int64())])
        texts = pa.concat_arrays([pa.nulls(len(code), pa.string()), pa.array([t.decode() for _, t in odd], pa.string())])
        n = np.concatenate([n, np.array(list(odd.values()), np.int64)])
        return pa.RecordBatch.from_arrays([*columns, codes, texts, pa.array(n)], names=[*part, "code", "odd", "n"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << 2 * k, np.int64) if not keep and 1 << 2 * k <= DENSE_CODES else None
        for f in _by_record(batches, keep, k, spare):
            odd: Counter = Counter()
            first, number, weights = np.zeros(1, np.int64), None, None
            if by:
                # Records come sorted by it.
                names = f.keys.column(by).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
                new = np.concatenate([[True], names[1:] != names[:-1]])
                number, first = np.cumsum(new) - 1, np.flatnonzero(new)
            if weight:
                weights = f.keys.column(weight).combine_chunks().fill_null(0).to_numpy()
            for g, text in f.odd:
                odd[0 if number is None else int(number[g]), text] += 1 if weights is None else int(weights[g])
            if dense is not None:
                dense += np.bincount(f.code, minlength=len(dense))
                group = code = n = np.zeros(0, np.int64)
            else:
                group = np.zeros(len(f.code), np.int64) if number is None else number[f.group]
                group, code, n = _tally(group, f.code, k, None if weights is None else weights[f.group])
            at = first[np.concatenate([group, np.array([g for g, _ in odd], np.int64)])]
            if len(at):
                yield part_rows(f.keys, at, code, odd, n)
        if dense is not None:
            code = np.flatnonzero(dense)
            yield part_rows(None, None, code, Counter(), dense[code])

    rows = _sorted_by_record(seqs, key, keep)
    parts = rows.mapInArrow(found, _schema(rows, part, "code BIGINT, odd STRING, n BIGINT"))
    # Added up map-side; the plan's test looks for the count in this aggregate.
    total = F.when(F.count("n") > 0, F.sum("n"))
    summed = parts.groupBy(*part, "code", "odd").agg(total.alias("n"))
    lo = F.coalesce("odd", code_text("code", k)) if k <= MAX_K else F.col("odd")
    return summed.select(*part, lo.alias("lo"), "n").select(*part, "lo", reverse_complement("lo").alias("hi"), "n")
