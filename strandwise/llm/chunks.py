"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest.

The gear hash of a byte depends on the 32 bytes up to it, so chunk ends move
with the text and an insertion disturbs the chunks around it only. A chunk is
repeated if its digest came before, in an earlier document (smaller doc_id) or
earlier in the same one. Chunks are seeds: `without_passages` extends a run of
neighbouring repeated chunks byte by byte against the first places of its outer
chunks, to the true ends of the repeat. It goes if it then covers at least
`least_bytes`, so that a short phrase which texts share by chance stays. Each
byte that goes equals one of an earlier place, so a copy of it is left.
`without_repeats` takes the runs as they are.

Counting is map-side: a digest's first place is a `min` over the occurrences,
so a chunk of a third of all documents is one row a task.

Defined results: a null text stays null; like an empty one it has no chunks.
Rows with the same doc_id and text are one document and come out alike; a null
doc_id comes after all others. Columns other than the text are passed on,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import byte_view, cut_lineage, drop_table, extended, fresh, pieces

#: A chunk ends where this many low bits of the shifted hash are zero: 32 bytes on average.
BITS = 5
LEAST_CHUNK = 16
MOST_CHUNK = 512
LEAST_BYTES = 150
#: Bytes compared at each end of a run in the first round, and how much wider each further round is.
MARGIN, WIDER = 128, 8
_LAST = (1 << 63) - 1


def _gear() -> np.ndarray:
    """A 32-bit number for each byte, from a multiplicative mix."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


_GEAR = _gear()


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = 2 h[i - 1] + gear[data[i]] mod 2^32 for all i, by doubling the window five times."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        shifted = np.zeros_like(h)
        shifted[k:] = h[:-k] << np.uint32(k)
        h = h + shifted
    return h


def chunk_ends(text: np.ndarray, bits: int = BITS, least: int = LEAST_CHUNK, most: int = MOST_CHUNK) -> list[int]:
    """Ends of the chunks of one text; the last is its length."""
    size = len(text)
    if not size:
        return []
    marks = np.flatnonzero(gear_hash(text) >> np.uint32(32 - bits) == 0) + 1
    out, begin = [], 0
    for end in marks.tolist():
        while end - begin > most:
            begin += most
            out.append(begin)
        if end - begin >= least:
            out.append(end)
            begin = end
    while size - begin > most:
        begin += most
        out.append(begin)
    if begin < size:
        out.append(size)
    return out


def chunk_table(docs: DataFrame, text: str = "text", bits: int = BITS) -> DataFrame:
    """One row for each chunk: its document (`doc_id`, `h`), place and 128-bit digest as two longs.

    `again` marks a chunk whose digest came before in the same document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text, 2 << 20):
                data, at = byte_view(part.column(text))
                whole = data.tobytes()
                row, begins, ends, digests, again = [], [], [], [], []
                for i in range(part.num_rows):
                    lo, seen = int(at[i]), set()
                    own = chunk_ends(data[at[i] : at[i + 1]], bits)
                    begin = 0
                    for end in own:
                        digest = blake2b(whole[lo + begin : lo + end], digest_size=16).digest()
                        begins.append(begin)
                        digests.append(digest)
                        again.append(digest in seen)
                        seen.add(digest)
                        begin = end
                    row += [i] * len(own)
                    ends += own
                d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                take = pa.array(row, pa.int64())
                length = np.array(ends, np.int32) - np.array(begins, np.int32)
                yield pa.record_batch(
                    [
                        part.column("doc_id").take(take),
                        part.column("h").take(take),
                        pa.array(begins, pa.int32()),
                        pa.array(length),
                        pa.array(again, pa.bool_()),
                        pa.array(d[:, 0].copy()),
                        pa.array(d[:, 1].copy()),
                    ],
                    ["doc_id", "h", "begin", "length", "again", "d0", "d1"],
                )

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key(text), text)
    schema = "doc_id long, h long, begin int, length int, again boolean, d0 long, d1 long"
    return keyed.mapInArrow(run, schema)


def _text_key(text: str) -> Column:
    return F.xxhash64(text).alias("h")


def repeated_chunks(docs: DataFrame, text: str = "text", bits: int = BITS) -> DataFrame:
    """(doc_id, h, begin, length) of the chunks that came before, by doc_id or within a document.

    `first` is the place where the digest came first: document `o`, `h` and `begin`. A null doc_id comes last.
    """
    chunks = chunk_table(docs, text, bits)
    order = F.coalesce("doc_id", F.lit(_LAST))
    place = F.struct(order.alias("o"), "h", "begin")
    firsts = chunks.groupBy("d0", "d1").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    return (
        chunks.join(firsts, ["d0", "d1"])
        .where(F.col("again") | (order > F.col("first.o")))
        .select("doc_id", "h", "begin", "length", "first")
    )


def _run_ends(repeated: DataFrame) -> DataFrame:
    """Both ends of each run of neighbouring repeated chunks, with the place that came first.

    `side` is 0 for the left end; `o`, `h`, `place` are the end's own place, `so`, `sh`, `splace` the first one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                runs: list[list] = []
                for c in sorted(row["own"], key=lambda c: (c["begin"], c["length"])):
                    end = c["begin"] + c["length"]
                    if runs and runs[-1][1] == end:  # a row's equal twin
                        continue
                    first = c["first"]
                    after = (first["o"], first["h"], first["begin"] + c["length"])
                    if runs and runs[-1][1] == c["begin"]:
                        runs[-1][1], runs[-1][3] = end, after
                    else:
                        runs.append([c["begin"], end, (first["o"], first["h"], first["begin"]), after])
                for b, e, left, right in runs:
                    out.append((row["doc_id"], row["h"], b, e, 0, b, *left))
                    out.append((row["doc_id"], row["h"], b, e, 1, e, *right))
            names = ["doc_id", "h", "b", "e", "side", "place", "so", "sh", "splace"]
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int64(), pa.int32()]
            columns = zip(*out, strict=True) if out else [()] * 9
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    own = F.collect_list(F.struct("begin", "length", "first")).alias("own")
    schema = "doc_id long, h long, b int, e int, side int, place int, so long, sh long, splace int"
    ends = repeated.groupBy("doc_id", "h").agg(own).mapInArrow(run, schema)
    return ends.withColumn("o", F.coalesce("doc_id", F.lit(_LAST)))


def _margins(docs: DataFrame, text: str, points: DataFrame, skip: int, width: int) -> DataFrame:
    """`width` bytes of text beyond `skip` bytes to the left (side 0) or right (side 1) of each point (o, h, side, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "t", 2 << 20):
                rows = []
                for o, h, raw, points in zip(*(part.column(c).to_pylist() for c in ("o", "h", "t", "points")), strict=True):
                    for p in points:
                        at = p["place"]
                        if p["side"]:
                            margin = raw[at + skip : at + skip + width]
                        else:
                            margin = raw[max(at - skip - width, 0) : max(at - skip, 0)]
                        rows.append((o, h, p["side"], at, margin))
                if rows:
                    kinds = pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.record_batch(columns, ["o", "h", "side", "place", "margin"])

    grouped = points.distinct().groupBy("o", "h").agg(F.collect_list(F.struct("side", "place")).alias("points"))
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("o"), _text_key(text), F.col(text).cast("binary").alias("t")
    )
    found = keyed.join(grouped, ["o", "h"]).mapInArrow(run, "o long, h long, side int, place int, margin binary")
    # Rows with the same doc_id and text say the same.
    return found.groupBy("o", "h", "side", "place").agg(F.first("margin").alias("margin"))


def common_length(mine: bytes, other: bytes, side: int) -> int:
    """Equal bytes outwards from a run's end: of the margins' ends on side 0, of their beginnings on side 1."""
    n = min(len(mine), len(other))
    a, b = np.frombuffer(mine, np.uint8), np.frombuffer(other, np.uint8)
    differs = a[:n] != b[:n] if side else a[len(a) - n :][::-1] != b[len(b) - n :][::-1]
    return int(differs.argmax()) if differs.any() else n


def _extended_runs(docs: DataFrame, text: str, bits: int) -> DataFrame:
    """(doc_id, h, begin, length) of the runs of repeated chunks, each extended to its true ends."""
    ends = cut_lineage(_run_ends(repeated_chunks(docs, text, bits)))
    rounds, open_, skip, width = [], ends, 0, MARGIN

    def measure(width: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sides = batch.column("side").to_pylist()
                mine, other = batch.column("mine").to_pylist(), batch.column("other").to_pylist()
                n = [common_length(x, y, s) for x, y, s in zip(mine, other, sides, strict=True)]
                left = batch.drop_columns(["mine", "other"])
                yield pa.record_batch([*left.columns, pa.array(n, pa.int32())], [*left.schema.names, "n"])

        return run

    while True:
        mine = open_.select("o", "h", "side", "place")
        other = open_.select(F.col("so").alias("o"), F.col("sh").alias("h"), "side", F.col("splace").alias("place"))
        margins = cut_lineage(_margins(docs, text, mine.union(other), skip, width))
        firsts = margins.select(F.col("o").alias("so"), F.col("h").alias("sh"), "side", F.col("place").alias("splace"), F.col("margin").alias("other"))
        both = open_.join(margins.withColumnRenamed("margin", "mine"), ["o", "h", "side", "place"])
        both = both.join(firsts, ["so", "sh", "side", "splace"]).select(*ends.columns, "mine", "other")
        found = cut_lineage(both.mapInArrow(measure(width), extended(ends, "n int")))
        drop_table(margins)
        rounds.append(found.select("doc_id", "h", "b", "e", "side", "n"))
        open_ = found.where(F.col("n") == width).drop("n")
        if open_.isEmpty():
            break
        skip, width = skip + width, width * WIDER
    every = rounds[0]
    for r in rounds[1:]:
        every = every.union(r)
    left, right = (F.sum(F.when(F.col("side") == k, F.col("n")).otherwise(0)) for k in (0, 1))
    runs = every.groupBy("doc_id", "h", "b", "e").agg(left.alias("left"), right.alias("right"))
    begin = F.col("b") - F.col("left")
    return runs.select("doc_id", "h", begin.alias("begin"), (F.col("e") + F.col("right") - begin).alias("length"))


def cut_spans(text: bytes, begins: list[int], lengths: list[int], least: int) -> list[tuple[int, int]]:
    """Runs of neighbouring or overlapping spans of at least `least` bytes, drawn in to whole characters."""
    runs: list[list[int]] = []
    for b, n in sorted(set(zip(begins, lengths, strict=True))):
        if runs and runs[-1][1] >= b:
            runs[-1][1] = max(runs[-1][1], b + n)
        else:
            runs.append([b, b + n])
    out = []
    for b, e in runs:
        if e - b < least:
            continue
        while b < e and text[b] & 0xC0 == 0x80:
            b += 1
        while e > b and e < len(text) and text[e] & 0xC0 == 0x80:
            e -= 1
        if e > b:
            out.append((b, e))
    return out


def without_repeats(
    docs: DataFrame, text: str = "text", bits: int = BITS, least_bytes: int = LEAST_BYTES
) -> DataFrame:
    """`docs` with the text that is left, and `removed`: array of (begin, length) in bytes of the input.

    Rows with the same doc_id and text are one document and come out alike.
    """
    docs = docs.drop("removed")
    return _cut(docs, repeated_chunks(docs, text, bits), text, least_bytes)


def without_passages(
    docs: DataFrame, text: str = "text", bits: int = BITS, least_bytes: int = LEAST_BYTES
) -> DataFrame:
    """`without_repeats` with each run of repeated chunks extended to the true ends of the repeat."""
    docs = docs.drop("removed")
    return _cut(docs, _extended_runs(docs, text, bits), text, least_bytes)


def _cut(docs: DataFrame, found: DataFrame, text: str, least_bytes: int) -> DataFrame:
    """`docs` without the spans `found` (doc_id, h, begin, length), and `removed`."""
    columns = docs.columns
    begins_name, lengths_name, doc, key = (fresh(docs, x) for x in ("begins", "lengths", "doc", "key"))
    spans = (
        found.groupBy("doc_id", "h")
        .agg(F.collect_list("begin").alias(begins_name), F.collect_list("length").alias(lengths_name))
        .select(F.col("doc_id").alias(doc), F.col("h").alias(key), begins_name, lengths_name)
    )
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(key))
    joined = docs.join(spans, same, "left").select(*columns, begins_name, lengths_name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = columns.index(text)
        for batch in batches:
            for part in pieces(batch, text):
                left, removed = part.column(text).to_pylist(), []
                begins, lengths = part.column(begins_name).to_pylist(), part.column(lengths_name).to_pylist()
                for i, own in enumerate(begins):
                    raw = left[i].encode() if own else b""
                    spans = cut_spans(raw, own, lengths[i], least_bytes) if own else []
                    removed.append([(b, e - b) for b, e in spans])
                    if spans:
                        edges = [0, *(x for s in spans for x in s), len(raw)]
                        kept = (raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                        left[i] = b"".join(kept).decode()
                out = [part.column(c) for c in columns]
                out[place] = pa.array(left, pa.string())
                kind = pa.list_(pa.struct([("begin", pa.int64()), ("length", pa.int64())]))
                rows = [[{"begin": b, "length": n} for b, n in r] for r in removed]
                yield pa.record_batch([*out, pa.array(rows, kind)], [*columns, "removed"])

    schema = extended(docs, "removed array<struct<begin:bigint,length:bigint>>")
    return joined.mapInArrow(run, schema)
