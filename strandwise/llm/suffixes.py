"""Suffix-array dedup: repeated byte strings by a distributed, common-prefix-aware merge sort.

A window of `length` bytes holds one anchor: the position of the least hash
among its grams of `GRAM` bytes, the leftmost of equals. Equal windows have
their anchors at equal places, so it is enough to sort the suffixes that start
at anchors (about 2 in `length`), and the mirrored suffixes that run back from
them. Window l bytes before anchor a equals one before anchor b if and only if
their forward suffixes agree on length - l bytes and their backward ones on l.

1. Exact copies of a text count once; anchors whose gram starts nowhere else
   are dropped, since no window around them can repeat.
2. Each bucket of documents sorts the suffixes it sends to a partition and
   front-codes the run: common prefix with the one before, and the rest.
3. The partition merges runs by a loser tree whose players carry their common
   prefix with the last winner: two players with different prefixes need no
   look at the text, equal ones are compared from there on. The merge yields
   the array of common prefixes along with the order.
4. For each l the classes of suffixes that agree on length - l and on l bytes
   are runs in the two orders; a window repeats if its pair of classes does.

Equal members of a bucket are folded. A gram with more than `HOT` anchors is
dealt out by stretches of l and by a hash of the bytes that all windows of the
stretch share, so that only anchors which agree on nearly a whole window meet.

Defined results: a null text is empty; texts shorter than `length` lose
nothing. Repeated rows are copies of each other. Matches never cross documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from strandwise.llm.common import cut_lineage, pieces, slots

LENGTH = 400
GRAM = 16
HOT = 4096
#: Window starts of a stretch of a hot gram.
STRETCH = 16
_POSITION_BITS = 28
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each position, by doubling the window."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _ODD
    h ^= h >> np.uint64(29)
    width = 1
    while width < size:
        h = h[:-width] * _MIX + (h[width:] ^ (h[width:] >> np.uint64(31))) * _ODD
        width *= 2
    return h ^ (h >> np.uint64(32))


def anchors(data: np.ndarray, length: int = LENGTH, size: int = GRAM) -> tuple[np.ndarray, ...]:
    """(gram hash, anchor, least l, most l): window starts anchor - l belong to the anchor."""
    windows = len(data) - length + 1
    if windows <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    h = gram_hashes(data, size)
    low = np.uint64((1 << _POSITION_BITS) - 1)
    key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    w = length - size + 1
    rows = -(-len(key) // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    grid = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(back[:windows], ahead[w - 1 : w - 1 + windows])
    at = (least & low).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], windows) - 1
    a = at[first]
    return h[a], a, a - last, a - first


def common_prefix(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, of which `start` bytes are known."""
    most = min(len(a), len(b))
    step = 32
    while start < most and a[start : start + step] == b[start : start + step]:
        start += step
    while start < most and a[start] == b[start]:
        start += 1
    return min(start, most)


def front_code(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Of a sorted run: common prefix with the string before, length, and what follows the prefix."""
    prefix = np.zeros(len(strings), np.uint16)
    for i in range(1, len(strings)):
        prefix[i] = common_prefix(strings[i - 1], strings[i], 0)
    lengths = np.fromiter(map(len, strings), np.uint16, len(strings))
    return prefix, lengths, b"".join(s[p:] for s, p in zip(strings, prefix.tolist(), strict=True))


def decode_run(prefix: np.ndarray, lengths: np.ndarray, rest: bytes) -> list[bytes]:
    out, last, at = [], b"", 0
    for p, n in zip(prefix.tolist(), lengths.tolist(), strict=True):
        last = last[:p] + rest[at : at + n - p]
        at += n - p
        out.append(last)
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Order of all strings as (run, place), and the common prefix of each with the one before it.

    A run is its strings and their common prefixes. A player is (run, place, prefix with the
    last winner); a match of players with different prefixes is won by the longer one.
    """
    runs_of = [r[0] for r in runs]
    prefixes = [r[1] for r in runs]
    size = 1
    while size < len(runs):
        size *= 2
    end = None  # a run that has no more strings; loses against all

    def play(x, y):
        """Winner and loser; the loser's prefix becomes the one with the winner."""
        if x is end:
            return y, x
        if y is end:
            return x, y
        if x[2] > y[2]:
            return x, y
        if y[2] > x[2]:
            return y, x
        a, b = runs_of[x[0]][x[1]], runs_of[y[0]][y[1]]
        n = common_prefix(a, b, x[2])
        if a[n:] <= b[n:]:
            return x, (y[0], y[1], n)
        return y, (x[0], x[1], n)

    losers: list = [end] * size
    level = [(i, 0, 0) if i < len(runs) and runs_of[i] else end for i in range(size)]
    node = size
    while node > 1:
        node //= 2
        winners = []
        for k in range(node):
            win, lose = play(level[2 * k], level[2 * k + 1])
            losers[node + k] = lose
            winners.append(win)
        level = winners
    winner = level[0]
    order, common = [], []
    while winner is not end:
        run, place, prefix = winner
        order.append((run, place))
        common.append(prefix)
        place += 1
        player = (run, place, int(prefixes[run][place])) if place < len(runs_of[run]) else end
        node = (size + run) // 2
        while node:
            player, losers[node] = play(player, losers[node])
            node //= 2
        winner = player
    return order, common


def repeated(
    forward: np.ndarray, forward_common: np.ndarray, backward: np.ndarray, backward_common: np.ndarray,
    least: np.ndarray, most: np.ndarray, weight: np.ndarray, length: int,
) -> list[list[tuple[int, int]]]:
    """Of each member: the stretches of l (from, to) whose windows repeat.

    `forward`, `backward`: members in the order of their suffixes, with the common prefixes.
    """
    n = len(least)
    place_f, place_b = np.empty(n, np.int64), np.empty(n, np.int64)
    place_f[forward], place_b[backward] = np.arange(n), np.arange(n)
    begin = np.full(n, -1)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for m in np.flatnonzero(weight > 1).tolist():
        out[m].append((int(least[m]), int(most[m])))
    open_ = weight == 1
    low, high = (int(least.min()), int(most.max())) if n else (0, -1)
    for l in range(low, high + 1):  # noqa: E741
        mine = np.flatnonzero((least <= l) & (l <= most))
        key = np.cumsum(forward_common < length - l)[place_f[mine]] * (n + 1) + np.cumsum(backward_common < l)[place_b[mine]]
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        hit = np.zeros(len(mine), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        now = np.zeros(n, bool)
        now[mine[hit]] = True
        now &= open_
        begin[now & (begin < 0)] = l
        for m in np.flatnonzero(~now & (begin >= 0)).tolist():
            out[m].append((int(begin[m]), l - 1))
            begin[m] = -1
    for m in np.flatnonzero(begin >= 0).tolist():
        out[m].append((int(begin[m]), high))
    return out


def _zip(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unzip(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)


_RUN = ["p", "f_prefix", "f_length", "f_rest", "b_prefix", "b_length", "b_rest", "b_member", "least", "most", "owners", "row", "at"]
_KINDS = {"f_prefix": "<u2", "f_length": "<u2", "b_prefix": "<u2", "b_length": "<u2", "b_member": "<u4", "least": "<u2", "most": "<u2", "owners": "<u4", "row": "<i8", "at": "<i4"}


def _members(text: bytes, row: int, found: list[dict], parts: int, length: int) -> Iterator[tuple]:
    """(partition, (backward, forward, least l, most l), row, anchor) of one document's live anchors."""
    for f in found:
        a, low, high = f["a"], f["least"], f["most"]
        if f["hot"]:
            first = range(low // STRETCH * STRETCH, high + 1, STRETCH)
            # What all windows of the whole stretch share, also where a member has only some of them.
            stretches = [
                (max(low, s), min(high, s + STRETCH - 1), xxh64_intdigest(text[a - s : a + length - s - STRETCH + 1], s))
                for s in first
            ]
        else:
            stretches = [(low, high, f["g"])]
        for lo, hi, p in stretches:
            backward, forward = text[a - hi : a][::-1], text[a : a + length - lo]
            yield (p ^ (p >> 29)) % parts, (backward, forward, lo, hi), row, a


def _runs(batch: list[tuple]) -> Iterator[dict]:
    """Folds and sorts the members of each partition; one row of front-coded runs each."""
    by_part: dict[int, dict[tuple, list]] = {}
    for p, member, row, a in batch:
        by_part.setdefault(p, {}).setdefault(member, []).append((row, a))
    for p, members in by_part.items():
        own = sorted(members, key=lambda m: m[1])
        back = sorted(range(len(own)), key=lambda i: own[i][0])
        f_prefix, f_length, f_rest = front_code([m[1] for m in own])
        b_prefix, b_length, b_rest = front_code([own[i][0] for i in back])
        holders = [members[m] for m in own]
        numbers = {
            "f_prefix": f_prefix, "f_length": f_length, "b_prefix": b_prefix, "b_length": b_length, "b_member": back,
            "least": [m[2] for m in own], "most": [m[3] for m in own], "owners": [len(h) for h in holders],
            "row": [r for h in holders for r, _ in h], "at": [a for h in holders for _, a in h],
        }
        blobs = {k: np.asarray(v).astype(_KINDS[k]).tobytes() for k, v in numbers.items()}
        yield {"p": p, "f_rest": _zip(f_rest), "b_rest": _zip(b_rest), **{k: _zip(v) for k, v in blobs.items()}}


def _merge(rows: list[dict], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered stretches (row, begin, end) of all documents with members in these runs."""
    n = {k: [np.frombuffer(_unzip(r[k]), t) for r in rows] for k, t in _KINDS.items()}
    at = np.cumsum([0, *(len(x) for x in n["least"])])

    def order_of(side: str) -> tuple[np.ndarray, np.ndarray]:
        runs = [
            (decode_run(n[f"{side}_prefix"][i], n[f"{side}_length"][i], _unzip(r[f"{side}_rest"])), n[f"{side}_prefix"][i])
            for i, r in enumerate(rows)
        ]
        order, common = merge_runs(runs)
        flat = np.array(order, np.int64).reshape(-1, 2)
        member = flat[:, 1] if side == "f" else np.concatenate(n["b_member"])[at[flat[:, 0]] + flat[:, 1]]
        return at[flat[:, 0]] + member, np.array(common, np.int64)

    forward, forward_common = order_of("f")
    backward, backward_common = order_of("b")
    least, most = (np.concatenate(n[k]).astype(np.int64) for k in ("least", "most"))
    owners = np.concatenate(n["owners"]).astype(np.int64)
    found = repeated(forward, forward_common, backward, backward_common, least, most, owners, length)
    holder = np.cumsum(np.append(0, owners))
    row, anchor = np.concatenate(n["row"]), np.concatenate(n["at"]).astype(np.int64)
    out = []
    for m, stretches in enumerate(found):
        for lo, hi in stretches:
            for h in range(holder[m], holder[m + 1]):
                out.append((row[h], anchor[h] - hi, anchor[h] - lo + length))
    return tuple(np.array(out, np.int64).reshape(-1, 3).T)


def union_spans(begins: list[int], ends: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for b, e in sorted(zip(begins, ends, strict=True)):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [(b, e) for b, e in out]


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, `removed` (array of begin, length) and `kept`, the bytes that are left.

    `docs` is a scan, so that a row has the same number each time it is read.
    """
    spark = docs.sparkSession
    parts = slots(spark)
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    long_ones = source.where(F.octet_length("text") >= length)
    copies = cut_lineage(long_ones.select("row", F.unhex(F.md5("text")).alias("digest")))
    groups = copies.groupBy("digest").agg(F.min("row").alias("first"), F.count("*").alias("copies"))
    named = cut_lineage(copies.join(groups, "digest").select("row", "first", F.col("copies") > 1))
    named = named.toDF("row", "first", "copied")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                rows, found = part.column("row").to_numpy(), []
                for t in part.column("text").cast(pa.binary()).to_pylist():
                    found.append(anchors(np.frombuffer(t, np.uint8), length))
                g, a, least, most = (np.concatenate(c) for c in zip(*found, strict=True))
                row = np.repeat(rows, [len(f[0]) for f in found])
                numbers = [row, g.view(np.int64), a.astype(np.int32), least.astype(np.int16), most.astype(np.int16)]
                yield pa.record_batch([pa.array(x) for x in numbers], ["row", "g", "a", "least", "most"])

    places = long_ones.select("row", "text").mapInArrow(find, "row long, g long, a int, least short, most short")
    once = named.where("row = first").select("row")
    places = cut_lineage(places.join(once, "row", "left_semi"))
    # A written table, so that both sides of the join are exchanged for it alone and a hot gram can be split.
    counts = cut_lineage(
        places.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g", (F.col("n") > HOT).alias("hot"))
    )
    live = places.join(counts, "g").groupBy("row").agg(F.collect_list(F.struct("g", "a", "least", "most", "hot")).alias("found"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                for t, r, f in zip(texts, part.column("row").to_pylist(), part.column("found").to_pylist(), strict=True):
                    for x in f:
                        x["g"] &= (1 << 64) - 1
                    new = list(_members(t, r, f, parts, length))
                    waiting += new
                    size += sum(len(m[1][0]) + len(m[1][1]) + 200 for m in new)
                    if size > 64 << 20:
                        yield pa.RecordBatch.from_pylist(list(_runs(waiting)), _schema())
                        waiting, size = [], 0
        if waiting:
            yield pa.RecordBatch.from_pylist(list(_runs(waiting)), _schema())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        by_part: dict[int, list[dict]] = {}
        for r in rows:
            by_part.setdefault(r["p"], []).append(r)
        for own in by_part.values():
            row, begin, end = _merge(own, length)
            yield pa.record_batch([pa.array(row), pa.array(begin), pa.array(end)], ["row", "begin", "end"])

    runs = long_ones.select("row", "text").join(live, "row").mapInArrow(send, ", ".join(f"{c} {'int' if c == 'p' else 'binary'}" for c in _RUN))
    spans = runs.repartition(parts, "p").mapInArrow(merge, "row long, begin long, end long")
    spans = cut_lineage(spans.groupBy("row").agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends")))
    spans = named.join(spans.withColumnRenamed("row", "first"), "first", "left").where("copied or begins is not null")
    joined = source.join(spans.select("row", "copied", "begins", "ends"), "row", "left").select("doc_id", "text", "copied", "begins", "ends")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                kept, removed = [], []
                columns = (part.column(c).to_pylist() for c in ("copied", "begins", "ends"))
                for t, copied, begins, ends in zip(texts, *columns, strict=True):
                    spans = [(0, len(t))] if copied else union_spans(begins, ends) if begins else []
                    edges = [0, *(x for s in spans for x in s), len(t)]
                    kept.append(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                    removed.append([{"begin": b, "length": e - b} for b, e in spans])
                yield pa.record_batch(
                    [
                        part.column("doc_id"),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array(removed, kind),
                        pa.array(kept, pa.binary()),
                    ],
                    ["doc_id", "n_bytes", "removed", "kept"],
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc_id {id_type}, n_bytes long, removed array<struct<begin:bigint,length:bigint>>, kept binary")


def _schema() -> pa.Schema:
    return pa.schema([(c, pa.int32() if c == "p" else pa.binary()) for c in _RUN])
