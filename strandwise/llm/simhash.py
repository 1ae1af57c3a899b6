"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming distance, components.

Equal fingerprints are one node from the start, so copies cost one row. A
fingerprint is cut into five blocks; two that differ in at most three bits
agree on at least two blocks, so each is dealt to the ten pairs of blocks.
Rows that share a pair of blocks are compared by distance; a crowded bucket is
dealt out as tiles of a bounded number of rows that are compared with each
other tile of the bucket, so no task holds a bucket and no distance is left
out. A tile returns the links of a spanning forest only: as many as connect
its rows, never all pairs.

Defined results: a null or empty text has fingerprint zero, which links like
any other. Repeated rows share their component. The component's id is its
smallest non-null doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from strandwise.llm.common import cut_lineage, extended, fresh, lower_ascii, pieces, slots, texts_of
from strandwise.llm.components import connected

SEED = 42
SHINGLE = 3
DISTANCE = 3
#: Bits of the five blocks, from the top.
BLOCKS = (13, 13, 13, 13, 12)
#: Rows of a tile; two tiles are compared at once.
TILE = 2048


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Bits set in over half of the shingles' hashes; 0 without words."""
    words = lower_ascii(text).split()
    if not words:
        return 0
    if len(words) <= size:
        return xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    n = len(words) - size + 1
    hashes = np.fromiter(map(partial(xxh64_intdigest, seed=SEED), shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """`docs` with a column `print` (bigint with the bits of the fingerprint) in place of the text."""
    keep = [c for c in docs.columns if c not in (text, "print")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                own = np.array([fingerprint(t, size) for t in texts_of(part.column(text))], np.uint64)
                yield pa.record_batch(
                    [*(part.column(c) for c in keep), pa.array(own.view(np.int64))], [*keep, "print"]
                )

    schema = extended(docs.select(*keep), "print long")
    return docs.select(*keep, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


def _masks() -> list[int]:
    """The bits of each pair of blocks."""
    at, blocks = 64, []
    for width in BLOCKS:
        at -= width
        blocks.append(((1 << width) - 1) << at)
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(prints: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Positions of linked rows that span the components of one pair of tiles, by breadth-first search."""
    left = np.arange(len(prints))
    out = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(prints[left] ^ prints[at]) <= limit
            if near.any():
                found = left[near].tolist()
                out += [(at, f) for f in found]
                queue += found
                left = left[~near]
    return out


def links(prints: DataFrame, limit: int = DISTANCE) -> DataFrame:
    """Links (a, b) among distinct values of column `print` that connect all within `limit` bits."""
    masks = _masks()
    each = prints.select(
        "print", F.posexplode(F.array(*[F.col("print").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("kind", "key")
    )
    each = cut_lineage(each)
    crowd = each.groupBy("kind", "key").agg(F.count("*").alias("n")).where("n > 1")
    # A bucket of t tiles: a row meets each tile once, as the pair (smaller tile, larger tile).
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("print", F.lit(11)), F.col("t")).cast("int")
    dealt = (
        each.join(crowd, ["kind", "key"])
        .withColumn("t", tiles)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
        .select("kind", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "print")
    )
    group = ["kind", "key", "i", "j"]
    n = slots(prints.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if kept is None else [kept, batch]).combine_chunks()
            columns = [table.column(c).to_numpy() for c in group]
            change = np.zeros(table.num_rows, bool)
            change[:1] = True
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            at = np.flatnonzero(change)
            kept = table.slice(int(at[-1])).to_batches()[0] if len(at) else None
            yield from _compare(table.column("print").to_numpy(), at, limit)
        if kept is not None:
            yield from _compare(kept.column("print").to_numpy(), np.array([0, kept.num_rows]), limit)

    found = dealt.repartition(n, *group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long")
    return found


def _compare(prints: np.ndarray, at: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """Links inside the groups [at[k], at[k + 1]); groups of two rows at once, larger ones each."""
    size = np.diff(at)
    two = at[:-1][size == 2]
    prints = prints.view(np.uint64)
    a, b = prints[two], prints[two + 1]
    near = np.bitwise_count(a ^ b) <= limit
    pairs = [np.stack([a[near], b[near]])]
    for begin, k in zip(at[:-1][size > 2], size[size > 2], strict=True):
        own = prints[begin : begin + k]
        if found := forest(own, limit):
            pairs.append(own[np.array(found).T])
    a, b = np.concatenate(pairs, 1).view(np.int64)
    if len(a):
        yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])


def near_duplicates(docs: DataFrame, text: str = "text", size: int = SHINGLE, limit: int = DISTANCE) -> DataFrame:
    """`docs` without the text, with `print`, `root` (the component's smallest print) and `component_id`."""
    rows = cut_lineage(fingerprints(docs.drop("root", "component_id"), text, size))
    nodes = cut_lineage(rows.groupBy("print").agg(F.min("doc_id").alias("least")))
    roots = connected(links(nodes.select("print"), limit)).withColumnRenamed("node", "print")
    named = nodes.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut_lineage(named.join(ids, "root").select("print", "root", "component_id"))
    return rows.join(named, "print")


def one_of_each(docs: DataFrame, text: str = "text", size: int = SHINGLE, limit: int = DISTANCE) -> DataFrame:
    """The rows of `docs`, one for each component: its smallest doc_id, the first in the scan among equals.

    `docs` is a scan, so a row's number is the same each time it is read.
    """
    number = fresh(docs, "number")
    numbered = docs.withColumn(number, F.monotonically_increasing_id())
    rows = near_duplicates(numbered.select("doc_id", text, number), text, size, limit)
    first = (
        rows.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root")
        .agg(F.min(number).alias(number))
        .select(number)
    )
    return numbered.join(first, number, "left_semi").select(*docs.columns)
