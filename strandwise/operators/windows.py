"""Sliding windows over sequences.

Sequences are ASCII. Windows are cut from bytes: `substr` on text would count
characters from the start of the tile for every window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions.nucleotide import reverse_complement

TILE = 1024


def tile_sequences(
    df: DataFrame, width: int, keep: Sequence[str], seq: str | Column = "seq"
) -> DataFrame:
    """Cut each sequence into overlapping tiles: `keep..., tile_no, tile`.

    A tile owns `TILE` window starts and carries `width - 1` further letters.
    Tiles bound what one row fans out to at a time, however long the sequence;
    one regex pass cuts them all.
    """
    pattern = f"(?s)(?=(.{{1,{TILE + width - 1}}})).{{1,{TILE}}}"
    tiles = F.regexp_extract_all(seq, F.lit(pattern), F.lit(1))
    cut = df.select(*keep, F.posexplode(tiles).alias("tile_no", "tile"))
    return cut.withColumn("tile", F.col("tile").cast("binary"))


def window_text(tile: str, start: Column, size: int | Column) -> Column:
    """`size` letters of a tile from a 1-based start."""
    return F.substr(tile, start, F.lit(size) if isinstance(size, int) else size).cast("string")


def tile_starts(width: int | Column) -> Column:
    """1-based window starts of a tile (empty when no window fits)."""
    n = F.least(F.length("tile") - width + 1, F.lit(TILE))
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def window_position(i: Column) -> Column:
    return (F.col("tile_no").cast("bigint") * TILE + i - 1).cast("bigint")


def kmer_windows(
    seqs: DataFrame, k: int, include_last: bool = False, key: Sequence[str] = ("seq_id",)
) -> DataFrame:
    """`key..., pos, kmer`: windows of `k` letters with 0-based positions.

    By default the last window of each sequence is left out (`L - k` windows),
    which is what counting uses; `include_last` gives all `L - k + 1`.
    """
    return (
        _window_starts(seqs, k, include_last, key)
        .select(*key, "tile_no", "tile", F.explode(tile_starts(k)).alias("i"))
        .select(
            *key,
            window_position(F.col("i")).alias("pos"),
            window_text("tile", F.col("i"), k).alias("kmer"),
        )
    )


def strand_windows(
    seqs: DataFrame, k: int, include_last: bool = False, key: Sequence[str] = ("seq_id",)
) -> DataFrame:
    """`key..., lo, hi`: each window and its reverse complement, in text order.

    The tile is reverse-complemented once and both strands are cut from it.
    """
    n = F.length("tile")
    forward = window_text("tile", F.col("i"), k)
    backward = window_text("rc_tile", n - F.col("i") - (k - 2), k)
    return (
        _window_starts(seqs, k, include_last, key)
        .withColumn("rc_tile", reverse_complement(F.col("tile").cast("string")).cast("binary"))
        .select(*key, "tile", "rc_tile", F.explode(tile_starts(k)).alias("i"))
        .select(*key, forward.alias("fwd"), backward.alias("rev"))
        .select(*key, F.least("fwd", "rev").alias("lo"), F.greatest("fwd", "rev").alias("hi"))
    )


def _window_starts(
    seqs: DataFrame, k: int, include_last: bool, key: Sequence[str]
) -> DataFrame:
    seq: Column = F.col("seq")
    if not include_last:
        seq = F.substr(seq, F.lit(1), F.length(seq) - 1)
    return tile_sequences(seqs, k, key, seq)
