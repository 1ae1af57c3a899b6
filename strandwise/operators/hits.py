"""Mapping IUPAC motifs onto sequences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions.nucleotide import PATTERN_BASES, motif_regex, pattern_bases
from strandwise.functions.scoring import bed_score
from strandwise.operators.codes import MAX_K, look_up
from strandwise.operators.windows import (
    tile_sequences,
    tile_starts,
    window_position,
    window_text,
)
from strandwise.plans.lineage import BROADCAST_ROWS, cut_lineage

MAX_EXPAND = 4096


def _letters(c: Column | str) -> Column:
    return F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))


def _choices(letters: Column) -> Column:
    """How many concrete k-mers a list of motif letters stands for."""
    sizes = F.map_from_arrays(
        F.lit(list(PATTERN_BASES)), F.lit([float(len(v)) for v in PATTERN_BASES.values()])
    )
    return F.aggregate(
        letters, F.lit(1.0), lambda acc, x: acc * F.coalesce(F.element_at(sizes, x), F.lit(1.0))
    )


def motif_anchors(motifs: DataFrame, max_expand: int = MAX_EXPAND) -> DataFrame:
    """`motif, width, offset, size, choices`: the part of each motif to look up.

    A motif with at most `max_expand` concrete k-mers is looked up whole. Of a
    wider one the longest segment that stays within the limit is looked up, and
    the rest is verified on the windows the segment finds.
    """
    # One letter must always fit, so that every motif has an anchor.
    max_expand = max(max_expand, 4)
    base = motifs.select("motif").distinct().withColumn("letters", _letters("motif"))
    width = F.size("letters")
    segments = (
        base.filter(_choices(F.col("letters")) > max_expand)
        .select("motif", "letters", F.explode(F.sequence(F.lit(1), width)).alias("first"))
        .select(
            "motif", "letters", "first",
            F.explode(F.sequence(F.lit(1), width - F.col("first") + 1)).alias("size"),
        )
        .withColumn("choices", _choices(F.slice("letters", F.col("first"), F.col("size"))))
        .filter(F.col("choices") <= max_expand)
        .groupBy("motif")
        .agg(F.max(F.struct("size", -F.col("first"), "choices")).alias("best"))
        .select(
            "motif",
            F.length("motif").alias("width"),
            (-F.col("best.col2") - 1).alias("offset"),
            F.col("best.size").alias("size"),
            F.col("best.choices").alias("choices"),
        )
    )
    whole = base.filter(_choices(F.col("letters")) <= max_expand).select(
        "motif",
        width.alias("width"),
        F.lit(0).alias("offset"),
        width.alias("size"),
        _choices(F.col("letters")).alias("choices"),
    )
    return whole.unionByName(segments)


def expand_anchors(anchors: DataFrame) -> DataFrame:
    """One row per concrete text of each anchor, under the column `anchor`."""
    segment = F.slice(_letters("motif"), F.col("offset") + 1, F.col("size"))
    texts = F.aggregate(
        segment,
        F.array(F.lit("")),
        lambda acc, x: F.flatten(
            F.transform(acc, lambda p: F.transform(pattern_bases(x), lambda b: F.concat(p, b)))
        ),
    )
    return anchors.select(
        "motif", "width", "offset", "size", F.explode(texts).alias("anchor")
    )


def _anchor_codes(anchors: DataFrame, shapes: list[tuple[int, int, int]]) -> list[np.ndarray]:
    """For each shape the codes of its anchors' concrete texts (their first MAX_K letters)."""
    digits = {x: np.array(["ACGT".index(b) for b in bases]) for x, bases in PATTERN_BASES.items()}
    found: dict[tuple[int, int, int], list[np.ndarray]] = {s: [] for s in shapes}
    table = anchors.select("motif", "width", "offset", "size").toArrow().to_pydict()
    for motif, *shape in zip(table["motif"], table["width"], table["offset"], table["size"]):
        codes = np.zeros(1, np.int64)
        # Unknown letters are left to `expand_anchors`, which raises an error.
        for x in motif[shape[1] : shape[1] + min(shape[2], MAX_K)]:
            codes = (codes[:, None] << 2 | digits.get(x, digits["A"])).ravel()
        found[tuple(shape)].append(codes)
    return [np.unique(np.concatenate(found[s])) for s in shapes]


def motif_hits(
    seqs: DataFrame,
    motifs: DataFrame,
    key: str = "seq_id",
    max_expand: int = MAX_EXPAND,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """`key, motif, pos`: all overlapping forward-strand hits, 0-based.

    Matching is case-sensitive and letters outside ACGT match nothing. Every
    window is looked up in the table of concrete anchor texts by equality. The
    number of those texts is computed first: up to `broadcast_rows` of them are
    broadcast, and tasks only hand on the windows whose code is among them;
    beyond that Spark shuffles the windows.
    """
    # Written, since planning needs its shapes and size; one row per motif.
    anchors = cut_lineage(motif_anchors(motifs, max_expand))
    shapes = (
        anchors.groupBy("width", "offset", "size").agg(F.sum("choices").alias("n")).collect()
    )
    table = expand_anchors(anchors)
    if not shapes:
        return seqs.select(key, F.lit("").alias("motif"), F.lit(0).cast("bigint").alias("pos")).limit(0)
    if sum(s["n"] for s in shapes) <= broadcast_rows:
        known = [(s["width"], s["offset"], s["size"]) for s in shapes]
        windows = look_up(seqs, key, known, _anchor_codes(anchors, known))
        windows = windows.withColumn("anchor", F.substr("text", F.col("offset") + 1, F.col("size")))
        table = F.broadcast(table)
    else:
        windows = _all_windows(seqs, key, shapes)
    found = windows.join(table, ["width", "offset", "size", "anchor"])
    if any(s["size"] < s["width"] for s in shapes):
        matches = F.call_function("rlike", F.col("text"), F.concat(F.lit("^"), motif_regex("motif"), F.lit("$")))
        found = found.filter((F.col("size") == F.col("width")) | matches)
    return found.select(key, "motif", "pos")


def _all_windows(seqs: DataFrame, key: str, shapes: list) -> DataFrame:
    """`key, pos, width, offset, size, anchor, text`: every window of every shape."""
    widest = max(s["width"] for s in shapes)
    narrowest = min(s["width"] for s in shapes)
    starts = tile_sequences(seqs, widest, [key]).select(
        key, "tile_no", "tile", F.explode(tile_starts(narrowest)).alias("i")
    )
    probes = [
        F.struct(
            F.lit(s["width"]).alias("width"),
            F.lit(s["offset"]).alias("offset"),
            F.lit(s["size"]).alias("size"),
            window_text("tile", F.col("i") + s["offset"], s["size"]).alias("anchor"),
            # The whole window is only verified where its anchor is a part of it.
            window_text("tile", F.col("i"), s["width"] if s["size"] < s["width"] else 0).alias("text"),
        )
        for s in shapes
    ]
    room = F.length("tile") - F.col("i") + 1
    return (
        starts.select(key, window_position(F.col("i")).alias("pos"), room.alias("room"), F.explode(F.array(*probes)).alias("p"))
        .filter(F.col("room") >= F.col("p.width"))
        .select(key, "pos", "p.*")
    )


def motif_score_table(hits: DataFrame, motifs: DataFrame, seqs: DataFrame) -> DataFrame:
    """`motif, setcompletion, total_score` for every motif, zero-hit ones too.

    `setcompletion` is the share of all distinct sequences that hold the motif.
    """
    total = seqs.agg(F.count_distinct("seq_id").alias("n"))
    found = hits.select("motif", "seq_id").distinct().groupBy("motif").agg(
        F.count("*").alias("n_hit")
    )
    share = F.coalesce("n_hit", F.lit(0)) / total.scalar()
    return (
        motifs.select("motif")
        .distinct()
        .join(found, "motif", "left")
        .withColumn("setcompletion", share)
        .select("motif", "setcompletion", bed_score("setcompletion").alias("total_score"))
    )


def motif_bed(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """BED rows `chr, start, end, name, score` of all hits."""
    return hits.join(scores.select("motif", "total_score"), "motif").select(
        F.col("seq_id").alias("chr"),
        F.col("pos").cast("int").alias("start"),
        (F.col("pos") + F.length("motif")).cast("int").alias("end"),
        F.col("motif").alias("name"),
        F.col("total_score").alias("score"),
    )
