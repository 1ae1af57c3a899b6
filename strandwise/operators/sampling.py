"""Seeded resampling, group splits and folds with exact quotas.

Random order comes from the md5 of seed and key, so a run can be repeated, and
checked by any SQL engine. Ranks inside a group are a global numbering minus
the group's start, so a group may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.plans.lineage import dense_index, rank_within

# Draws one row fans out to at a time.
DRAW_BLOCK = 10_000


def _hash(seed: int, *cols: str | Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *cols))


def _hash_number(digest: Column) -> Column:
    """First 60 bits of a digest as a non-negative BIGINT."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def latest_labels(meta: DataFrame) -> DataFrame:
    """One metadata row per accession (the largest by text) for look-ups."""
    others = [c for c in meta.columns if c != "accession"]
    return (
        meta.groupBy("accession")
        .agg(F.max(F.struct(*others)).alias("_m"))
        .select("accession", *[F.col(f"_m.{c}").alias(c) for c in others])
    )


def unlabelled(seqs: DataFrame, meta: DataFrame, key: str = "seq_id") -> DataFrame:
    """Records without a metadata row: report these before resampling."""
    return seqs.join(meta, seqs[key] == meta["accession"], "left_anti")


def _with_total(df: DataFrame, totals: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Add a total per `by` group, or the single overall total."""
    return df.join(totals, list(by)) if by else df.withColumn(name, totals.select(name).scalar())


def stratum_quotas(
    df: DataFrame, n: int, strata: str, seed: int, by: Sequence[str] = ()
) -> DataFrame:
    """`by..., strata, size, quota`: n draws shared out by group size.

    Largest remainders get the left-over draws, ties in seeded random order.
    """
    by = list(by)
    sizes = df.groupBy(*by, strata).agg(F.count("*").alias("size"))
    totals = sizes.groupBy(*by).agg(F.sum("size").alias("_total"))
    shared = _with_total(sizes, totals, by, "_total").select(
        *by,
        strata,
        "size",
        F.floor(F.lit(n) * F.col("size") / F.col("_total")).cast("bigint").alias("_base"),
        (-((F.lit(n) * F.col("size")) % F.col("_total"))).alias("_rest"),
        _hash(seed, F.col(strata).cast("string")).alias("_h"),
    )
    ranked = rank_within(shared, by, ["_rest", "_h"], "_rank")
    used = ranked.groupBy(*by).agg((F.lit(n) - F.sum("_base")).alias("_left"))
    ranked = _with_total(ranked, used, by, "_left")
    extra = (F.col("_rank") < F.col("_left")).cast("bigint")
    return ranked.select(*by, strata, "size", (F.col("_base") + extra).alias("quota"))


def _draws(df: DataFrame, n: int, strata: str, key: str, seed: int, by: Sequence[str]) -> DataFrame:
    """`by..., strata, key, draw_no`: the n draws (per `by` group), without the rows' other columns."""
    groups = [*by, strata]
    members = df.select(*groups, key).withColumn("_h", _hash(seed, F.col(key).cast("string")))
    ranked = rank_within(members, groups, ["_h", key], "_rank").drop("_h")
    quotas = stratum_quotas(df, n, strata, seed, by).filter("quota > 0")
    blocks = quotas.select(
        *groups, "size", "quota",
        F.explode(
            F.sequence(F.lit(0), F.floor((F.col("quota") - 1) / DRAW_BLOCK).cast("bigint"))
        ).alias("_block"),
    ).repartition(*groups, "_block")
    first = F.col("_block") * DRAW_BLOCK
    last = F.least(first + DRAW_BLOCK, F.col("quota"))
    draws = blocks.select(*groups, "size", F.explode(F.sequence(first + 1, last)).alias("draw_no"))
    digest = _hash(seed, F.col(strata).cast("string"), F.col("draw_no").cast("string"))
    picks = draws.select(
        *groups, "draw_no", F.pmod(_hash_number(digest), F.col("size")).alias("_rank")
    )
    return picks.join(ranked, [*groups, "_rank"]).select(*groups, key, "draw_no")


def stratified_resample(
    df: DataFrame, n: int, strata: str, key: str, seed: int, by: Sequence[str] = ()
) -> DataFrame:
    """n rows drawn with replacement (per `by` group), strata in proportion.

    Adds `draw_no`, the draw's number inside its stratum; rows drawn twice stay
    apart through it. `key` names one row inside each `by` group.
    """
    return _draws(df, n, strata, key, seed, by).join(df, [*by, strata, key])


def resample_weights(
    df: DataFrame, n: int, strata: str, key: str, seed: int, by: Sequence[str] = ()
) -> DataFrame:
    """`by..., strata, key, weight`: how often the same draws take each row.

    Whatever counts a drawn row once a draw can count the row once and add its
    weight, so drawn rows need no copies. Rows that no draw takes are absent.
    """
    drawn = _draws(df, n, strata, key, seed, by)
    return drawn.groupBy(*by, strata, key).agg(F.count("*").alias("weight"))


def group_shuffle_split(
    df: DataFrame, groups: str, n_splits: int = 100, test_size: float = 0.1, seed: int = 0
) -> DataFrame:
    """`split, groups, is_test`: a random share of the groups is held out per split.

    Works on groups, not rows: `ceil(test_size * number of groups)` go to the
    test side, and no group is on both sides of a split.
    """
    names = df.select(groups).distinct()
    total = names.agg(F.count("*").alias("n"))
    tagged = names.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    tagged = tagged.withColumn("_h", _hash(seed, F.col("split").cast("string"), F.col(groups)))
    # Each split numbers all groups, so a rank is the global number modulo their count.
    ordered = dense_index(tagged, ["split", "_h", groups], "_idx")
    held_out = F.ceil(F.lit(float(test_size)) * total.scalar())
    rank = F.col("_idx") - F.col("split") * total.scalar()
    return ordered.select("split", groups, (rank < held_out).alias("is_test"))


def stratified_kfold(
    df: DataFrame, label: str, key: str, folds: int = 5, seed: int = 0
) -> DataFrame:
    """Add `fold`: rows of each label dealt out in seeded random order."""
    tagged = df.withColumn("_h", _hash(seed, F.col(key).cast("string")))
    ranked = rank_within(tagged, [label], ["_h", key], "_rank")
    return ranked.withColumn("fold", (F.col("_rank") % folds).cast("int")).drop("_h", "_rank")
