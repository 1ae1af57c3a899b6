"""Lineage cuts, dense numbering and size checks shared by the operators."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a broadcast side may hold; at about 100 bytes a row this stays near 100 MB.
BROADCAST_ROWS = 1_000_000
# Partitions per file split of records that are cut into windows: a 128 MB split
# becomes pieces of about 32 MB, which a task sorts by record in memory.
FAN_OUT = 4


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, from `spark.checkpoint.dir`.

    Only a local session may fall back on a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strandwise-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and go on from the written rows.

    A written table survives lost executors, tells Catalyst its true size, and
    unlike a checkpoint carries no plan constraints over, which would pile up
    from round to round of an iteration.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove a table of `cut_lineage` that nothing unwritten reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.rsplit("/", 1)[-1].startswith("table-"):
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def freeze_partitions(df: DataFrame) -> DataFrame:
    """Checkpoint `df`, so that its partitions and their row order stay fixed."""
    sc = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def dense_index(df: DataFrame, order: Sequence[str | Column], name: str = "idx") -> DataFrame:
    """Number all rows 0..n-1 in the given order, without a one-task window.

    Rows are range-partitioned and sorted, written once so that the partitions
    cannot change any more, and numbered inside each partition; only one row
    count per partition reaches the driver.
    """
    ranged = freeze_partitions(df.repartitionByRange(*order).sortWithinPartitions(*order))
    in_part = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", in_part)
    sizes = {
        r["_part"]: r["n"] for r in numbered.groupBy("_part").agg(F.count("*").alias("n")).collect()
    }
    offsets, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        offsets.append(total)
        total += sizes.get(part, 0)
    if not offsets:
        return ranged.withColumn(name, F.lit(0).cast("bigint"))
    start = F.element_at(F.lit(offsets).cast("array<bigint>"), F.col("_part") + 1)
    return numbered.withColumn(name, start + F.col("_row")).drop("_part", "_row")


def rank_within(df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """0-based rank of each row inside its group, whatever the group's size.

    One global numbering, minus the smallest number of the group.
    """
    groups = list(groups)
    indexed = dense_index(df, [*groups, *order], "_idx")
    if not groups:
        return indexed.withColumnRenamed("_idx", name)
    # Few groups are broadcast, so a group with most of the rows is not shuffled
    # as one key; many groups make none of them large against the rest, and
    # adaptive skew handling covers what is left.
    starts = indexed.groupBy(*groups).agg(F.min("_idx").alias("_start"))
    joined = indexed.join(broadcast_if_small(starts), groups)
    return joined.withColumn(name, F.col("_idx") - F.col("_start")).drop("_idx", "_start")


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after counting that `df` has at most `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """Repartition a scan only if its splits are fewer than the task slots."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots * 4)


def by_record(df: DataFrame, *key: str, splits: int = 0) -> DataFrame:
    """Hash-partition records by their key, ahead of a fan-out to windows.

    The number of partitions is fixed, because adaptive coalescing would size
    them by the short records and not by the windows they fan out to. `splits`
    is the number of file splits behind `df`, where known: each one is cut into
    `FAN_OUT` partitions. Otherwise `spark.sql.shuffle.partitions` decides.
    """
    spark = df.sparkSession
    n = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        spark.sparkContext.defaultParallelism * 4,
        splits * FAN_OUT,
    )
    return df.repartition(n, *key)
