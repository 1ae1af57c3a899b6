"""Helpers shared by the text operators: Arrow buffers, written tables, row keys."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwise.plans.lineage import cut_lineage, shared_folder

#: Text bytes that one vectorised step handles at once; longer texts go alone.
STEP_BYTES = 8 << 20
#: The separators of the word rule `[^\x20\x09-\x0D]+`; `bytes.split()` uses the same six.
SPACES = b" \t\n\v\f\r"

__all__ = [
    "SPACES", "STEP_BYTES", "byte_view", "cut_lineage", "documents", "drop_table", "extended", "fresh", "held",
    "id_remainder", "lower_ascii", "pieces", "shared_folder", "slots", "spread_scan", "texts_of",
]


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def slots(spark: SparkSession) -> int:
    """Partitions for a shuffle: the session's number, which a cluster sizes by its input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def held(column: str, mod: int, remainder: int) -> Column:
    """True where crc32(id as text) mod `mod` is `remainder`; a null id counts as text ''."""
    return id_remainder(column, mod) == remainder


def id_remainder(column: str, mod: int) -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is the empty text."""
    return [t if t is not None else b"" for t in column.cast(pa.binary()).to_pylist()]


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All text bytes of an Arrow column, and the n + 1 offsets of its rows."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `limit` text bytes each, or one longer text."""
    if not batch.num_rows:
        return
    _, at = byte_view(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(at, at[begin] + limit, "right")) - 1
        end = max(end, begin + 1)
        yield batch.slice(begin, end - begin)
        begin = end


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def lower_ascii(text: bytes) -> bytes:
    return text.translate(_LOWER)


def spread_scan(df: DataFrame) -> DataFrame:
    """Deal a scan out over all cores if its files make fewer splits than that."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores * 2)


def drop_table(df: DataFrame) -> None:
    """Remove a table of `cut_lineage` whose readers have all been written."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    paths = {m[1] for f in df.inputFiles() if (m := re.match(r"(.*/table-[0-9a-f]{32})/", f))}
    for path in paths:
        if path.split("/table-")[0].rstrip("/").endswith(re.sub(r"^\w+:/*", "/", folder).rstrip("/")):
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def extended(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of `df` with further fields."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])
