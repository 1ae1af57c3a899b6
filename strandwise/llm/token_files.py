"""Token ids as Arrow files of fixed-size lists, with zero-copy access to sequences and masks.

Documents are range-partitioned by id; each task encodes its stretch and writes
two Arrow files: sequences of `LENGTH` ids with their masks, in record batches
of `BATCH` rows, and an index with the place of each document. All rows but the
last batch's have one size, so sequence i of a file is batch i // BATCH, row
i % BATCH, and a memory-mapped file gives it without a copy. Ids are stored in
the narrowest unsigned type that holds the vocabulary; a mask is LENGTH / 8
bytes, one bit an id, lowest first, 0 for padding at the end of a file.

Only a row a file comes to the driver: its path and counts. A task that runs
again writes under a new name, and the names that count are those that the
finished tasks returned.

Defined results: a null or empty text is its end id alone. Documents with the
same doc_id are ordered by text; a null doc_id comes first. Without documents
there are no files and no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.common import extended, pieces, slots
from strandwise.llm.tokens import encoder

LENGTH = 1024
BATCH = 64
END = 2


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI that all executors reach, and the path in it."""
    if re.match(r"file:/|/", path):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


class _Writer:
    """Appends ids and writes full record batches."""

    def __init__(self, sink, kind: np.dtype, length: int, batch: int):
        self.kind, self.length, self.size = kind, length, length * batch
        row = pa.list_(pa.from_numpy_dtype(kind), length)
        self.schema = pa.schema([("ids", row), ("mask", pa.binary(length // 8))])
        self.out = ipc.new_file(sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.waiting = 0

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids.astype(self.kind))
        self.waiting += len(ids)
        if self.waiting >= self.size:
            whole = np.concatenate(self.parts)
            end = len(whole) // self.size * self.size
            for at in range(0, end, self.size):
                self._write(whole[at : at + self.size])
            self.parts, self.waiting = [whole[end:]], len(whole) - end

    def _write(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        padded = np.zeros(rows * self.length, self.kind)
        padded[: len(ids)] = ids
        mask = np.packbits(np.arange(len(padded)) < len(ids), bitorder="little")
        lists = pa.FixedSizeListArray.from_arrays(pa.array(padded), self.length)
        masks = pa.FixedSizeBinaryArray.from_buffers(pa.binary(self.length // 8), rows, [None, pa.py_buffer(mask)])
        self.out.write_batch(pa.record_batch([lists, masks], schema=self.schema))

    def close(self) -> None:
        if self.waiting:
            self._write(np.concatenate(self.parts))
        self.out.close()


class TokenFile:
    """One file of sequences, opened for random access."""

    def __init__(self, path: str):
        where, inside = filesystem(path)
        source = pa.memory_map(inside) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(inside)
        self.reader = ipc.open_file(source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.rows = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask bits (packed) of sequence i, as views of the file."""
        batch = self.reader.get_batch(i // self.rows)
        at = i % self.rows
        ids = batch.column(0).flatten().to_numpy()[at * self.length : (at + 1) * self.length]
        mask = np.frombuffer(batch.column(1).buffers()[1], np.uint8).reshape(-1, self.length // 8)[at]
        return ids, mask

    def span(self, start: int, stop: int) -> np.ndarray:
        """The ids of a stretch of the file."""
        size = self.rows * self.length
        parts = []
        while start < stop:
            flat = self.reader.get_batch(start // size).column(0).flatten().to_numpy()
            at = start % size
            parts.append(flat[at : at + stop - start])
            start += len(parts[-1])
        return np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def write_token_files(
    docs: DataFrame,
    path: str,
    folder: str,
    text: str = "text",
    end: int = END,
    length: int = LENGTH,
    batch: int = BATCH,
) -> list[dict]:
    """Write all documents; returns for each file, in order: sequences, index, n_tokens, start."""
    n = slots(docs.sparkSession)
    rows = (
        docs.select("doc_id", F.col(text).cast("string").alias(text))
        .repartitionByRange(n, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), text)
    )
    run_id = uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        kind = np.dtype(np.uint16 if own.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        tail = np.array([end], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        where, inside = filesystem(folder)
        name = f"{inside}/{run_id}-{part:06d}-{uuid4().hex}"
        writer = index = None
        total = 0
        for whole in batches:
            for batch_ in pieces(whole, text):
                if writer is None:
                    where.create_dir(inside, recursive=True)
                    files = [where.open_output_stream(f"{name}{x}.arrow") for x in ("", ".docs")]
                    writer, index = _Writer(files[0], kind, length, batch), ipc.new_file(files[1], index_schema(batch_))
                starts, counts = [], []
                for t in batch_.column(text).to_pylist():
                    ids = np.frombuffer(own.encode(t or "") + tail, "<u4")
                    writer.add(ids)
                    starts.append(total)
                    counts.append(len(ids))
                    total += len(ids)
                index.write_batch(
                    pa.record_batch([batch_.column("doc_id"), pa.array(starts), pa.array(counts)], schema=index_schema(batch_))
                )
        if writer is not None:
            writer.close()
            index.close()
            for f in files:
                f.close()
            yield pa.record_batch(
                [pa.array([part]), pa.array([f"{name}.arrow"]), pa.array([f"{name}.docs.arrow"]), pa.array([total])],
                ["part", "sequences", "index", "n_tokens"],
            )

    found = rows.mapInArrow(run, "part long, sequences string, index string, n_tokens long").collect()
    out, start = [], 0
    for r in sorted(found, key=lambda r: r["part"]):
        out.append({"sequences": r["sequences"], "index": r["index"], "n_tokens": r["n_tokens"], "start": start})
        start += r["n_tokens"]
    return out


def index_schema(batch: pa.RecordBatch) -> pa.Schema:
    return pa.schema([batch.schema.field("doc_id"), ("start", pa.int64()), ("n_tokens", pa.int64())])


def read_documents(spark: SparkSession, files: list[dict], like: DataFrame, folder: str) -> DataFrame:
    """Per document from the files: doc_id, start among all ids, n_tokens and ids_crc32."""
    plain = filesystem(folder)[0]
    prefix = "" if isinstance(plain, fs.LocalFileSystem) else re.match(r"\w+://", folder)[0]
    listed = spark.createDataFrame(
        [(prefix + f["sequences"], prefix + f["index"], f["start"]) for f in files],
        "sequences string, index string, base long",
    ).repartition(max(len(files), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row in whole.to_pylist():
                tokens = TokenFile(row["sequences"])
                where, inside = filesystem(row["index"])
                index = ipc.open_file(where.open_input_file(inside))
                for k in range(index.num_record_batches):
                    b = index.get_batch(k)
                    starts, counts = b.column("start").to_numpy(), b.column("n_tokens").to_numpy()
                    crc = [
                        crc32(tokens.span(s, s + n).astype("<u4").tobytes())
                        for s, n in zip(starts.tolist(), counts.tolist(), strict=True)
                    ]
                    yield pa.record_batch(
                        [b.column("doc_id"), pa.array(starts + row["base"]), b.column("n_tokens"), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return listed.mapInArrow(run, extended(like.select("doc_id"), "start long, n_tokens long, ids_crc32 long"))
