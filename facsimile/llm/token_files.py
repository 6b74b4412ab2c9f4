"""Token ids as Arrow files of equal-length sequences.

``write`` deals the documents out by id range (ties by text digest), sorts each
range and lets each task stream its ids into two Arrow IPC files:

* ``ids-N.arrow``: record batches of two fixed-size-list columns, ``ids``
  (16-bit, one list is one sequence) and ``mask`` (true for ids, false for the
  filling of a shard's last sequence). Row ``k`` is sequence ``k``, and its
  values are one contiguous run of the batch's buffer, so a memory-mapped
  reader gets any sequence as a view;
* ``docs-N.arrow``: doc_id, start (within the shard) and length of each
  document, in order.

A file is written under a name of its attempt and renamed when it is whole, so
a lost or repeated task leaves nothing half done. The driver keeps one row per
shard (number, path, ids). ``read_documents`` reads the files back, one task
per shard, batch by batch. Paths go through pyarrow's file systems, so the
shared folder may be a local, HDFS or object-store address.

Null text counts as empty (its only id is the end id). Null ids come first;
repeated ids and rows are separate documents, equal ids in the order of their
text digest. An empty table gives no shard. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facsimile.llm import tokens
from facsimile.llm.common import shared_path, ship, text_of
from facsimile.session import shuffle_partitions

SEQUENCES = 256  # in a record batch
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())])


def sequence_schema(length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint16(), length)), ("mask", pa.list_(pa.bool_(), length))])


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


class _SequenceWriter:
    """Streams 16-bit ids into batches of fixed-size lists."""

    def __init__(self, sink, length: int):
        self.length, self.schema = length, sequence_schema(length)
        self.out = ipc.new_file(sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.held = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= SEQUENCES * self.length:
            self._flush(SEQUENCES * self.length)

    def _flush(self, step: int) -> None:
        ids = np.concatenate(self.parts)
        at = 0
        while len(ids) - at >= step:
            self._batch(ids[at : at + step], step)
            at += step
        self.parts, self.held = [ids[at:].copy()], len(ids) - at

    def _batch(self, ids: np.ndarray, real: int) -> None:
        lists = pa.FixedSizeListArray.from_arrays(pa.array(ids, pa.uint16()), self.length)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(ids)) < real), self.length)
        self.out.write_batch(pa.RecordBatch.from_arrays([lists, mask], schema=self.schema))

    def close(self) -> None:
        if self.held:
            ids = np.concatenate(self.parts)
            self._batch(np.concatenate([ids, np.zeros(-len(ids) % self.length, np.uint16)]), len(ids))
        self.out.close()


def _write_shard(folder: str, length: int, vocabulary: str):
    def run(batches):
        where, base = file_system(folder)
        task = TaskContext.get()
        shard, tag = task.partitionId(), f"{task.partitionId():06d}-{task.taskAttemptId()}"
        n_docs = 0
        names = {kind: f"{base}/{kind}-{tag}.arrow" for kind in ("ids", "docs")}
        opened = []
        for batch in batches:
            if not opened and batch.num_rows:
                where.create_dir(base, recursive=True)
                opened = [where.open_output_stream(f"{n}.part") for n in names.values()]
                ids_out, docs_out = _SequenceWriter(opened[0], length), ipc.new_file(opened[1], DOCS)
            for at, texts in tokens.array_slices(batch, "text"):
                ids, places = tokens.encode_texts(vocabulary, texts)
                starts = ids_out.total + places[:-1]
                ids_out.add(ids)
                docs_out.write_batch(pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(texts)), pa.array(starts, pa.int64()), pa.array(np.diff(places), pa.int64())], schema=DOCS))
                n_docs += len(texts)
        if not opened:
            return
        ids_out.close()
        docs_out.close()
        for stream, name in zip(opened, names.values()):
            stream.close()
            where.move(f"{name}.part", name)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "tag": [tag], "n_ids": [ids_out.total], "n_docs": [n_docs]})

    return run


def write(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, vocabulary: str | None = None) -> list[dict]:
    """Write the files; one dict per shard in order: tag, n_ids, n_docs, first id's place ``start``, ``folder``."""
    spark = docs.sparkSession
    ship(spark)
    folder = folder or shared_path(spark, "token-files")
    slim = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), text_of(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = slim.repartitionByRange(shuffle_partitions(spark), F.asc_nulls_first("id"), "tie").sortWithinPartitions(F.asc_nulls_first("id"), "tie")
    found = ordered.select("id", "text").mapInArrow(_write_shard(folder, length, vocabulary or tokens.default_vocabulary()), "shard bigint, tag string, n_ids bigint, n_docs bigint")
    out, start = [], 0
    for r in sorted(found.collect(), key=lambda r: r.shard):
        out.append({"tag": r.tag, "n_ids": r.n_ids, "n_docs": r.n_docs, "start": start, "folder": folder})
        start += r.n_ids
    return out


def open_shard(folder: str, tag: str) -> tuple[ipc.RecordBatchFileReader, ipc.RecordBatchFileReader]:
    """Readers of a shard's sequences and documents; memory-mapped where the file system is local."""
    where, base = file_system(folder)
    local = isinstance(where, fs.LocalFileSystem)
    names = [f"{base}/{kind}-{tag}.arrow" for kind in ("ids", "docs")]
    return tuple(ipc.open_file(pa.memory_map(n) if local else where.open_input_file(n)) for n in names)


def sequence(reader: ipc.RecordBatchFileReader, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
    """Ids and mask of sequence ``k`` of a shard, both views of the file's buffers.

    The mask stays an Arrow array: its bits are packed, so numpy could only copy it.
    """
    batch = reader.get_batch(k // SEQUENCES)
    length = batch.schema.field("ids").type.list_size
    at = k % SEQUENCES * length
    ids = batch.column("ids").values.to_numpy(zero_copy_only=True)[at : at + length]
    return ids, batch.column("mask").values.slice(at, length)


def _runs(reader: ipc.RecordBatchFileReader) -> Iterator[np.ndarray]:
    """The real ids of each batch of sequences."""
    for i in range(reader.num_record_batches):
        batch = reader.get_batch(i)
        yield batch.column("ids").values.to_numpy(zero_copy_only=True)[: batch.column("mask").values.true_count]


def _read_shards(batches):
    for batch in batches:
        for row in batch.to_pylist():
            sequences, docs = open_shard(row["folder"], row["tag"])
            runs, held, base = _runs(sequences), np.zeros(0, np.uint16), 0
            for i in range(docs.num_record_batches):
                part = docs.get_batch(i)
                ids, starts, lengths = (part.column(c).to_pylist() for c in ("doc_id", "start", "length"))
                at = 0
                while at < len(ids):  # some documents at a time
                    to, size = at, 0
                    while to < len(ids) and size < 1 << 21:
                        size += lengths[to]
                        to += 1
                    end = starts[to - 1] + lengths[to - 1]
                    while base + len(held) < end:
                        held = np.concatenate([held, next(runs)])
                    values = [held[s - base : s - base + n].astype("<u4").tobytes() for s, n in zip(starts[at:to], lengths[at:to])]
                    held, base = held[end - base :], end
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[at:to], pa.int64()), pa.array([row["start"] + s for s in starts[at:to]], pa.int64()), pa.array(lengths[at:to], pa.int64()), pa.array(values, pa.binary())],
                        ["id", "start", "n_tokens", "ids"],
                    )
                    at = to


def read_documents(spark: SparkSession, shards: list[dict]) -> DataFrame:
    """(id, start, n_tokens, ids) of every document, read back from the files.

    ``ids`` are little-endian unsigned 32-bit integers. One task per shard.
    """
    ship(spark)
    listed = spark.createDataFrame([(s["folder"], s["tag"], s["start"]) for s in shards], "folder string, tag string, start bigint")
    return listed.repartition(max(1, len(shards))).mapInArrow(_read_shards, "id bigint, start bigint, n_tokens bigint, ids binary")
