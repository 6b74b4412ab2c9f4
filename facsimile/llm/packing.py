"""Packing documents into fixed-size sequences by minimum bin slack.

A document's ids are cut into whole sequences of ``capacity`` and a rest. Only
the number of rests of each length matters for the packing, and there are at
most ``capacity - 1`` lengths whatever the corpus, so the plan is made from
that histogram. Each window starts with the longest length left; a subset-sum
dynamic program over bitsets (bit s: some multiset of the remaining lengths
sums to s, counts taken in binary parts) finds the multiset that fills the
window closest to capacity, and walking back through the bitsets gives its
counts. The window is repeated as often as the counts allow. If the best sum
leaves slack, one further rest is cut to fill it and its remainder returns to
the lengths left, so only the very last sequence is ever padded.

The plan speaks of the r-th rest of a length. Ranks are distributed: each
task counts its own rests of each length while it encodes; the per-task
counts are summed up over tasks. No length class is ever gathered or sorted in
one place. The sums are files of ``TASKS`` tasks each in the shared folder, and
a task that places documents reads those of the tasks that encoded them: the
ids are neither shuffled nor joined, and nothing grows on the driver.

Null text counts as empty: its only id is the end id. Repeated rows and ids
are separate documents. An empty table gives an empty table. Other columns of
the input are not read.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facsimile.llm import tokens
from facsimile.llm.common import shared_path, ship, text_of, written
from facsimile.llm.token_files import file_system

TASKS = 256  # tasks whose offsets are in one file


def fill_window(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths (length -> copies) with the largest sum up to ``capacity``.

    The longest length in ``counts`` is always part of it.
    """
    first = max(counts)
    room = capacity - first
    reach, mask = 1, (1 << room + 1) - 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == first), room // length)
        part = 1
        while left > 0 and not reach >> room & 1:
            k = min(part, left)
            steps.append((length, k, reach))
            reach |= reach << length * k & mask
            left -= k
            part *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used = {first: 1}
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + k
            total -= length * k
    return used


def plan_windows(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Where each rest goes: rows (length, rank_from, rank_to, start, size, first, copies, sequence, offset).

    The rests of ``length`` with rank in [rank_from, rank_to) give a part
    [start, start + size); the part of rank r is number n = first + r -
    rank_from of its kind and lies in sequence ``sequence + n // copies`` at
    ``offset + n % copies * size``. Also the number of sequences.
    """
    left = {n: c for n, c in histogram.items() if c}
    lots = {n: deque([(n, 0, c, 0)]) for n, c in left.items()}  # (length, rank_from, count, start)
    rows: list[tuple[int, ...]] = []
    sequences = 0

    def take(size: int, count: int):
        first = 0
        while count:
            length, rank, have, start = lots[size].popleft()
            n = min(have, count)
            if n < have:
                lots[size].appendleft((length, rank + n, have - n, start))
            yield length, rank, n, start, first
            first += n
            count -= n

    def spend(size: int, count: int):
        left[size] -= count
        if not left[size]:
            del left[size]

    while left:
        used = fill_window(left, capacity)
        repeat = min(left[n] // k for n, k in used.items())
        full = sum(n * k for n, k in used.items())
        slack = capacity - full
        donor = 0
        if slack:
            spare = {n: c // (used.get(n, 0) + 1) for n, c in left.items() if n > slack and c > used.get(n, 0)}
            if spare:
                donor = max(spare, key=lambda n: (min(spare[n], repeat), n))
                repeat = min(repeat, spare[donor])
            elif repeat > 1:  # all that is left goes into such windows: some of them are cut up to fill the others
                donor = max((n for n in left if n > slack), default=0)
                repeat = max(1, min(repeat - 1, left[donor] // (used.get(donor, 0) + 1))) if donor else repeat
        offset = 0
        for size, copies in sorted(used.items(), reverse=True):
            for length, rank, n, start, first in take(size, repeat * copies):
                rows.append((length, rank, rank + n, start, size, first, copies, sequences, offset))
            spend(size, repeat * copies)
            offset += size * copies
        if donor:
            for length, rank, n, start, first in list(take(donor, repeat)):
                rows.append((length, rank, rank + n, start, slack, first, 1, sequences, offset))
                lots.setdefault(donor - slack, deque()).append((length, rank, n, start + slack))
            spend(donor, repeat)
            left[donor - slack] = left.get(donor - slack, 0) + repeat
        sequences += repeat
    return np.array(sorted(rows), np.int64).reshape(-1, 9), sequences


def _encode(path: str, capacity: int):
    def run(batches):
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            for at, texts in tokens.array_slices(batch, "text"):
                ids, places = tokens.encode_texts(path, texts)
                ranks, wholes, sizes = [], [], np.diff(places)
                for n in sizes.tolist():
                    wholes.append(seen[capacity])
                    seen[capacity] += n // capacity
                    ranks.append(seen[n % capacity])
                    seen[n % capacity] += 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, len(texts)), pa.array([task] * len(texts), pa.int64()), pa.array(sizes, pa.int64()), pa.array(wholes, pa.int64()), pa.array(ranks, pa.int64()), tokens.binary_array(ids.view(np.uint8), 2 * places).cast(pa.binary())],
                    ["id", "task", "n", "whole", "rank", "ids"],
                )

    return run


def _offsets(folder: str, capacity: int):
    """Look-up of a task's offsets: how many rests of each length (at ``capacity``: whole sequences) earlier tasks have."""
    known: dict[int, np.ndarray] = {}

    def run(task: int) -> np.ndarray:
        if task not in known:
            known.clear()
            where, base = file_system(folder)
            found = pq.read_table(f"{base}/block={task // TASKS}", filesystem=where, columns=["task", "offsets"])
            for t, rows in zip(found["task"].to_pylist(), found["offsets"].to_pylist()):
                known[t] = np.zeros(capacity + 1, np.int64)
                for r in rows:
                    known[t][r["length"]] = r["off"]
        return known[task]

    return run


def _place(plan: np.ndarray, sequences: int, capacity: int, folder: str):
    bounds = np.searchsorted(plan[:, 0], np.arange(capacity + 1)) if len(plan) else np.zeros(capacity + 1, np.int64)

    def run(batches):
        offsets = _offsets(folder, capacity)
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for doc, task, n, whole, rank, ids in zip(*(batch.column(c).to_pylist() for c in ("id", "task", "n", "whole", "rank", "ids"))):
                ids = np.frombuffer(ids, "<u2").astype("<u4")
                rest, before = n % capacity, offsets(task)
                whole, rank = whole + int(before[capacity]), rank + int(before[rest])
                for k in range(n // capacity):
                    out.append((doc, k * capacity, capacity, n, sequences + whole + k, 0, ids[k * capacity : (k + 1) * capacity].tobytes()))
                if rest:
                    mine = plan[bounds[rest] : bounds[rest + 1] if rest + 1 < len(bounds) else len(plan)]
                    for _, low, _, start, part, first, copies, sequence, offset in mine[(mine[:, 1] <= rank) & (rank < mine[:, 2])].tolist():
                        at = n - rest + start
                        number = first + rank - low
                        out.append((doc, at, part, n, sequence + number // copies, offset + number % copies * part, ids[at : at + part].tobytes()))
                size += n
                if size >= 1 << 21:
                    yield _pieces(out)
                    out, size = [], 0
            yield _pieces(out)

    return run


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.binary()]
    names = ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: (id, start, length, doc_tokens, sequence_id, offset, ids).

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit
    integers. Sequences are numbered from 0 without gaps.
    """
    spark = docs.sparkSession
    ship(spark)
    path = vocabulary or tokens.default_vocabulary()
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), text_of(text_col).alias("text"))
    encoded = written(texts.mapInArrow(_encode(path, capacity), "id bigint, task bigint, n bigint, whole bigint, rank bigint, ids binary"), "tokens")

    rest = (F.col("n") % capacity).alias("length")
    wholes = encoded.groupBy("task").agg(F.sum(F.floor(F.col("n") / capacity)).alias("count")).select("task", F.lit(capacity).cast("bigint").alias("length"), "count")
    counts = written(encoded.groupBy("task", rest).agg(F.count(F.lit(1)).alias("count")).union(wholes), "lengths")
    histogram = {r.length: r.count_ for r in counts.filter(f"length between 1 and {capacity - 1}").groupBy("length").agg(F.sum("count").alias("count_")).collect()}
    plan, sequences = plan_windows(histogram, capacity)

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("task", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("off"))
    folder = shared_path(spark, "offsets")
    per_task = offsets.groupBy("task").agg(F.collect_list(F.struct("length", "off")).alias("offsets"))  # at most ``capacity`` + 1 a task
    per_task.withColumn("block", F.floor(F.col("task") / TASKS)).repartition("block").write.partitionBy("block").parquet(folder)
    return encoded.mapInArrow(_place(plan, sequences, capacity, folder), "id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")
