"""Exact order statistics of many numeric columns by radix selection.

A double becomes a 64-bit key of the same order. A pass counts keys by their next
``bits`` bits, in arrays inside each task; one aggregation adds up the few rows
that come out (at most 2^bits per column in the first pass). Only the prefixes
that hold a wanted rank are counted further, so the later passes count a sliver
of the values, and a prefix whose smallest and largest key are equal is
decided. Five passes over the numeric columns at most; nothing is sorted, and
no row is shuffled. The driver holds counts of prefixes, never values.

The passes after the first count ``LATER`` bits, so a wanted prefix has at most
4,096 counts, whatever the number of rows; a task holds them as arrays.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 16  # counted in the first pass
LATER = 12  # counted in each further pass
PENDING = 1 << 17  # counts of batches that wait to be added up
_SIGN = np.uint64(1 << 63)
_COUNTS = "position int, prefix bigint, n bigint, low bigint, high bigint"


def ordered_keys(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit keys that order as the doubles do (no NaN; -0.0 counts as 0.0)."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def value_of(key: int) -> float:
    bits = key & ~(1 << 63) if key >> 63 else ~key & (1 << 64) - 1
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _counted(keys: np.ndarray, weights: np.ndarray | None, done: int, bits: int, wanted: list[int] | None):
    """(prefixes, counts, smallest key, largest key) by the first ``done + bits`` bits, within the ``wanted`` shorter prefixes."""
    if wanted is not None:
        inside = np.isin(keys >> np.uint64(64 - done), np.array(wanted, np.uint64))
        keys, weights = keys[inside], weights if weights is None else weights[inside]
    if weights is None:
        keys, n = np.sort(keys), np.ones(len(keys), np.int64)
    else:
        order = np.argsort(keys)
        keys, n = keys[order], weights[order].astype(np.int64)
    return _added_up(keys >> np.uint64(64 - done - bits), n, keys, keys)


def _added_up(prefix: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray):
    """One entry for each prefix, from entries in ascending order of it."""
    if not len(prefix):
        return prefix, n, low, high
    at = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
    return prefix[at], np.add.reduceat(n, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)


class _Total:
    """Entries of a column, added up whenever those that wait are as many as those held."""

    def __init__(self):
        self.parts, self.waiting, self.held = [], 0, 0

    def add(self, entries: tuple) -> None:
        self.parts.append(entries)
        self.waiting += len(entries[0])
        if self.waiting > max(PENDING, self.held):
            self.entries()

    def entries(self) -> tuple:
        parts = [np.concatenate(x) for x in zip(*self.parts)]
        order = np.argsort(parts[0], kind="stable")
        self.parts = [_added_up(*[x[order] for x in parts])]
        self.waiting, self.held = 0, len(self.parts[0][0])
        return self.parts[0]


def _count(read: Callable, done: int, bits: int, wanted: dict[int, list[int]] | None):
    """Arrow function: ``read`` gives (position, values, weights) parts of a batch."""

    def run(batches):
        total: dict[int, _Total] = {}
        for batch in batches:
            for position, values, weights in read(batch):
                if wanted is None or position in wanted:
                    total.setdefault(position, _Total()).add(_counted(ordered_keys(values), weights, done, bits, wanted and wanted[position]))
        names = [f.split()[0] for f in _COUNTS.split(", ")]
        for position, held in total.items():
            prefix, n, low, high = held.entries()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), position, np.int32)), pa.array(prefix.view(np.int64)), pa.array(n), pa.array(low.view(np.int64)), pa.array(high.view(np.int64))], names)

    return run


def read_wide(positions: list[int]) -> Callable:
    """Batches with one column per position; nulls are left out."""

    def read(batch):
        for i, p in enumerate(positions):
            yield p, batch.column(i).drop_null().to_numpy(zero_copy_only=False).astype(np.float64), None

    return read


def read_long(batch):
    """Batches of (position, value, number of rows)."""
    position, values, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    for p in np.unique(position).tolist():
        mine = position == p
        yield p, values[mine].astype(np.float64), n[mine].astype(np.float64)


def quantiles(df: DataFrame, read: Callable, probs: list[float], bits: int = BITS) -> dict[int, list[float]]:
    """position -> value at each of ``probs``, by linear interpolation between ranks, of the values that ``read`` takes from ``df``.

    Counts up to 2^53 rows per prefix and task are exact.
    """
    targets: dict[tuple[int, int], tuple[int, int]] = {}  # (position, rank) -> (prefix, rank within it)
    found: dict[tuple[int, int], float] = {}
    sizes: dict[int, int] = {}
    wanted = None
    passes = [(0, bits)]
    while sum(passes[-1]) < 64:
        done = sum(passes[-1])
        passes.append((done, min(bits, LATER, 64 - done)))
    for done, step in passes:
        unsigned = lambda v: v & (1 << 64) - 1
        rows = df.mapInArrow(_count(read, done, step, wanted), _COUNTS)
        # Signed keys order as unsigned ones once their first bit is flipped.
        flip = lambda c: F.col(c).bitwiseXOR(F.lit(-(1 << 63)))
        summed = rows.groupBy("position", "prefix").agg(F.sum("n").alias("n"), F.min(flip("low")).alias("low"), F.max(flip("high")).alias("high"))
        children: dict[tuple[int, int], list] = {}
        for r in summed.collect():  # at most 2^BITS per column, then 2^LATER per wanted prefix
            prefix = unsigned(r.prefix)
            children.setdefault((r.position, prefix >> step), []).append((prefix, r.n, unsigned(r.low ^ -(1 << 63)), unsigned(r.high ^ -(1 << 63))))
        if done == 0:
            sizes = {p: sum(c[1] for c in found_) for (p, _), found_ in children.items()}
            ranks = {p: {f(q * (n - 1)) for q in probs for f in (math.floor, math.ceil)} for p, n in sizes.items()}
            targets = {(p, r): (0, r) for p, some in ranks.items() for r in some}
        for some in children.values():
            some.sort()
        following = {}
        for (p, rank), (parent, inside) in targets.items():
            for prefix, n, low, high in children[p, parent]:
                if inside < n:
                    break
                inside -= n
            if low == high:
                found[p, rank] = value_of(low)
            else:
                following[p, rank] = prefix, inside
        targets = following
        if not targets:
            break
        wanted = {}
        for (p, _), (prefix, _) in targets.items():
            wanted.setdefault(p, set()).add(prefix)
        wanted = {p: sorted(v) for p, v in wanted.items()}
    out = {}
    for p, n in sizes.items():
        at = [q * (n - 1) for q in probs]
        out[p] = [found[p, math.floor(x)] + (found[p, math.ceil(x)] - found[p, math.floor(x)]) * (x - math.floor(x)) for x in at]
    return out
