"""Word-level Markov text: bigram fit (D9) and a distributed walk.

Fit: split every text on whitespace, pair adjacent words, count
``(lower(word), next word as written)``. One explode and one aggregation. The
transitions of a word are the cumulative counts of its successors; a word
without successors restarts from any key, which is one more set of transitions,
so every step of every walker is the same kind of look-up.

Walk: every generated row is one walker; its draw at a step is the keyed uniform
of (row, step), so the text of a row depends on nothing else.

* A model of at most ``HELD_ROWS`` transitions and ``HELD_BYTES`` of words (both
  counted first) is sent to the tasks as arrays, and each task walks its rows
  all the way, all of them one step at a time: one job for any length.
* Longer texts are laid out as files of numbers in the shared folder: the next
  word at every place of the bigrams in order of key and next word, repeats
  included, and each key's first place. The tasks map the files and walk as above,
  so a step is one look-up at any model size. Pages that steps read are given back
  before they add up. A task writes the places of its own rows, so a repeated task
  writes the same bytes. No bigram is a row: the texts are read once, their words
  written as numbers of a part's own word list; the lists give the words' numbers
  in order; then each part's pairs of numbers are sorted, and stretches of them are
  brought together by files.
* Where the shared folder cannot be mapped, a larger model stays a table. The
  transitions are dealt out by (word, block of ranks) once, so a very common word does not put its walkers in one task. A job
  walks ``STEPS`` steps; its joins read the same exchange of the transitions,
  and the walkers carry the words of these steps. Each job's frontier is a
  written table, so lineage stays one job long; the words of a row come together
  at the end, one row for each job.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.functions import rand as R
from facsimile.functions.draws import Draws
from facsimile.functions.text import UNICODE, capitalize, word_count
from facsimile.operators.ranking import running_totals
from facsimile.session import checkpoint_dir, cut_lineage, shuffle_partitions

MIN_TEXTS = 10
HELD_ROWS, HELD_BYTES = 4_000_000, 1 << 26  # transitions, and bytes of their words, that are sent to the tasks
MAPPED_ROWS, MAPPED_BYTES = HELD_ROWS, HELD_BYTES  # texts of more words or bytes are laid out as files
STEPS = 8  # steps in a job of a model that stays a table
WALKED = 1 << 22  # words walked together in a task
TEXT_BYTES = 1 << 27  # of texts made together from a mapped model
PART_BYTES = 1 << 24  # of texts that share a word list
LOOKED_UP = 1 << 17  # look-ups after which the pages of mapped files are given back
SLOTS, SLOT_LEAST, SLOT_MOST = 256, 1 << 20, 1 << 22  # stretches the bigrams are cut into, and their places
BUCKET_BITS = 19  # a bucket of digests has about 2^19 words
WORD_SUMS = ["words", "bytes", "n", "keys", "total", "first_bytes"]  # of a part of the word list
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
# UTF-8 of the other white space of Java's (?U)\s: first byte, and what follows it.
WIDE_SPACES = {0xC2: [b"\x85", b"\xa0"], 0xE1: [b"\x9a\x80"], 0xE2: [*(bytes([0x80, x]) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\x81\x9f"], 0xE3: [b"\x80\x80"]}


def bigrams(df: DataFrame, col: str) -> DataFrame:
    """(key, next_word, n) over all texts with at least two words.

    A text is split once, untrimmed (a filter on the words would split it again):
    only its first and last parts can be empty, and their pairs are dropped. A
    pair is counted as one string, since no word holds a space; that is a
    smaller row to hash, keep and shuffle than two strings.
    """
    parts = df.select(F.split(F.col(f"`{col}`"), UNICODE + r"\s+").alias("_w"))
    pairs = parts.select(
        F.explode(F.arrays_zip(F.slice("_w", 1, F.size("_w") - 1).alias("a"), F.slice("_w", 2, F.size("_w") - 1).alias("b"))).alias("p")
    ).filter((F.col("p.a") != "") & (F.col("p.b") != ""))
    pair = F.concat(F.lower(F.col("p.a")), F.lit(" "), F.col("p.b")).alias("pair")
    counted = pairs.select(pair).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.substring_index("pair", " ", 1).alias("key"), F.substring_index("pair", " ", -1).alias("next_word"), "n")


class MarkovModel:
    def __init__(self, df: DataFrame, col: str):
        self.col = col
        src = df.select(F.col(f"`{col}`").cast("string").alias("_t")).filter(F.col("_t").isNotNull())
        self.files = None
        self.texts, size = src.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("_t")), F.lit(0))).first()
        words = src.agg(F.sum(word_count(F.col("_t")))).first()[0] or 0 if size <= MAPPED_BYTES else None
        folder = _mapped_folder(df.sparkSession)
        if folder and (words is None or words > MAPPED_ROWS):
            words, self.n_keys = _laid_out(src, folder)
            self.files = folder if self.n_keys else None
        elif words is None:
            words = src.agg(F.sum(word_count(F.col("_t")))).first()[0]
        self.length = int(words / self.texts) if self.texts else 0
        if self.files:
            return
        # The fitted model is written once to the checkpoint folder: every
        # walk reads it instead of recomputing it from the texts.
        big = cut_lineage(bigrams(src, "_t"))
        totals = big.groupBy("key").agg(F.sum("n").cast("long").alias("total"), F.count(F.lit(1)).alias("succ"))
        totals = totals.withColumn("bw", F.greatest(F.lit(1), F.floor(F.col("total") / F.col("succ"))).cast("long"))
        keys = running_totals(totals, ["key"]).select("key", "total", "bw", F.col("rank_start").alias("number"))
        self.keys = cut_lineage(keys)
        self.n_keys = self.keys.count()
        trans = running_totals(big, ["next_word"], weight=F.col("n"), group_cols=["key"]).join(self.keys.select("key", "bw", "number"), "key")
        # Each transition carries what a walker needs at its next word, so a
        # step is one bucketed join and no join on the bare word.
        ahead = self.keys.select(F.col("key").alias("next_key"), F.col("total").alias("next_total"), F.col("bw").alias("next_bw"), F.col("number").alias("next_number"))
        steps = trans.join(ahead, F.lower("next_word") == F.col("next_key"), "left").select(
            F.lit(False).alias("restart"), "key", "number", "next_word", "rank_start", "rank_end", "bw", "next_key", "next_total", "next_bw", "next_number"
        )
        anywhere = self.keys.select(
            F.lit(True).alias("restart"), F.lit("").alias("key"), F.lit(self.n_keys).cast("long").alias("number"), F.col("key").alias("next_word"), F.col("number").alias("rank_start"),
            (F.col("number") + 1).alias("rank_end"), F.lit(1).cast("long").alias("bw"), F.col("key").alias("next_key"), F.col("total").alias("next_total"), F.col("bw").alias("next_bw"), F.col("number").alias("next_number"),
        )
        self.transitions = cut_lineage(steps.unionByName(anywhere))

    @property
    def usable(self) -> bool:
        return self.texts >= MIN_TEXTS and self.n_keys > 0


def _mapped_folder(spark) -> str | None:
    """A new folder for a model's files, or None if the shared folder is not a mounted one."""
    found = re.fullmatch(r"(?:file:(?://)?)?(/.*)", checkpoint_dir(spark))
    return f"{found[1].rstrip('/')}/facsimile/markov-{uuid.uuid4().hex}" if found else None


def _put(path: str, start: int, values: np.ndarray) -> None:
    """Write ``values`` at the places from ``start``, numbered by value."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    file = os.open(path, os.O_WRONLY | os.O_CREAT, 0o644)
    try:
        data, at = memoryview(values.tobytes()), start * values.itemsize
        while data:
            done = os.pwrite(file, data, at)
            data, at = data[done:], at + done
    finally:
        os.close(file)


def _mapped(path: str, kind: str, opened: list) -> np.ndarray:
    """The numbers of a file, read page by page; its map is added to ``opened``."""
    if not os.path.getsize(path):
        return np.zeros(0, kind)
    with open(path, "rb") as f:
        opened.append(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    opened[-1].madvise(mmap.MADV_RANDOM)
    return np.frombuffer(opened[-1], kind)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers compressed byte by byte: the first bytes of all, the second bytes, and so on."""
    import pyarrow as pa

    return pa.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T), codec="zstd", asbytes=True) if len(numbers) else b""


def _unpacked(data: bytes, kind: str, n: int) -> np.ndarray:
    import pyarrow as pa

    size = np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(data, n * size, codec="zstd"), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(flat.reshape(size, n).T).view(kind).ravel()


def _words_of(data: np.ndarray, ends: np.ndarray):
    """Words of the texts that lie in ``data`` up to ``ends``: their bytes, sizes, and which are the last of a text."""
    blank = SPACES[data]
    if (data > 127).any():
        for lead, rests in WIDE_SPACES.items():
            at = np.flatnonzero(data == lead)
            for rest in rests if len(at) else ():
                found = at[at + len(rest) < len(data)]
                for k, byte in enumerate(rest, 1):
                    found = found[data[found + k] == byte]
                for k in range(len(rest) + 1):
                    blank[found + k] = True
    # A word begins after a blank or with a text, and ends likewise.
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = blank[:-1]
    edge[ends] = True
    starts = np.flatnonzero(edge[:-1] & ~blank)
    edge[1:-1] = blank[1:]
    edge[ends] = True
    sizes = np.flatnonzero(edge[1:] & ~blank) + 1 - starts
    upto = np.searchsorted(starts, ends)
    last = np.zeros(len(starts), bool)
    last[upto[upto > 0] - 1] = True
    return data[~blank], sizes, last


def _bytes_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow array of texts without nulls, and where each ends in them."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def _read_texts(folder: str, part_bytes: int):
    """Arrow function: the words of a part of the texts with their counts, and with those of which are not the last of a text.

    Each task writes its texts to one file, as numbers of the words of each part;
    its name is a row without a word.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        name = f"read-{TaskContext.get().partitionId()}"
        os.makedirs(folder, exist_ok=True)
        own = f"{folder}/.{name}-{uuid.uuid4().hex}"
        with open(own, "wb") as file:
            for batch in batches:
                data, ends = _bytes_of(batch.column(0))
                for low, high in _runs_of(np.diff(ends, prepend=0), part_bytes):
                    begin = ends[low - 1] if low else 0
                    flat, sizes, last = _words_of(data[begin : ends[high - 1]], ends[low:high] - begin)
                    if not len(sizes):
                        continue
                    places = np.append(0, np.cumsum(sizes)).astype(np.int32)
                    coded = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(places), pa.py_buffer(flat)]).dictionary_encode()
                    words, ids = coded.dictionary, coded.indices.to_numpy()
                    lasts = np.flatnonzero(last).astype(np.int32)
                    kept = [_packed(x) for x in (np.diff(np.frombuffer(words.buffers()[1], np.int32, len(words) + 1)), np.frombuffer(words.buffers()[2], np.uint8), ids, lasts)]
                    file.write(np.array([len(words), len(words.buffers()[2]), len(ids), len(lasts), *map(len, kept)], np.int64).tobytes() + b"".join(kept))
                    n, leads = np.bincount(ids, minlength=len(words)), np.bincount(ids[~last], minlength=len(words))
                    for at in range(0, len(words), 1 << 16):
                        some = words.slice(at, 1 << 16)
                        yield pa.RecordBatch.from_pydict({"word": some.cast(pa.string()), "n": n[at : at + len(some)], "leads": leads[at : at + len(some)], "file": pa.nulls(len(some), pa.string())})
                pa.default_memory_pool().release_unused()
        os.replace(own, f"{folder}/{name}")
        yield pa.RecordBatch.from_pydict({"word": pa.nulls(1, pa.string()), "n": pa.array([0]), "leads": pa.array([0]), "file": pa.array([name])})

    return run


def _parts_read(path: str):
    """(words, ids, lasts) of each part in a file of ``_read_texts``."""
    with open(path, "rb") as file:
        while head := file.read(64):
            counts, sizes = np.split(np.frombuffer(head, np.int64), 2)
            lengths, data, ids, lasts = (_unpacked(file.read(size), kind, n) for size, kind, n in zip(sizes.tolist(), ("<i4", "u1", "<i4", "<i4"), counts.tolist()))
            ends, data = np.cumsum(lengths), data.tobytes()
            yield [data[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist())], ids, lasts


def _digests(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The first 30 hex digits of the words' md5, as two numbers."""
    both = np.frombuffer(b"".join([hashlib.md5(w).digest() for w in words]), ">u8").astype(np.uint64).reshape(-1, 2)
    return (both[:, 0] >> np.uint64(4)).astype(np.int64), (((both[:, 0] & np.uint64(15)) << np.uint64(56)) | (both[:, 1] >> np.uint64(8))).astype(np.int64)


def _numbers_of(folder: str, bits: int, words: list[bytes]) -> np.ndarray:
    """The numbers of words by their digests, -1 for a word that has none."""
    first, second = _digests(words)
    order, out = np.argsort(first), np.full(len(words), -1, np.int64)
    cuts = np.searchsorted(first[order] >> (60 - bits), np.arange((1 << bits) + 1)).tolist()
    for bucket, (low, high) in enumerate(zip(cuts, cuts[1:])):
        if low == high or not os.path.exists(path := f"{folder}/digests-{bucket}"):
            continue
        data = _mapped(path, "u1", [])
        n = len(data) // 20
        one, two, number = data[: 8 * n].view("<i8"), data[8 * n : 16 * n].view("<i8"), data[16 * n :].view("<i4")
        rows = order[low:high]
        at = np.searchsorted(one, first[rows])
        while len(rows):
            near = np.minimum(at, n - 1)
            alike = (at < n) & (one[near] == first[rows])
            hit = alike & (two[near] == second[rows])
            out[rows[hit]] = number[near[hit]]
            rows, at = rows[alike & ~hit], at[alike & ~hit] + 1  # another word with the same first digits
    return out


def _cut_words(folder: str):
    """Arrow function: the words of a stretch of their order go to a file of the task; one row with their sums."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, sums, file = TaskContext.get().partitionId(), np.zeros(len(WORD_SUMS), np.int64), None
        os.makedirs(folder, exist_ok=True)
        own = f"{folder}/.words-{part}-{uuid.uuid4().hex}"
        for batch in batches:
            if not batch.num_rows:
                continue
            file = file or pa.ipc.new_file(own, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            file.write_batch(batch)
            total = batch.column("total").to_numpy()
            sums += [len(total), len(_bytes_of(batch.column("word"))[0]), batch.column("n").to_numpy().sum(), (total > 0).sum(), total.sum(), len(_bytes_of(batch.column("first"))[0])]
        if file:
            file.close()
            os.replace(own, f"{folder}/words-{part}")
        yield pa.RecordBatch.from_pydict({"part": [part]} | {c: [x] for c, x in zip(WORD_SUMS, sums.tolist())})

    return run


def _words_kept(folder: str, part: int) -> dict:
    """The columns of a file of ``_cut_words``."""
    import pyarrow as pa

    with pa.OSFile(f"{folder}/words-{part}") as file:
        table = pa.ipc.open_file(file).read_all()
    return {c: pa.concat_arrays(table[c].chunks) for c in table.column_names}


def _put_words(folder: str, bits: int):
    """Arrow function: the words of each ``part`` go to their places from the sums before it; the digests of the words."""

    def run(batches):
        import pyarrow as pa

        for at in (row for batch in batches for row in batch.to_pylist()):
            kept = _words_kept(folder, at["part"])
            (data, ends), (first, first_ends) = _bytes_of(kept["word"]), _bytes_of(kept["first"])
            n, total = kept["n"].to_numpy(), kept["total"].to_numpy()
            keys, number = np.flatnonzero(total), at["words"] + np.arange(len(n))
            own_key = np.full(len(n), -1, np.int32)
            own_key[keys] = at["keys"] + np.arange(len(keys))
            for name, start, values in (
                ("texts", at["bytes"], data), ("text_ends", at["words"], at["bytes"] + ends), ("before", at["words"], at["n"] + np.cumsum(n) - n), ("own_key", at["words"], own_key),
                ("end", at["keys"], at["total"] + np.cumsum(total[keys])), ("plain", at["keys"], number[keys].astype(np.int32)), ("first_texts", at["first_bytes"], first), ("first_ends", at["keys"], at["first_bytes"] + first_ends[keys]),
            ):
                _put(f"{folder}/{name}", start, values)
            one, two = _digests(kept["word"].cast(pa.binary()).to_pylist())
            for low in range(0, len(n), 1 << 16):
                some = slice(low, low + (1 << 16))
                yield pa.RecordBatch.from_pydict({"bucket": one[some] >> (60 - bits), "one": one[some], "two": two[some], "number": number[some].astype(np.int32)})

    return run


def _put_digests(folder: str):
    """Arrow function: the digests of a bucket in order, and the numbers of their words, as one file."""

    def run(batches):
        import pyarrow as pa

        found = [[b.column(c).to_numpy() for c in ("bucket", "one", "two", "number")] for b in batches if b.num_rows]
        if found:
            bucket, one, two, number = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(one)  # in order of buckets too, which are the first bits
            cuts = np.append(np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)), len(one)).tolist()
            for low, high in zip(cuts, cuts[1:]):
                some, path = order[low:high], f"{folder}/digests-{bucket[order[low]]}"
                with open(own := f"{path}-{uuid.uuid4().hex}", "wb") as file:
                    file.write(one[some].tobytes() + two[some].tobytes() + number[some].tobytes())
                os.replace(own, path)
        yield pa.RecordBatch.from_pydict({"rows": pa.array([sum(len(x[0]) for x in found)], pa.int64())})

    return run


def _put_keys(folder: str, bits: int, n_keys: int):
    """Arrow function: the key's number of every word of each ``part``, that of the word in lower case; ``n_keys`` if it is no key."""

    def run(batches):
        import pyarrow as pa

        rows = 0
        for at in (row for batch in batches for row in batch.to_pylist()):
            lower = _words_kept(folder, at["part"])["lower"]
            own_key = _mapped(f"{folder}/own_key", "<i4", [])
            key_of = own_key[at["words"] : at["words"] + len(lower)].copy()
            other = np.flatnonzero(lower.is_valid().to_numpy(zero_copy_only=False))
            number = _numbers_of(folder, bits, lower.drop_null().cast(pa.binary()).to_pylist())
            key_of[other] = np.where(number < 0, -1, own_key[np.maximum(number, 0)])
            _put(f"{folder}/key_of", at["words"], np.where(key_of < 0, n_keys, key_of).astype(np.int32))
            rows += len(lower)
        yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64())})

    return run


def _deal_pairs(folder: str, bits: int, slot: int, n_words: int):
    """Arrow function: the pairs of each ``file`` as sorted pieces, a row for each piece in a file of the task's own.

    A piece holds the different pairs (key's number, next word's number) of one
    stretch and their counts. A stretch is the keys that begin in the same ``slot``
    places; a key of more places than that has stretches of its own, cut where the
    words before add up to 4 slots, so it fills no more than these and one word.
    """

    def run(batches):
        import pyarrow as pa

        opened = []
        end, key_of, before = (_mapped(f"{folder}/{n}", k, opened) for n, k in (("end", "<i8"), ("key_of", "<i4"), ("before", "<i8")))
        none, cuts_of_key = np.zeros(0, np.int64), n_words // (4 * slot) + 2
        for name in [x for batch in batches for x in batch.column("file").to_pylist()]:
            own, out, at = f"{folder}/.pairs-{name}-{uuid.uuid4().hex}", [], 0
            with open(own, "wb") as file:
                for words, ids, lasts in _parts_read(f"{folder}/{name}"):
                    number = _numbers_of(folder, bits, words)
                    if (number < 0).any():
                        raise ValueError("a word was not counted")
                    leads = np.ones(len(ids), bool)
                    leads[lasts] = False
                    leads = np.flatnonzero(leads)
                    pairs = (key_of[number].astype(np.int64) << 32)[ids[leads]] | number[ids[leads + 1]]
                    pairs.sort()
                    cuts = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else none
                    counts, pairs = np.diff(np.append(cuts, len(pairs))), pairs[cuts]
                    del ids, leads
                    key = pairs >> 32
                    start = np.where(key > 0, end[key - 1], 0)
                    stretch = (start // slot) * cuts_of_key
                    large = np.flatnonzero(end[key] - start > slot)
                    stretch[large] += 1 + before[pairs[large] & 0xFFFFFFFF] // (4 * slot)
                    cuts = np.append(np.flatnonzero(np.append(True, np.diff(stretch) != 0)) if len(pairs) else none, len(pairs)).tolist()
                    for low, high in zip(cuts, cuts[1:]):
                        kept = [_packed(pairs[low:high]), _packed(counts[low:high])]
                        file.write(b"".join(kept))
                        out.append((int(stretch[low]), int(counts[low:high].sum()), high - low, f"pairs-{name}", at, *map(len, kept)))
                        at += len(kept[0]) + len(kept[1])
                    for m in opened:
                        m.madvise(mmap.MADV_DONTNEED)
            os.replace(own, f"{folder}/pairs-{name}")
            names = ("stretch", "n", "pairs", "file", "at", "pairs_size", "counts_size")
            if out:
                yield pa.RecordBatch.from_pydict({c: list(v) for c, v in zip(names, zip(*out))})

    return run


def _put_pairs(folder: str, most: int):
    """Arrow function: the pieces of a stretch come together, and its next words go to their places from ``start``."""

    def run(batches):
        import pyarrow as pa

        rows = 0
        for batch in batches:
            for start, pieces in zip(batch.column("start").to_pylist(), batch.column("pieces")):
                parts = []
                for p in pieces.as_py():
                    with open(f"{folder}/{p['file']}", "rb") as file:
                        file.seek(p["at"])
                        parts.append([_unpacked(file.read(p[size]), "<i8", p["pairs"]) for size in ("pairs_size", "counts_size")])
                pairs, counts = (np.concatenate(x) for x in zip(*parts))
                if counts.sum() <= 2 * len(counts):  # few repeats: to sort the pairs themselves is faster than their order
                    pairs = np.repeat(pairs, counts)
                    pairs.sort()
                    counts = np.ones(len(pairs), np.int64)
                else:
                    order = np.argsort(pairs)
                    pairs, counts = pairs[order], counts[order]
                words, upto = (pairs & 0xFFFFFFFF).astype("<i4"), np.append(0, np.cumsum(counts))
                for first in range(0, int(upto[-1]), most):  # a very frequent pair fills many places
                    last = min(first + most, int(upto[-1]))
                    low, high = np.searchsorted(upto, first, side="right") - 1, np.searchsorted(upto, last)
                    some = np.repeat(words[low:high], np.minimum(upto[low + 1 : high + 1], last) - np.maximum(upto[low:high], first))
                    _put(f"{folder}/next", start + first, some)
                rows += 1
        yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64())})

    return run


def _laid_out(src: DataFrame, folder: str) -> tuple[int, int]:
    """The files of the model of the texts ``src`` in ``folder``; the number of words and of keys."""
    run = lambda df, f: df.mapInArrow(f, "rows bigint").agg(F.sum("rows")).first()[0] or 0
    read = src.select(F.make_valid_utf8("_t")).mapInArrow(_read_texts(folder, PART_BYTES), "word string, n bigint, leads bigint, file string")
    found = cut_lineage(read.groupBy("word", "file").agg(F.sum("n").alias("n"), F.sum("leads").alias("leads")))
    files, found = found.filter(F.col("file").isNotNull()).select("file"), found.filter(F.col("word").isNotNull()).select("word", "n", "leads")
    forms = F.array(F.struct("word", "n", F.when(F.col("word") == F.col("lower"), F.col("leads")).otherwise(0).alias("total")), F.struct(F.col("lower").alias("word"), F.lit(0).alias("n"), F.col("leads").alias("total")))
    both = F.when((F.col("word") == F.col("lower")) | (F.col("leads") == 0), F.slice(forms, 1, 1)).otherwise(forms)
    words = found.withColumn("lower", F.lower("word")).select(F.inline(both)).groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    lower, first = F.lower("word"), F.when(F.col("total") > 0, capitalize(F.col("word"))).otherwise("")
    ranged = words.repartitionByRange(max(shuffle_partitions(src.sparkSession), found.count() >> 20), "word").sortWithinPartitions("word")
    cut = ranged.select("word", "n", "total", F.when(lower != F.col("word"), lower).alias("lower"), first.alias("first"))
    sums = ["part", *WORD_SUMS]
    parts = sorted([r[c] for c in sums] for r in cut.mapInArrow(_cut_words(folder), ", ".join(f"{c} bigint" for c in sums)).collect())
    n_all, _, n_words, n_keys, places, _ = (sum(p[i] for p in parts) for i in range(1, len(sums)))
    if not n_keys:
        return n_words, 0
    if n_all >= 1 << 31:
        raise ValueError("a model of 2^31 different words has no layout")
    before = np.cumsum([[0] * len(WORD_SUMS), *[p[1:] for p in parts]], axis=0).tolist()
    rows = [[p[0], *b] for p, b in zip(parts, before) if p[1]]
    at = src.sparkSession.createDataFrame(rows, ", ".join(f"{c} bigint" for c in sums)).repartition(len(rows))
    bits = max(0, n_all.bit_length() - BUCKET_BITS)
    digests = at.mapInArrow(_put_words(folder, bits), "bucket bigint, one bigint, two bigint, number int")
    run(digests.repartition(1 << bits, "bucket"), _put_digests(folder))
    run(at, _put_keys(folder, bits, n_keys))
    slot = min(max(places // SLOTS, SLOT_LEAST), SLOT_MOST)
    pieces = cut_lineage(
        files.repartition(max(1, files.count())).mapInArrow(_deal_pairs(folder, bits, slot, n_words), "stretch bigint, n bigint, pairs bigint, file string, at bigint, pairs_size bigint, counts_size bigint")
    )
    stretches = pieces.groupBy("stretch").agg(F.sum("n").alias("n"), F.collect_list(F.struct("file", "at", "pairs", "pairs_size", "counts_size")).alias("pieces"))
    placed = running_totals(stretches, ["stretch"], weight=F.col("n"), start="start")
    run(placed.select("start", "pieces").repartition(places // slot + 1), _put_pairs(folder, WALKED))
    return n_words, n_keys


def _held(model: MarkovModel) -> dict | None:
    """The transitions as arrays in order of key and rank, or None if they are too many."""
    rows, size = model.transitions.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("next_word")), F.lit(0))).first()
    if rows > HELD_ROWS or size > HELD_BYTES:
        return None
    t = model.transitions.select("number", "next_word", "rank_start", "rank_end", F.coalesce("next_number", F.lit(model.n_keys)).alias("next"), F.when(F.col("restart"), capitalize(F.col("next_word"))).alias("first")).toArrow()
    order = np.lexsort((t["rank_start"].to_numpy(), t["number"].to_numpy()))
    t = t.take(order)
    number, end = t["number"].to_numpy(), t["rank_end"].to_numpy()
    totals = np.zeros(model.n_keys + 1, np.int64)
    np.maximum.at(totals, number, end)
    before = np.cumsum(totals) - totals
    return {
        "totals": totals, "before": before, "ends": before[number] + end, "next": t["next"].to_numpy(),
        "words": t["next_word"].combine_chunks(), "first": t["first"].combine_chunks().drop_null(),
    }


def _step(draws: Draws, j: int, lost: np.ndarray) -> np.ndarray:
    """The draws of step ``j``; a lost walker has one of its own, from any key."""
    u, rows = draws.uniform(f"m{j}"), np.flatnonzero(lost)
    if len(rows):
        u[rows] = Draws(draws.key.decode(), draws.ids[rows]).uniform(f"r{j}")
    return u


def _walk_rows(held, key: str, length: int, n_keys: int):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        model = held.value
        words = pa.concat_arrays([model["words"], model["first"]])
        step = max(1, WALKED // length)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.column("id").slice(at, step)
                ids = part.to_numpy()
                draws = Draws(key, ids)
                current = np.floor(draws.uniform("start") * n_keys).astype(np.int64)
                chosen = np.empty((len(ids), length), np.int64)
                chosen[:, 0] = current + len(model["words"])
                for j in range(1, length):
                    lost = current == n_keys
                    u = _step(draws, j, lost)
                    at_rank = np.floor(u * model["totals"][current]).astype(np.int64)
                    chosen[:, j] = np.searchsorted(model["ends"], model["before"][current] + at_rank, side="right")
                    current = model["next"][chosen[:, j]]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * length, pa.int32()), words.take(pa.array(chosen.ravel())))
                yield pa.RecordBatch.from_arrays([part, pc.binary_join(lists, " ")], ["id", "text"])

    return run


def _runs_of(sizes: np.ndarray, most: int):
    """(first, end) of stretches whose sizes add up to at most ``most``, or of one element."""
    upto, low = np.cumsum(sizes), 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + most, side="right")))
        yield low, high
        low = high


def _sizes(ends: np.ndarray, some: np.ndarray) -> np.ndarray:
    return ends[some] - np.where(some > 0, ends[some - 1], 0)


def _texts_of(texts: np.ndarray, ends: np.ndarray, some: np.ndarray):
    """Arrow array of the texts of numbers ``some``."""
    import pyarrow as pa

    sizes = _sizes(ends, some)
    places = np.append(0, np.cumsum(sizes))
    data = texts[np.repeat(ends[some] - sizes - places[:-1], sizes) + np.arange(places[-1])]
    return pa.Array.from_buffers(pa.string(), len(some), [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(data)])


def _walk_mapped(folder: str, key: str, length: int, n_keys: int):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        opened, looked_up = [], 0
        numbers = lambda name, kind: _mapped(f"{folder}/{name}", kind, opened)

        def given_back() -> None:
            """Pages read go back, the files stay in the system's cache."""
            nonlocal looked_up
            looked_up = 0
            for m in opened:
                m.madvise(mmap.MADV_DONTNEED)

        following, end, plain, key_of, text_ends, texts, first_ends, first_texts = (
            numbers(n, k) for n, k in (("next", "<i4"), ("end", "<i8"), ("plain", "<i4"), ("key_of", "<i4"), ("text_ends", "<i8"), ("texts", "u1"), ("first_ends", "<i8"), ("first_texts", "u1"))
        )
        step = max(1, WALKED // length)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.column("id").slice(at, step)
                ids = part.to_numpy()
                draws = Draws(key, ids)
                current = np.floor(draws.uniform("start") * n_keys).astype(np.int64)
                chosen = np.empty((len(ids), length), np.int32)
                begun = current
                for j in range(1, length):
                    lost = current == n_keys
                    u = _step(draws, j, lost)
                    known = np.where(lost, 0, current)
                    start = np.where(known > 0, end[known - 1], 0)
                    total = np.where(lost, n_keys, end[known] - start)
                    rank = np.floor(u * total).astype(np.int64)
                    chosen[:, j] = np.where(lost, plain[np.where(lost, rank, 0)], following[np.where(lost, 0, start + rank)])
                    current = np.where(lost, rank, key_of[chosen[:, j]])
                    looked_up += 4 * len(ids)
                    if looked_up > LOOKED_UP:
                        given_back()
                # Rows whose texts have no more than TEXT_BYTES together, or one row.
                sizes = _sizes(text_ends, chosen[:, 1:]).sum(axis=1) + _sizes(first_ends, begun)
                for low, high in _runs_of(sizes, TEXT_BYTES):
                    heads, head = np.unique(begun[low:high], return_inverse=True)
                    used, back = np.unique(chosen[low:high, 1:], return_inverse=True)
                    words = pa.concat_arrays([_texts_of(first_texts, first_ends, heads), _texts_of(texts, text_ends, used)])
                    places = np.column_stack([head, len(heads) + back.reshape(high - low, length - 1)])
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(high - low + 1) * length, pa.int32()), words.take(pa.array(places.ravel())))
                    yield pa.RecordBatch.from_arrays([part.slice(low, high - low), pc.binary_join(lists, " ")], ["id", "text"])
                given_back()
                pa.default_memory_pool().release_unused()

    return run


def walk(model: MarkovModel, ids: DataFrame, seed: int) -> DataFrame:
    """(id, text) for every id: a walk of ``model.length`` words (at least one)."""
    length = max(model.length, 1)
    key, walkers = f"{seed}:{model.col}:", ids.select(F.col("id").cast("long").alias("id"))
    if model.files:
        return walkers.mapInArrow(_walk_mapped(model.files, key, length, model.n_keys), "id bigint, text string")
    held = _held(model)
    if held is None:
        return _walk_tables(model, ids, seed, length)
    sent = ids.sparkSession.sparkContext.broadcast(held)
    return walkers.mapInArrow(_walk_rows(sent, key, length, model.n_keys), "id bigint, text string")


def _walk_tables(model: MarkovModel, ids: DataFrame, seed: int, length: int) -> DataFrame:
    trans = model.transitions.select(
        "restart", "key", "next_word", "rank_start", "rank_end", "next_key", "next_total", "next_bw",
        F.explode(F.sequence(F.floor(F.col("rank_start") / F.col("bw")), F.floor((F.col("rank_end") - 1) / F.col("bw")))).alias("block"),
    )
    trans = cut_lineage(trans)

    def step(walkers: DataFrame, tag: str, lost_tag: str) -> DataFrame:
        """One step of all walkers (id, words, key, total, bw); a key of null starts anywhere."""
        lost = F.col("key").isNull()
        u = F.when(lost, R.uniform(seed, model.col, F.col("id"), lost_tag)).otherwise(R.uniform(seed, model.col, F.col("id"), tag))
        drawn = walkers.select(
            "id", "words", lost.alias("restart"), F.coalesce("key", F.lit("")).alias("key"),
            F.floor(u * F.coalesce("total", F.lit(model.n_keys))).cast("long").alias("rank"), F.coalesce("bw", F.lit(1)).alias("bw"),
        ).withColumn("block", F.floor(F.col("rank") / F.col("bw")))
        met = drawn.drop("bw").join(trans, ["restart", "key", "block"]).filter((F.col("rank") >= F.col("rank_start")) & (F.col("rank") < F.col("rank_end")))
        return met.select("id", F.concat("words", F.array("next_word")).alias("words"), F.col("next_key").alias("key"), F.col("next_total").alias("total"), F.col("next_bw").alias("bw"))

    none = F.array().cast("array<string>")
    frontier = ids.select(F.col("id").cast("long").alias("id"), none.alias("words"), *[F.lit(None).cast(t).alias(c) for c, t in (("key", "string"), ("total", "long"), ("bw", "long"))])
    found = None
    for first in range(0, length, STEPS):
        walkers = frontier.withColumn("words", none)
        for j in range(first, min(length, first + STEPS)):
            walkers = step(walkers, f"m{j}", f"r{j}" if j else "start")
        frontier = cut_lineage(walkers)
        words = F.col("words") if first else F.concat(F.array(capitalize(F.element_at("words", 1))), F.slice("words", 2, STEPS))
        part = frontier.select("id", F.lit(first).alias("first"), F.array_join(words, " ").alias("part"))
        found = part if found is None else found.unionByName(part)
    # One row for each job per id: a bounded group.
    parts = F.sort_array(F.collect_list(F.struct("first", "part")))
    return found.groupBy("id").agg(F.array_join(F.transform(parts, lambda p: p["part"]), " ").alias("text"))


def markov_column(synth_model, plan, rows: DataFrame) -> DataFrame:
    """Generate column ``plan.out`` of ``rows`` (has ``id``) by a walk; too few texts are sampled."""
    from facsimile.operators.synth import _sampled

    model = MarkovModel(synth_model.source, plan.name)
    if not model.usable:
        fallback = type(plan)(plan.name, plan.position, "sample", plan.data_type, plan.kind, plan.params)
        return rows.join(_sampled(synth_model, [fallback], rows.select("id")), "id")
    texts = walk(model, rows.select("id"), synth_model.seed).withColumnRenamed("text", plan.out)
    return rows.join(texts, "id")
