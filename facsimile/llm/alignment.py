"""Alignment of two tokenizers' ids by an associative monoid of fragments.

A text (with a space before it) is encoded by a byte-level vocabulary (A) and a
piece vocabulary (B). Byte places where tokens of both end cut it into groups.
A fragment stands for the tokens that end in a byte range: the open prefix
(tokens up to the first such place), the closed groups, and the open suffix;
a range without such a place is all open. Fragments compose associatively:
the left suffix and the right prefix make one group, or stay open.

Texts of at most ``range_bytes`` are one range and need no shuffle. Longer ones
are cut into byte ranges, which are dealt over all tasks; a range carries the
bytes from the last place at or before it to the first place at or after it
where neither vocabulary ever joins what stands on both sides, so its tokens are
those of the whole text. The fragments of a text are composed by a tree of
``ARITY`` fragments a node, each level one grouping.

The corpus-wide counts of linked id pairs (the two tokens that end a group) are
one aggregation. Of two tokens that end together one is a suffix of the other,
so the vocabularies alone bound the number of different pairs (``most_pairs``);
the counts are sent to the tasks, whatever the size of the corpus.

Null or empty texts, and texts whose joined token bytes differ from the space
and the text in either vocabulary, have no tokens. Repeated rows and ids keep
their rows, null ids too. Empty tables give empty tables. Other columns are not
read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import ship, text_of, written
from facsimile.llm.tokens import ByteEncoder, PieceEncoder, array_slices, binary_array, default_pieces, default_vocabulary, encoder, text_bytes
from facsimile.session import shuffle_partitions

RANGE = 1 << 16  # bytes of a range
ARITY = 8
SLICE = 1 << 20  # bytes of text, or of ids, handled together

_ALIGNED = "id bigint, a binary, b binary, sizes binary"
_PARTS = ["prefix_a", "prefix_b", "closed_a", "closed_b", "sizes", "suffix_a", "suffix_b"]
_FRAGMENT = "row bigint, id bigint, part bigint, valid boolean, cut boolean, " + ", ".join(f"{c} binary" for c in _PARTS)


@lru_cache(maxsize=4)
def _token_bytes(kind: type, path: str) -> tuple[pa.Array, np.ndarray]:
    """Bytes of each id, and their numbers."""
    found = pa.array(encoder(path, kind).token_bytes(), pa.binary())
    return found, np.asarray(pc.binary_length(found)).astype(np.int64)


class Side:
    """Token ids of some texts by one vocabulary."""

    def __init__(self, kind: type, path: str, data: np.ndarray, places: np.ndarray):
        self.ids, self.at = encoder(path, kind).encode(data, places)
        table, lengths = _token_bytes(kind, path)
        whole, _ = text_bytes(table.take(pa.array(self.ids)))
        sizes = lengths[self.ids]
        n = len(places) - 1
        self.valid = np.ones(n, bool)
        if len(whole) != len(data) or not np.array_equal(whole, data):
            upto = np.append(0, np.cumsum(sizes))[self.at]
            self.valid = np.array([np.array_equal(whole[upto[i] : upto[i + 1]], data[places[i] : places[i + 1]]) for i in range(n)], bool)
        self.sizes = sizes

    def drop(self, valid: np.ndarray) -> None:
        counts = np.diff(self.at)
        if not valid.all():
            kept = np.repeat(valid, counts)
            self.ids, self.sizes = self.ids[kept], self.sizes[kept]
        self.at = np.append(0, np.cumsum(counts * valid))
        self.ends = np.cumsum(self.sizes)  # bytes of valid texts up to the end of each token


def both_sides(vocabulary: str, pieces: str, data: np.ndarray, places: np.ndarray) -> tuple[Side, Side, np.ndarray]:
    """The two sides of the valid texts, with ``closes``: whether a token of the other side ends there too."""
    a, b = Side(ByteEncoder, vocabulary, data, places), Side(PieceEncoder, pieces, data, places)
    valid = a.valid & b.valid
    a.drop(valid)
    b.drop(valid)
    total = int(a.ends[-1]) if len(a.ends) else 0
    for one, other in ((a, b), (b, a)):
        met = np.zeros(total + 1, bool)
        met[other.ends] = True
        one.closes = met[one.ends]
    return a, b, valid


def _bytes_of(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _group_sizes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(A tokens, B tokens) of each group, from the places of the tokens that close groups."""
    return np.stack([np.diff(a, prepend=-1), np.diff(b, prepend=-1)], axis=1).astype(np.uint32)


def packed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, place of each number's first byte and of the end): as many bytes 255 as fit, then the rest."""
    more, rest = np.divmod(numbers.astype(np.int64), 255)
    places = np.append(0, np.cumsum(more + 1))
    out = np.full(places[-1], 255, np.uint8)
    out[places[1:] - 1] = rest
    return out, places


def unpacked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, how many of them end before each byte and in all)."""
    last = data != 255
    ends = np.flatnonzero(last)
    return 255 * (np.diff(ends, prepend=-1) - 1) + data[ends], np.append(0, np.cumsum(last))


def _align(vocabulary: str, pieces: str):
    """Texts of one range each."""

    def run(batches):
        for batch in batches:
            for at, texts in array_slices(batch, "text", SLICE):
                spaced = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(pa.scalar(" "), texts, ""))
                a, b, _ = both_sides(vocabulary, pieces, *text_bytes(spaced))
                closed_a, closed_b = np.flatnonzero(a.closes), np.flatnonzero(b.closes)
                sizes, upto = packed(_group_sizes(closed_a, closed_b).ravel())
                groups = np.searchsorted(closed_a, a.at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, len(texts)), binary_array(a.ids.view(np.uint8), 2 * a.at), binary_array(b.ids.view(np.uint8), 2 * b.at), binary_array(sizes, upto[2 * groups])],
                    ["id", "a", "b", "sizes"],
                )
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return run


def byte_ranges(n: int, safe: np.ndarray, step: int) -> list[tuple[int, int, int, int]]:
    """(low, high, first, last) of the ranges of a text of ``n`` bytes: tokens that end in (low, high], found in the bytes [first, last).

    ``safe`` are the places where both vocabularies cut, 0 among them.
    """
    out = []
    low = 0
    while low < n:
        high = min(n, low + step)
        k = int(np.searchsorted(safe, high))
        last = int(safe[k]) if k < len(safe) else n
        if last - high > step:  # a long part that cannot be cut stays with this range
            high = last
        out.append((low, high, int(safe[np.searchsorted(safe, low, side="right") - 1]), last))
        low = high
    return out


def _ranges(vocabulary: str, pieces: str, step: int):
    def run(batches):
        for batch in batches:
            rows, ids = batch.column("row").to_pylist(), batch.column("id").to_pylist()
            for k, text in enumerate(batch.column("text")):
                data = np.frombuffer(b" " + text.as_buffer().to_pybytes(), np.uint8)
                safe = encoder(vocabulary, ByteEncoder).cuts(data) & encoder(pieces, PieceEncoder).cuts(data)
                safe[0] = True
                found = byte_ranges(len(data), np.flatnonzero(safe), step)
                for i in range(0, len(found), 64):
                    some = found[i : i + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([rows[k]] * len(some), pa.int64()), pa.array([ids[k]] * len(some), pa.int64()), pa.array(range(i, i + len(some)), pa.int64()), pa.array([len(found)] * len(some), pa.int64()),
                         pa.array([low - first for low, _, first, _ in some], pa.int64()), pa.array([high - first for _, high, first, _ in some], pa.int64()),
                         pa.array([data[first:last].tobytes() for _, _, first, last in some], pa.binary())],
                        ["row", "id", "part", "parts", "low", "high", "bytes"],
                    )

    return run


def fragment(a_ids: np.ndarray, b_ids: np.ndarray, closed_a: np.ndarray, closed_b: np.ndarray) -> dict[str, np.ndarray]:
    """The fragment of a range's tokens; ``closed_*`` are the places of those that end together."""
    none = a_ids[:0]
    if not len(closed_a):
        return dict(zip(_PARTS, (a_ids, b_ids, none, none, np.zeros((0, 2), np.uint32), none, none))) | {"cut": False}
    (fa, la), (fb, lb) = closed_a[[0, -1]] + 1, closed_b[[0, -1]] + 1
    sizes = _group_sizes(closed_a, closed_b)[1:]
    return dict(zip(_PARTS, (a_ids[:fa], b_ids[:fb], a_ids[fa:la], b_ids[fb:lb], sizes, a_ids[la:], b_ids[lb:]))) | {"cut": True}


def compose(x: dict, y: dict) -> dict:
    """The fragment of two adjacent ranges."""
    both = lambda *parts: np.concatenate(parts)
    if not x["cut"]:
        return y | {"prefix_a": both(x["prefix_a"], y["prefix_a"]), "prefix_b": both(x["prefix_b"], y["prefix_b"])}
    if not y["cut"]:
        return x | {"suffix_a": both(x["suffix_a"], y["prefix_a"]), "suffix_b": both(x["suffix_b"], y["prefix_b"])}
    middle_a, middle_b = both(x["suffix_a"], y["prefix_a"]), both(x["suffix_b"], y["prefix_b"])
    return x | {
        "closed_a": both(x["closed_a"], middle_a, y["closed_a"]),
        "closed_b": both(x["closed_b"], middle_b, y["closed_b"]),
        "sizes": both(x["sizes"], np.array([[len(middle_a), len(middle_b)]], np.uint32), y["sizes"]),
        "suffix_a": y["suffix_a"],
        "suffix_b": y["suffix_b"],
    }


def _fragment_rows(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (row, id, part, valid, fragment)."""
    head = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))]
    cut = pa.array([r[4]["cut"] for r in rows], pa.bool_())
    return pa.RecordBatch.from_arrays([*head, cut, *[pa.array([_bytes_of(r[4][c]) for r in rows], pa.binary()) for c in _PARTS]], ["row", "id", "part", "valid", "cut", *_PARTS])


def _read_fragment(row: dict) -> dict:
    out = {c: np.frombuffer(row[c], np.uint16) for c in _PARTS if c != "sizes"}
    return out | {"sizes": np.frombuffer(row["sizes"], np.uint32).reshape(-1, 2), "cut": row["cut"]}


def _fragments(vocabulary: str, pieces: str):
    def run(batches):
        for batch in batches:
            for at, segments in array_slices(batch, "bytes", SLICE):
                a, b, valid = both_sides(vocabulary, pieces, *text_bytes(segments))
                rows = []
                keys = batch.select(["row", "id", "part", "low", "high"]).slice(at, len(segments)).to_pylist()
                for k, key in enumerate(keys):
                    inside = []
                    for side in (a, b):
                        s = slice(int(side.at[k]), int(side.at[k + 1]))
                        first = side.ends[s.start] - side.sizes[s.start] if s.stop > s.start else 0
                        ours = (side.ends[s] - first > key["low"]) & (side.ends[s] - first <= key["high"])
                        inside.append((side.ids[s][ours], np.flatnonzero(side.closes[s][ours])))
                    (ids_a, closed_a), (ids_b, closed_b) = inside
                    rows.append((key["row"], key["id"], key["part"], bool(valid[k]), fragment(ids_a, ids_b, closed_a, closed_b)))
                yield _fragment_rows(rows)

    return run


def _composed(found: pa.Table) -> tuple[dict, bool, dict]:
    """(first row, whether all are valid, fragment) of adjacent fragments."""
    rows = sorted(found.to_pylist(), key=lambda r: r["part"])
    whole = _read_fragment(rows[0])
    for r in rows[1:]:
        whole = compose(whole, _read_fragment(r))
    return rows[0], all(r["valid"] for r in rows), whole


def _compose_group(found: pa.Table) -> pa.Table:
    first, valid, whole = _composed(found)
    return pa.Table.from_batches([_fragment_rows([(first["row"], first["id"], first["part"] // ARITY, valid, whole)])])


def _compose_text(found: pa.Table) -> pa.Table:
    """The last level: the prefix of a whole text is its first group."""
    first, valid, x = _composed(found)
    a, b = np.concatenate([x["prefix_a"], x["closed_a"]]), np.concatenate([x["prefix_b"], x["closed_b"]])
    sizes, _ = packed(np.concatenate([np.array([[len(x["prefix_a"]), len(x["prefix_b"])]], np.uint32), x["sizes"]]).ravel())
    return pa.Table.from_arrays([pa.array([first["id"]], pa.int64()), *[pa.array([_bytes_of(v) if valid else b""], pa.binary()) for v in (a, b, sizes)]], ["id", "a", "b", "sizes"])


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pieces: str | None = None, range_bytes: int = RANGE) -> DataFrame:
    """(id, a, b, sizes) per document, written to the shared folder.

    ``a`` and ``b`` are its ids by the two vocabularies (little-endian, 16 bits),
    ``sizes`` the numbers of A and B tokens of each group (``unpacked`` reads them).
    """
    spark = docs.sparkSession
    ship(spark)
    paths = vocabulary or default_vocabulary(), pieces or default_pieces()
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), text_of(text_col).alias("text"))
    short = texts.filter(F.octet_length("text") < range_bytes).mapInArrow(_align(*paths), _ALIGNED)
    long = texts.filter(F.octet_length("text") >= range_bytes).select(F.monotonically_increasing_id().alias("row"), "*")
    ranges = written(long.mapInArrow(_ranges(*paths, range_bytes), "row bigint, id bigint, part bigint, parts bigint, low bigint, high bigint, bytes binary"), "byte-ranges")
    most = ranges.agg(F.max("parts")).first()[0]
    if not most:
        return written(short, "aligned")
    found = ranges.repartition(shuffle_partitions(spark), "row", "part").mapInArrow(_fragments(*paths), _FRAGMENT)
    while most > ARITY:
        found = found.groupBy("row", F.floor(F.col("part") / ARITY).alias("node")).applyInArrow(_compose_group, _FRAGMENT)
        most = -(-most // ARITY)
    return written(short.union(found.groupBy("row").applyInArrow(_compose_text, _ALIGNED)), "aligned")


def _closing(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The last id of each group."""
    return ids[np.cumsum(sizes) - 1]


def _flat(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    data, places = text_bytes(column)
    return np.ascontiguousarray(data).view(dtype), places // np.dtype(dtype).itemsize


def _parts(batch: pa.RecordBatch):
    """Slices of aligned documents: (first row, number, a, b, sizes) with places of each."""
    for at, a in array_slices(batch, "a", SLICE // 2):
        n = len(a)
        data, places = text_bytes(batch.column("sizes").slice(at, n))
        sizes, upto = unpacked(data)
        yield at, n, _flat(a, np.uint16), _flat(batch.column("b").slice(at, n), np.uint16), (sizes.reshape(-1, 2), upto[places] // 2)


def _pairs(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The linked pair of each group: A's id times 2^16 plus B's."""
    return (_closing(a, sizes[:, 0]).astype(np.int64) << 16) | _closing(b, sizes[:, 1])


def _count_pairs(batches):
    seen, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        for _, _, (a, _), (b, _), (sizes, _) in _parts(batch):
            found, n = np.unique(_pairs(a, b, sizes), return_counts=True)
            seen, back = np.unique(np.concatenate([seen, found]), return_inverse=True)
            total = np.zeros(len(seen), np.int64)
            np.add.at(total, back, np.concatenate([counts, n]))
            counts = total
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts)], ["pair", "n"])


def pair_counts(aligned: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(pairs in ascending order, corpus-wide number of links of each); at most ``most_pairs``."""
    found = aligned.select("a", "b", "sizes").mapInArrow(_count_pairs, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs, counts = found.column("pair").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(pairs)
    return pairs[order], counts[order]


def most_pairs(vocabulary: str | None = None, pieces: str | None = None) -> int:
    """How many pairs of ids can end together: one token's bytes are a suffix of the other's."""
    a, b = ([t for t in encoder(p, k).token_bytes() if t] for k, p in ((ByteEncoder, vocabulary or default_vocabulary()), (PieceEncoder, pieces or default_pieces())))
    total = 0
    for longer, shorter, proper in ((a, b, 0), (b, a, 1)):
        number: dict[bytes, int] = {}
        for t in shorter:
            number[t] = number.get(t, 0) + 1
        total += sum(number.get(t[i:], 0) for t in longer for i in range(proper, len(t)))
    return total


@lru_cache(maxsize=1)
def _printed_ids() -> pa.Array:
    """Each id as text, followed by a comma, a bar or a semicolon."""
    return pa.array([f"{i}{mark}" for i in range(1 << 16) for mark in ",|;"])


def printed_groups(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2,b3;`` of all groups as bytes, and the place of each group's first byte and of the end."""
    if not len(sizes):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    na, nb = sizes[:, 0], sizes[:, 1]
    upto_a, upto_b = np.cumsum(na), np.cumsum(nb)
    codes = np.zeros(len(a) + len(b), np.int64)
    mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    mark_a[upto_a - 1], mark_b[upto_b - 1] = 1, 2
    codes[np.arange(len(a)) + np.repeat(upto_b - nb, na)] = a.astype(np.int64) * 3 + mark_a
    codes[np.arange(len(b)) + np.repeat(upto_a, nb)] = b.astype(np.int64) * 3 + mark_b
    data, at = text_bytes(_printed_ids().take(pa.array(codes)))
    return data, at[np.append(0, upto_a + upto_b)]


def _summaries(counts):
    def run(batches):
        pairs, number = counts.value
        b_of = pairs & 0xFFFF
        most = np.zeros(1 << 16, np.int64)
        np.maximum.at(most, b_of, number)
        best = number == most[b_of]
        for batch in batches:
            for at, n, (a, at_a), (b, at_b), (sizes, groups) in _parts(batch):
                k = np.searchsorted(pairs, _pairs(a, b, sizes))
                sums = [np.append(0, np.cumsum(v))[groups] for v in (best[k].astype(np.int64), number[k])]
                printed, places = printed_groups(a, b, sizes)
                ends = places[groups]
                digests = [hashlib.sha256(printed[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(ends.tolist(), ends[1:].tolist())]
                numbers = [np.diff(v) for v in (at_a, at_b, groups, groups, *sums)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, n), *[pa.array(v, pa.int64()) for v in numbers], pa.array(digests, pa.string())],
                    ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                )

    return run


def summaries(aligned: DataFrame) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per aligned document."""
    spark = aligned.sparkSession
    ship(spark)
    counts = spark.sparkContext.broadcast(pair_counts(aligned))
    return aligned.mapInArrow(_summaries(counts), "id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
