"""Token ids of whole texts, encoded by chunk and gathered as arrays.

A chunk is a part of a text whose ids do not depend on what stands around it.
The byte-level vocabulary's pre-tokenizer never joins a character with white
space that follows it, nor a letter or digit with an ASCII character of another
class that follows it; the piece vocabulary never merges two characters that
stand beside each other in none of its pieces. Texts are cut there, by one table
look-up per byte, and the ids of a text are those of its chunks in order.

Chunks repeat (most are words): a batch's distinct chunks are found by one
dictionary encoding, those that the worker does not know yet are encoded by the
tokenizer's library, and the ids of the whole batch are gathered at once. A
worker that knows ``KEPT_CHUNKS`` chunks or ``KEPT_BYTES`` bytes of them keeps those met in
most batches, whatever the size of the corpus.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEPT_CHUNKS, KEPT_BYTES = 500_000, 1 << 25
SLICE = 1 << 23  # bytes of text encoded together
# A chunk that is one pre-token by itself: plain letters, at most one space before them.
_PLAIN = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
END = 0  # the id that ends a document


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary.

    Printing Latin-1 characters stand for themselves, the other bytes for the
    characters from 256 on, in order.
    """
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in own else next(others)) for b in range(256)}


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, place of each text's first byte and of the end); null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The parts of ``data`` between ``offsets`` as a binary array, without a copy."""
    if offsets[-1] < 1 << 31:
        return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), 0x9E3779B97F4A7C15, np.uint64)  # any odd number
    out[0] = 1
    return np.cumprod(out)


def hashes_of(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each binary value; that of the empty one is zero."""
    data, at = text_bytes(values)
    sizes = np.diff(at)
    inside = np.arange(len(data)) - np.repeat(at[:-1], sizes)
    terms = (data.astype(np.uint64) + np.uint64(1)) * _powers(int(sizes.max(initial=0)))[inside]
    h = np.zeros(len(sizes), np.uint64)
    if len(data):
        h[sizes > 0] = np.add.reduceat(terms, at[:-1][sizes > 0])
    return h ^ (h >> np.uint64(32))


class BytesTable:
    """Numbers of distinct (non-empty, or one empty) binary values, found by hash and then compared."""

    def __init__(self, keys: pa.Array):
        self.keys = keys.cast(pa.binary())
        hashes = hashes_of(self.keys)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]

    def find(self, values: pa.Array) -> np.ndarray:
        """Number of each value, or -1."""
        out = np.full(len(values), -1)
        if len(self.hashes):
            hashes = hashes_of(values)
            place = np.searchsorted(self.hashes, hashes)
            place[place == len(self.hashes)] = 0
            same = np.flatnonzero(self.hashes[place] == hashes)
            number = self.order[place[same]]
            equal = pc.equal(self.keys.take(pa.array(number)), values.take(pa.array(same)).cast(pa.binary())).to_numpy(zero_copy_only=False)
            out[same[equal]] = number[equal]
        return out

    def add(self, values: pa.Array) -> None:
        hashes = hashes_of(values)
        by = np.argsort(hashes, kind="stable")
        at = np.searchsorted(self.hashes, hashes[by], side="right")
        self.hashes = np.insert(self.hashes, at, hashes[by])
        self.order = np.insert(self.order, at, len(self.keys) + by)
        self.keys = pa.concat_arrays([self.keys, values.cast(pa.binary())])


class ChunkEncoder:
    """Ids of texts by way of the ids of their distinct chunks."""

    def __init__(self):
        self.known = BytesTable(pa.array([], pa.binary()))
        self.ids = np.zeros(0, np.uint16)
        self.starts, self.sizes, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """For each byte whether a chunk starts there (texts start chunks anyway)."""
        raise NotImplementedError

    def encode_chunks(self, chunks: list[bytes]) -> list[list[int]]:
        raise NotImplementedError

    def _learn(self, chunks: pa.Array) -> None:
        found = self.encode_chunks(chunks.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint16, int(sizes.sum()))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids = np.concatenate([self.ids, flat])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.met = np.concatenate([self.met, np.zeros(len(sizes), np.int64)])
        self.known.add(chunks)

    def _thin_out(self) -> None:
        """Keep the chunks met in most batches, half of ``KEPT_CHUNKS`` and of ``KEPT_BYTES`` at most."""
        by = np.argsort(-self.met, kind="stable")[: KEPT_CHUNKS // 2]
        by = by[np.cumsum(np.asarray(pc.binary_length(self.known.keys))[by]) <= KEPT_BYTES // 2]
        by.sort()
        sizes = self.sizes[by]
        ends = np.cumsum(sizes)
        self.ids = self.ids[np.arange(int(sizes.sum())) + np.repeat(self.starts[by] - ends + sizes, sizes)]
        self.starts, self.sizes, self.met = ends - sizes, sizes, self.met[by] // 2
        self.known = BytesTable(self.known.keys.take(pa.array(by)))

    def encode(self, data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as 16-bit integers, place of each text's first id and of the end)."""
        if not len(data):
            return np.zeros(0, np.uint16), np.zeros(len(places), np.int64)
        if len(self.known.keys) > KEPT_CHUNKS or self.known.keys.nbytes > KEPT_BYTES:
            self._thin_out()
        starts = self.cuts(data)
        starts[places[:-1][places[:-1] < len(data)]] = True
        at = np.flatnonzero(starts)
        coded = binary_array(data, np.append(at, len(data))).dictionary_encode()
        distinct = coded.dictionary
        found = self.known.find(distinct)
        if len(new := np.flatnonzero(found < 0)):
            found[new] = np.arange(len(self.known.keys), len(self.known.keys) + len(new))
            self._learn(distinct.take(pa.array(new)))
        self.met[found] += 1
        chunk = found[coded.indices.to_numpy()]
        sizes = self.sizes[chunk]
        ends = np.cumsum(sizes)
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.starts[chunk] - ends + sizes, sizes)]
        return ids, np.append(0, ends)[np.searchsorted(at, places)]


# The ASCII white space of the vocabulary's pattern, and the last
# bytes of all white space outside ASCII.
_SPACES = [9, 10, 11, 12, 13, 32]
_WIDE_SPACE_ENDS = [0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F]


def _class_changes() -> np.ndarray:
    """[byte, next byte] -> whether the byte-level pre-tokenizer always cuts between them.

    The first byte of a letter of two bytes comes as 0xFF, its second as ``a``.
    """
    kind = np.full(256, 4, np.int8)  # 4: punctuation and the like
    kind[[b for b in range(128) if chr(b).isalpha()]] = 1
    kind[48:58] = 2
    kind[_SPACES] = 3
    kind[128:] = 0
    table = np.zeros((256, 256), bool)
    for kinds, followers in (((1,), (2, 3, 4)), ((2,), (1, 3, 4)), ((4,), (3,))):
        table |= np.isin(kind, kinds)[:, None] & np.isin(kind, followers)[None, :]
    wide = kind == 0
    wide[[*_WIDE_SPACE_ENDS, 0xFF]] = False
    return table | (wide[:, None] & (kind == 3)[None, :])


class ByteEncoder(ChunkEncoder):
    """A byte-level vocabulary of the tokenizers library; special tokens' strings are ordinary text."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit into 16 bits")
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.table = _class_changes().ravel()

    def cuts(self, data):
        seen = data
        lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))  # letters of two bytes, but for two signs
        if len(lead):
            second = data[lead + 1]
            lead = lead[(data[lead] != 0xC3) | ((second != 0x97) & (second != 0xB7))]
            seen = data.copy()
            seen[lead], seen[lead + 1] = 0xFF, ord("a")
        out = np.empty(len(data), bool)
        out[:1] = True
        out[1:] = self.table[(seen[:-1].astype(np.uint16) << 8) | seen[1:]]
        return out

    def encode_chunks(self, chunks):
        """Single pre-tokens go straight to the model, others through all steps."""
        plain, tokenize, letters = _PLAIN.fullmatch, self.model.tokenize, self.letters
        out = [[t.id for t in tokenize(c.decode("latin-1").translate(letters))] if plain(c) else None for c in chunks]
        others = [c.decode() for c, ids in zip(chunks, out) if ids is None]
        whole = iter(self.tokenizer.encode_batch_fast(others, add_special_tokens=False))
        return [next(whole).ids if ids is None else ids for ids in out]

    def token_bytes(self) -> list[bytes]:
        """The bytes that each id stands for (special tokens: their string)."""
        back = {ord(c): b for b, c in self.letters.items()}
        out = []
        for i in range(self.tokenizer.get_vocab_size()):
            token = self.tokenizer.id_to_token(i)
            out.append(bytes(back[ord(c)] for c in token) if all(ord(c) in back for c in token) else token.encode())
        return out


class PieceEncoder(ChunkEncoder):
    """A piece vocabulary of the sentencepiece library, for texts to which the leading space is already added."""

    def __init__(self, path: str):
        super().__init__()
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        if self.model.get_piece_size() > 1 << 16:
            raise ValueError("ids do not fit into 16 bits")
        # A line feed before a chunk keeps the library's own leading mark away from it.
        self.before = self.model.encode("\n")
        self.table = self._apart().ravel()

    def _plain(self) -> Iterator[str]:
        model = self.model
        for i in range(model.get_piece_size()):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
                yield model.id_to_piece(i).replace("▁", " ")

    def _apart(self) -> np.ndarray:
        """[byte, next byte] -> whether no piece holds the two characters beside each other."""
        together = np.zeros((256, 256), bool)
        together[128:, :] = together[:, 128:] = True
        together[:, 32] = False
        together["▁".encode()[-1], 32] = True  # in a text the mark itself is taken for a space
        for piece in self._plain():
            for a, b in zip(piece, piece[1:]):
                if b == " " and ord(a) > 127:
                    together[128:, 32] = True
                elif ord(a) < 128 and ord(b) < 128:
                    together[ord(a), ord(b)] = True
        return ~together

    def cuts(self, data):
        out = np.empty(len(data), bool)
        out[:1] = True
        out[1:] = self.table[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        return out

    def encode_chunks(self, chunks):
        skip = len(self.before)
        return [ids[skip:] for ids in self.model.encode([f"\n{c.decode()}" for c in chunks], num_threads=1)]

    def token_bytes(self) -> list[bytes]:
        model = self.model
        out = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
        return out


_encoders: dict[tuple[type, str], ChunkEncoder] = {}


def encoder(path: str, kind: type[ChunkEncoder] = ByteEncoder) -> ChunkEncoder:
    """The encoder of this worker process for a vocabulary file."""
    if (kind, path) not in _encoders:
        _encoders[kind, path] = kind(path)
    return _encoders[kind, path]


def ended(ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and places with END after each text."""
    n = len(places) - 1
    own = np.ones(len(ids) + n, bool)
    own[places[1:] + np.arange(n)] = False
    out = np.full(len(own), END, np.uint16)
    out[own] = ids
    return out, places + np.arange(n + 1)


def encode_texts(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, each with END after it, and the texts' places)."""
    return ended(*encoder(path).encode(*text_bytes(texts)))


def array_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of parts of a batch of at most ``limit`` bytes, or one text."""
    texts = batch.column(column)
    sizes = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0)).astype(np.int64))
    at = 0
    while at < len(texts):
        before = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield at, texts.slice(at, to - at)
        at = to


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[tuple[int, list[str]]]:
    """As ``array_slices``, with the texts as a list."""
    for at, texts in array_slices(batch, column, limit):
        yield at, texts.to_pylist()
