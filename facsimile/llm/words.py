"""Words of many texts as arrays: places, codes and keys, found by byte tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from facsimile.llm.tokens import binary_array, text_bytes


def byte_table(wanted) -> np.ndarray:
    """[byte] -> whether ``wanted`` (of the byte's number) holds."""
    return np.array([bool(wanted(b)) for b in range(256)])


# ASCII white space separates words; or all of ASCII but digits and small letters does.
BETWEEN_SPACES = byte_table(lambda b: b not in (9, 10, 11, 12, 13, 32))
ALPHANUMERIC = byte_table(lambda b: 48 <= b < 58 or 97 <= b < 123 or b >= 128)


@dataclass
class Words:
    """Words of the texts of a batch, in order."""

    data: np.ndarray  # bytes of all texts
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after each word
    places: np.ndarray  # each text's first word, and the number of words
    codes: np.ndarray  # equal words have equal codes
    distinct: pa.Array  # word of each code

    @property
    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.places) - 1), np.diff(self.places))

    def lines(self, first: np.ndarray, size: int) -> pa.Array:
        """The ``size`` words from each of the words ``first`` on, joined by spaces."""
        chosen = self.codes[(first[:, None] + np.arange(size)).ravel()] if len(first) else self.codes[:0]
        words = self.distinct.take(pa.array(chosen)).cast(pa.string())
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1) * size, pa.int32()), words), " ")


def find_words(texts: pa.Array, is_word: np.ndarray, lower: bool = False) -> Words:
    """Words are runs of bytes for which ``is_word`` holds; ``lower`` changes A-Z first."""
    data, at = text_bytes(texts)
    if lower:
        capital = (data - np.uint8(65)) < 26
        data = data | (capital.view(np.uint8) << 5)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = is_word[data]
    new_text = np.zeros(len(data) + 1, bool)
    new_text[at] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | new_text))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | new_text))
    sizes = np.append(0, np.cumsum(ends - starts))
    coded = binary_array(data[inside[1:-1]], sizes).dictionary_encode()
    return Words(data, starts, ends, np.searchsorted(starts, at), coded.indices.to_numpy().astype(np.int64), coded.dictionary)


def joined(words: Words, keep: np.ndarray) -> pa.Array:
    """For each text its words with ``keep``, joined by one space."""
    kept = np.flatnonzero(keep)
    places = np.searchsorted(kept, words.places)
    more = np.ones(len(kept), np.int64)  # another kept word follows in the text, so a separator does
    more[places[1:][places[1:] > places[:-1]] - 1] = 0
    starts, ends = words.starts[kept], words.ends[kept] + more
    part = np.zeros(len(words.data) + 1, np.int8)
    part[starts] += 1
    part[ends] -= 1
    part = np.cumsum(part[:-1], dtype=np.int8) > 0
    out = words.data[part]
    at = np.append(0, np.cumsum(ends - starts))
    out[at[1:][more > 0] - 1] = 32
    return binary_array(out, at[places]).cast(pa.string())
