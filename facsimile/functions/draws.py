"""The keyed uniforms of ``rand`` for arrays of ids, as numpy.

``hashlib`` takes a microsecond a draw. A key of one md5 block (at most 55 bytes)
is hashed here for all ids together: the 64 steps of md5 on columns of 32-bit
words, of which only those with the id's digits differ from row to row.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

from facsimile.functions.rand import TWO_52

# The constants of md5 (RFC 1321).
SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
PLACES = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
BLOCK = 55  # bytes of a key that fit one block
POWERS = 10 ** np.arange(1, 19, dtype=np.int64)


def _first_words(fixed: list[int], of_row: dict[int, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the md5 of ``n`` blocks; ``of_row`` is added to the ``fixed`` words."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in BEGIN)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i, (shift, sine, place) in enumerate(zip(SHIFTS, SINES, PLACES)):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(a, f, out=a)
        np.add(a, np.uint32((fixed[place] + sine) & 0xFFFFFFFF), out=a)
        if place in of_row:
            np.add(a, of_row[place], out=a)
        np.left_shift(a, np.uint32(shift), out=g)
        np.right_shift(a, np.uint32(32 - shift), out=a)
        np.bitwise_or(a, g, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return a + np.uint32(BEGIN[0]), b + np.uint32(BEGIN[1])


class Draws:
    """``uniform`` of (key, id, tag) for ``ids``, one array for each tag asked for."""

    def __init__(self, key: str, ids: np.ndarray):
        self.key, self.ids = key.encode(), ids
        self.parts = []  # (rows, digits, their words): ids of as many digits have their keys' bytes in the same places
        digits = np.searchsorted(POWERS, ids, side="right") + 1
        for d in np.unique(digits[ids >= 0]).tolist():
            rows = np.flatnonzero((digits == d) & (ids >= 0))
            rest, words = ids[rows], {}
            for at in range(len(self.key) + d - 1, len(self.key) - 1, -1):
                rest, digit = np.divmod(rest, 10)
                byte = (digit + 48).astype(np.uint32) << np.uint32(8 * (at % 4))
                words[at // 4] = words[at // 4] + byte if at // 4 in words else byte
            self.parts.append((rows, d, words))

    def uniform(self, tag: str) -> np.ndarray:
        out, end = np.empty(len(self.ids), np.float64), f":{tag}".encode()
        left = [np.flatnonzero(self.ids < 0)]
        for rows, d, words in self.parts:
            size = len(self.key) + d + len(end)
            if size > BLOCK:
                left.append(rows)
                continue
            block = self.key + bytes(d) + end + b"\x80" + bytes(BLOCK - size) + (8 * size).to_bytes(8, "little")
            a, b = _first_words(np.frombuffer(block, "<u4").tolist(), words, len(rows))
            out[rows] = (a.byteswap().astype(np.uint64) << np.uint64(20)) | (b.byteswap() >> np.uint32(12))
        for i in np.concatenate(left).tolist():
            out[i] = int(hashlib.md5(self.key + b"%d" % self.ids[i] + end).hexdigest()[:13], 16)
        return out / TWO_52
