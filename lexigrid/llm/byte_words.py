"""Words of Arrow text columns, found as runs of bytes by array operations.

A class of bytes says what a word is made of; bytes of 0x80 and above belong to every
class, so a character of more than one byte is never cut. A to Z become a to z.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def byte_class(digits: bool) -> np.ndarray:
    """Byte -> byte of a word, lower-cased; 0 for bytes between words."""
    table = np.zeros(256, np.uint8)
    for first, last in ((0x61, 0x7A), (0x80, 0xFF)) + (((0x30, 0x39),) if digits else ()):
        table[first : last + 1] = np.arange(first, last + 1)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


class Words:
    """Words of a column: each ends with a space in ``body`` and begins at its place of ``at``.

    ``row`` has the first word of each text, and the number of words at its end.
    """

    __slots__ = ("at", "body", "row")

    def __init__(self, texts: pa.Array, table: np.ndarray) -> None:
        offsets, data = _bytes_of(texts)
        made = table[data]
        inside = made != 0
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        after, before = np.zeros(len(data), bool), np.zeros(len(data), bool)
        after[1:], before[:-1] = inside[:-1], inside[1:]
        after[edges] = before[edges - 1] = False
        starts = np.flatnonzero(inside & ~after)
        sizes = np.flatnonzero(inside & ~before) + 1 - starts
        self.at = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(sizes + 1, out=self.at[1:])
        self.body = np.full(int(self.at[-1]), 0x20, np.uint8)
        self.body[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(starts)), sizes)] = made[inside]
        self.row = np.searchsorted(starts, offsets)

    def __len__(self) -> int:
        return len(self.at) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.row)

    def left(self) -> np.ndarray:
        """For each word, how many words its text has from it on."""
        return np.repeat(self.row[1:], self.counts()) - np.arange(len(self))

    def joined(self, first: int, n: int) -> bytes:
        """``n`` words joined by one space."""
        return self.body[self.at[first] : self.at[first + n] - 1].tobytes()

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word; equal words have equal hashes, whatever the batch."""
        if not len(self):
            return np.empty(0, np.uint64)
        sizes = np.diff(self.at)
        power = np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64)
        power[0] = 1
        power = np.cumprod(power, dtype=np.uint64)
        inner = np.arange(len(self.body)) - np.repeat(self.at[:-1], sizes)
        return mixed(np.add.reduceat(self.body.astype(np.uint64) * power[inner], self.at[:-1]))

    def strings(self) -> pa.Array:
        """The words as they stand in ``body``, with the space."""
        return pa.Array.from_buffers(pa.large_string(), len(self), [None, pa.py_buffer(self.at), pa.py_buffer(self.body)])


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over all of their places."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of all texts; null texts are empty."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(len(texts) + 1, np.int64), np.empty(0, np.uint8)
    offsets = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return offsets - offsets[0], np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
