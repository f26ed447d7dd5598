"""Word and shingle hashes of many texts at once, as numpy arrays over the bytes of an Arrow column.

Hashes are chains of a mixer over 8 bytes at a time; equal strings have equal hashes everywhere.  Where a result depends
on two strings being equal, users compare what has equal hashes (`alike`).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def trim() -> None:
    """Gives freed memory back to the system at the end of a task: worker processes live on, and others need it."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


class Block(NamedTuple):
    """Some whole texts: rows [first, last) of the column; text i is data[at[i]:at[i + 1]]."""

    first: int
    last: int
    data: np.ndarray
    at: np.ndarray


def blocks(column: pa.Array, size: int = 1 << 19) -> Iterator[Block]:
    """Runs of whole texts of about `size` bytes (a longer text is a block of its own); null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield Block(first, last, data[at[first] : at[last]], at[first : last + 1] - at[first])
        first = last


#: Ranges beyond this are hashed one by one.
LONG = 1024
MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], U)


class Hasher:
    """Hashes of any ranges of a block's bytes.

    Two ranges of up to 7 bytes have one hash only if they are equal, and none has that of a longer one: their bytes and length go
    through bijections alone.  Of longer ones, 63 bits are left of a chain over all their bytes.
    """

    def __init__(self, data: np.ndarray) -> None:
        self.data = np.concatenate((data, np.zeros(8, np.uint8)))
        self.eight = np.ndarray(len(data) + 1, "<u8", self.data, strides=(1,))  # one from each byte on

    def read(self, at: np.ndarray) -> np.ndarray:
        """The 8 bytes from each place on, zeros after the last, as one number."""
        return self.eight[at]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        start, n = np.asarray(start, np.int64), np.asarray(end - start, np.int64)
        first = np.minimum(n, 8)
        out = self.read(start) & MASKS[first]
        short = n < 8
        out[short] |= n[short].astype(U) << U(56)
        some = np.flatnonzero(~short)
        if len(some):
            far = some[n[some] > LONG]
            held = mix(mix(out[some] ^ U(BASE)) + n[some].astype(U))
            at = 8
            going = np.flatnonzero((n[some] > at) & (n[some] <= LONG))
            while len(going):
                who = some[going]
                held[going] = mix(held[going] * U(0xD1342543DE82EF95) ^ (self.read(start[who] + at) & MASKS[np.minimum(n[who] - at, 8)]))
                at += 8
                going = going[n[who] > at]
            out[some] = held
            for i in far.tolist():
                out[i] = xxhash.xxh3_64_intdigest(self.data[start[i] : start[i] + n[i]].tobytes())
            out[some] |= U(1 << 63)
        return mix(out)


def gather(flat: np.ndarray, begin: np.ndarray, length: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs flat[begin[k] : begin[k] + length[k]] for each k of at, one after the other; no run is empty."""
    n = length[at]
    ends = np.cumsum(n)
    if not len(ends):
        return np.zeros(0, flat.dtype)
    step = np.ones(int(ends[-1]), np.int64)
    first = begin[at]
    step[0] = first[0]
    step[ends[:-1]] = first[1:] - (first[:-1] + n[:-1] - 1)
    return flat[np.cumsum(step, out=step)]


def alike(one: tuple[np.ndarray, np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether range k of one (data, start, length) has the bytes of range k of the other, for each k."""
    (data, start, n), (data2, start2, n2) = one, other
    out = n == n2
    some = np.flatnonzero(out & (n > 0))
    if len(some):
        every = np.arange(len(some))
        same = gather(data, start[some], n[some], every) == gather(data2, start2[some], n[some], every)
        if not same.all():
            ends = np.cumsum(n[some])
            out[some] = np.logical_and.reduceat(same, ends - n[some])
    return out


def words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of words before it (one more entry at the end)."""
    ink = ~SPACE[block.data]
    cut = np.zeros(len(ink) + 1, bool)
    cut[block.at] = True
    before = np.concatenate(([False], ink[:-1])) if len(ink) else ink
    start = np.flatnonzero(ink & (~before | cut[:-1]))
    after = np.concatenate((ink[1:], [False])) if len(ink) else ink
    end = np.flatnonzero(ink & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(start, block.at)


def shingles(word: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words inside a text, and each text's first shingle; a shorter text is one shingle."""
    count = np.diff(first)
    per = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    begin = np.concatenate(([0], np.cumsum(per)))
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], per) + np.repeat(first[:-1], per)
    left = np.repeat(np.minimum(count, size), per)
    out = np.zeros(len(at), U)
    padded = np.concatenate((word, np.zeros(size, U)))
    for k in range(size):
        out = np.where(k < left, (out + padded[at + k]) * U(BASE | 1) ^ (out >> U(29)), out)
    return mix(out), begin
