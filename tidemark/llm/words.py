"""Vectorised word and window hashing over Arrow string columns.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D`` of the UTF-8
text, which is the same as the pattern ``[^\\x20\\x09-\\x0D]+`` on the text itself,
because no byte of a multi-byte character falls in that set. All hashing is
arithmetic on unsigned 64-bit numbers over whole Arrow buffers: there is no Python
loop over words, but for those of more than `PLACES` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once; a longer single text is a chunk of its own.
CHUNK_BYTES = 1 << 19
#: Bytes of a word that are hashed by table.
PLACES = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hash:
    """64-bit hashes of words, and of sequences of such hashes.

    A word's hash is the sum, mixed, of random numbers drawn for each (place in the word, byte):
    two words collide with probability 2**-64 whatever they look like. Words longer than `PLACES`
    bytes go through BLAKE2. Sequences are joined pair by pair with a bijective mixer after each
    step, so no repeating pattern of words cancels out, as it can in a polynomial.
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.key = seed.to_bytes(8, "little")
        self.table = rng.integers(0, 1 << 64, PLACES * 256, dtype=np.uint64)
        self.salt = rng.integers(0, 1 << 64, 2, dtype=np.uint64)

    def sums(self, places: np.ndarray) -> np.ndarray:
        """Running sums over the bytes of `Words.places`; a difference of two within one word is the sum of the bytes between."""
        out = np.zeros(len(places) + 1, np.uint64)
        np.cumsum(self.table.take(places, mode="clip"), out=out[1:])
        return out

    def words(self, words: Words, sums: np.ndarray | None = None) -> np.ndarray:
        """Hash of each word."""
        starts, ends = words.starts, words.ends
        sums = self.sums(words.places()) if sums is None else sums
        out = mix((sums[ends] - sums[starts]) ^ self.salt[0])
        for i in np.flatnonzero(ends - starts > PLACES).tolist():
            out[i] = int.from_bytes(blake2b(words.data[starts[i] : ends[i]].tobytes(), digest_size=8, key=self.key).digest(), "little")
        return out

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Hash of a sequence from those of its two parts."""
        turned = (right << np.uint64(29)) | (right >> np.uint64(35))
        return mix(left * np.uint64(0xD6E8FEB86659FD93) + turned + self.salt[1])

    def runs(self, values: np.ndarray, size: int) -> np.ndarray:
        """Hash of values[i : i + size] for each i from which there are so many."""
        out, power, width, done = None, values, 1, 0
        while True:
            if size & width:
                n = len(values) - done - width + 1
                if n <= 0:
                    return np.zeros(0, np.uint64)
                out = power[:n] if out is None else self.join(out[:n], power[done : done + n])
                done += width
            if done == size:
                return out
            power = self.join(power[: len(power) - width], power[width:]) if len(power) > width else power[:0]
            width *= 2

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of values[starts:ends] for each span of one value or more: of its first and last 2**k values and its length."""
        size = (ends - starts).astype(np.uint64)
        out = np.zeros(len(starts), np.uint64)
        power, width = values, 1
        while True:
            here = np.flatnonzero((size >= width) & (size < 2 * width))
            out[here] = mix(self.join(power[starts[here]], power[ends[here] - width]) ^ size[here])
            if not len(size) or size.max() < 2 * width:
                return out
            power = self.join(power[: len(power) - width], power[width:])
            width *= 2


#: Two independent ones.
FIRST, SECOND = Hash(11), Hash(12)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind, width = np.int32, 4
    else:
        kind, width = np.int64, 8
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, kind, len(column) + 1, column.offset * width).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes of text each (one row at least)."""
    if not len(column):
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64))
    row = 0
    while row < len(column):
        base = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, base + size, "right")))
        yield row, stop
        row = stop


class Words:
    """Word positions of one chunk of texts."""

    def __init__(self, column: pa.Array, lower: bool = False, letters: bool = False):
        """letters: a word is instead a run of ASCII letters, digits and non-ASCII bytes."""
        self.data, self.offsets = buffers(column)
        b = self.data
        if letters:
            inside = (b >= 128) | ((b | 32) - np.uint8(97) < 26) | (b - np.uint8(48) < 10)
        else:
            inside = (b != 32) & ((b < 9) | (b > 13))
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        first[edges] = inside[edges]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        tails = self.offsets[1:][self.offsets[:-1] < self.offsets[1:]] - 1
        last[tails] = inside[tails]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        #: Words before each text: text i has words at[i] .. at[i + 1].
        self.at = np.searchsorted(self.starts, self.offsets).astype(np.int64)
        self.at[-1] = len(self.starts)
        self._places: np.ndarray | None = None
        if lower:
            upper = (b >= 65) & (b <= 90)
            self.data = b + upper.astype(np.uint8) * np.uint8(32)

    def places(self) -> np.ndarray:
        """Row of a hash's table for each byte: its place in its word, modulo `PLACES`, and its value."""
        if self._places is None:
            n = len(self.data)
            begin = np.zeros(n, np.int32)
            begin[self.starts] = self.starts
            place = np.arange(n, dtype=np.int32) - np.maximum.accumulate(begin)
            self._places = (((place & (PLACES - 1)) << 8) | self.data).astype(np.int64)
        return self._places

    def hashes(self, by: Hash = FIRST) -> np.ndarray:
        return by.words(self)


def windows(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all ``size``-word windows inside single texts, and windows before each text."""
    counts = np.maximum(at[1:] - at[:-1] - size + 1, 0)
    before = np.concatenate([[0], np.cumsum(counts)])
    starts = np.arange(before[-1]) + np.repeat(at[:-1] - before[:-1], counts)
    return starts, before


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of ``size`` values; as long as x, its last size - 1 values are not meaningful."""
    out, have = x.copy(), 1
    while have < size:
        step = min(have, size - have)
        out[: len(out) - step] = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
