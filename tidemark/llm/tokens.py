"""Byte-level BPE ids of many texts at once, equal to the tokenizer's own.

The tokenizer splits a text by one fixed pattern and encodes each piece alone. Here
the split runs over the code points of a whole chunk of texts with numpy, equal
pieces are found by a 64-bit hash and their length, and each distinct piece is
encoded once and remembered. Each piece is compared, code point by code point, with the
one whose ids it takes; a text with two pieces of one hash goes to the tokenizer. Texts with characters for which the character classes
here are not certain (beyond Latin letters, or control characters) go to the
tokenizer as they are.
"""

from __future__ import annotations

import base64
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa

from tidemark.llm.words import mix

#: Code points with known classes: Basic Latin, Latin-1 and Latin Extended A and B; dashes, quotes and the like beyond.
KNOWN = 0x250
OTHER = {*range(0x2010, 0x2028), *range(0x2030, 0x205E), 0x20AC}
LETTER, NUMBER, SPACE, SIGN, UNKNOWN = range(5)
#: Distinct pieces that are remembered; beyond it the memory starts anew.
REMEMBERED = 1_000_000


def _class(point: int) -> int:
    if point in (9, 10, 11, 12, 13, 32, 0x85, 0xA0):
        return SPACE
    if point < 32 or 0x7F <= point < 0xA0:
        return UNKNOWN
    kind = unicodedata.category(chr(point))[0]
    return LETTER if kind == "L" else NUMBER if kind == "N" else SIGN


CLASSES = np.full(0x10000, UNKNOWN, np.uint8)
CLASSES[:KNOWN] = [_class(p) for p in range(KNOWN)]
CLASSES[list(OTHER)] = SIGN


def piece_hashes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of each piece: the sum of mixed (place in the piece, code point)."""
    n = len(points)
    place = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
    return mix(np.add.reduceat(mix(place.astype(np.uint64) << np.uint64(32) | points), starts))


def split(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces of texts given as code points; text i is points[offsets[i]:offsets[i + 1]].

    A run of letters, of numbers or of other signs is a piece and takes one space before
    it along. Of a run of white space, its last character is left to what follows
    (alone, unless it is a space). 's, 't, 're, 've, 'm, 'll and 'd are pieces where a
    piece starts with the apostrophe.
    """
    n = len(points)
    kind = CLASSES[np.minimum(points, 0xFFFF)]
    head = np.zeros(n + 1, bool)
    head[offsets] = True
    start = head[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    tail = np.ones(n, bool)
    tail[:-1] = start[1:]
    ends_text = head[1:]
    space = kind == SPACE
    closing = space & tail & ~ends_text
    # The last character of a white-space run before other text starts a piece of its own ...
    start |= closing
    # ... and if it is a space, the run after it belongs to that piece.
    joined = np.flatnonzero(closing & (points == 32)) + 1
    start[joined] = False
    marks = np.flatnonzero((points == 39) & start & (kind == SIGN))
    marks = marks[(marks + 1 < n)]
    marks = marks[(kind[marks + 1] == LETTER) & ~head[marks + 1]]
    if len(marks):
        one = points[marks + 1]
        two = np.where((marks + 2 < n) & ~head[np.minimum(marks + 2, n)], points[np.minimum(marks + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for which, length in ((marks[short], 2), (marks[long & ~short], 3)):
            start[which + 1] = False
            inside = which[which + length < n] + length
            start[inside] = True
    return np.flatnonzero(start)


class Encoder:
    """One for each worker process: the tokenizer, its ranks and the remembered pieces."""

    _own: dict[tuple[str, str], Encoder] = {}

    @classmethod
    def of(cls, tokenizer: str, ranks: str, pattern: str) -> Encoder:
        if (tokenizer, ranks) not in cls._own:
            cls._own[tokenizer, ranks] = cls(tokenizer, ranks, pattern)
        return cls._own[tokenizer, ranks]

    def __init__(self, tokenizer: str, ranks: str, pattern: str):
        import tiktoken

        self.path, self.whole = tokenizer, None
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = table
        self.encoding = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.forget()

    def forget(self) -> None:
        """Give up the remembered pieces."""
        self.known = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.at = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint16)
        self.points_at = np.zeros(1, np.int64)
        self.points = np.zeros(0, np.uint16)

    def _whole(self, text: str) -> np.ndarray:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
            self.whole.encode_special_tokens = True
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        found = [self.encoding.encode_ordinary(p) for p in pieces]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint16, int(lengths.sum()))])
        self.points_at = np.concatenate([self.points_at, self.points_at[-1] + np.cumsum(list(map(len, pieces)))])
        self.points = np.concatenate([self.points, np.frombuffer("".join(pieces).encode("utf-16-le"), np.uint16)])
        spot = np.searchsorted(self.known, hashes)  # hashes ascend, and none is known yet
        self.place = np.insert(self.place, spot, np.arange(len(self.at) - 1 - len(hashes), len(self.at) - 1))
        self.known = np.insert(self.known, spot, hashes)

    def _pieces(self, points: np.ndarray, starts: np.ndarray, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """Of each piece its place among the remembered ones, and whether it is really that one."""
        ends = np.append(starts[1:], len(points))
        with np.errstate(over="ignore"):
            hashes = piece_hashes(points, starts)
        distinct, first, code = np.unique(hashes, return_index=True, return_inverse=True)
        for _ in (0, 1):
            spot = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
            new = self.known[spot] != distinct if len(self.known) else np.ones(len(distinct), bool)
            if not new.any():
                break
            if len(self.known) + int(new.sum()) > REMEMBERED:
                self.forget()
                new[:] = True
            s, e = starts[first[new]].tolist(), ends[first[new]].tolist()
            self._learn(distinct[new], [joined[a:b] for a, b in zip(s, e, strict=True)])
        place = self.place[spot][code]
        begin, size = self.points_at[place], ends - starts
        same = size == self.points_at[place + 1] - begin
        at = np.minimum(np.repeat(begin - starts, size) + np.arange(len(points)), len(self.points) - 1)
        return place, same & np.logical_and.reduceat(self.points[at] == points, starts)

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a chunk (null: none), as uint32."""
        texts = column.to_pylist()
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        sure = []
        for i, text in enumerate(texts):
            if not text:
                continue
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            if (CLASSES[np.minimum(points, 0xFFFF)] == UNKNOWN).any():
                out[i] = self._whole(text)
            else:
                sure.append((i, text, points))
        if not sure:
            return out
        points = np.concatenate([p for _, _, p in sure])
        offsets = np.concatenate([[0], np.cumsum([len(p) for _, _, p in sure])])
        starts = split(points, offsets)
        piece, right = self._pieces(points, starts, "".join(t for _, t, _ in sure))
        low, count = self.at[piece], self.at[piece + 1] - self.at[piece]
        total = np.concatenate([[0], np.cumsum(count)])
        flat = self.ids[np.repeat(low - total[:-1], count) + np.arange(total[-1])].astype(np.uint32)
        pieces = np.searchsorted(starts, offsets)
        cuts = total[pieces]
        for (i, _, _), a, b in zip(sure, cuts[:-1], cuts[1:], strict=True):
            out[i] = flat[a:b]
        for k in np.unique(np.searchsorted(pieces, np.flatnonzero(~right), "right") - 1).tolist():
            out[sure[k][0]] = self._whole(sure[k][1])
        return out
