"""SuperMinHash signatures, all texts of a chunk in lockstep.

Every element draws, from its own hash, a random permutation of the slots and a
fraction r; at step j it offers the value j + r to the j-th slot of its
permutation, and each slot keeps its smallest offer. A slot that was filled by
step j can't be improved later, so a set leaves the loop as soon as all its slots
are filled: the early stop. The permutation makes the offers of one element to
different slots distinct ranks, which lowers the variance against independent
hash functions.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm.words import mix

#: Elements whose permutations are held at once.
ELEMENTS = 20_000


def _rank(elements: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """48 random bits, and as many again, of each element at one step."""
    drawn = mix(elements + np.uint64((step * 2 + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return drawn >> np.uint64(16), mix(drawn + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(16)


def signatures(elements: np.ndarray, owner: np.ndarray, sets: int, slots: int) -> np.ndarray:
    """Signatures (sets x slots, uint64) of sets given as distinct elements and their set's number.

    ``owner`` is ascending. A slot holds step << 48 | fraction; sets without elements keep all bits set.
    """
    with np.errstate(over="ignore"):
        out = np.full(sets * slots, ~np.uint64(0))
        fraction, draw = _rank(elements, 0)
        np.minimum.at(out, owner * slots + (draw % np.uint64(slots)).astype(np.int64), fraction)
        open_sets = (out.reshape(sets, slots) == ~np.uint64(0)).any(axis=1)
        rest = np.flatnonzero(open_sets[owner])
        at = 0
        while at < len(rest):
            stop = min(at + ELEMENTS, len(rest))
            while stop < len(rest) and owner[rest[stop]] == owner[rest[stop - 1]]:
                stop += 1
            _finish(elements[rest[at:stop]], owner[rest[at:stop]], out, slots)
            at = stop
    return out.reshape(sets, slots)


def _finish(elements: np.ndarray, owner: np.ndarray, out: np.ndarray, slots: int) -> None:
    order = np.tile(np.arange(slots, dtype=np.uint16), (len(elements), 1))
    table = out.reshape(-1, slots)
    for step in range(slots):
        fraction, draw = _rank(elements, step)
        swap = step + (draw % np.uint64(slots - step)).astype(np.int64)
        rows = np.arange(len(elements))
        slot = order[rows, swap].astype(np.int64)
        order[rows, swap] = order[:, step]
        np.minimum.at(out, owner * slots + slot, (np.uint64(step) << np.uint64(48)) | fraction)
        if step % 4 == 3 or step < 2:
            here = np.unique(owner)
            still = here[(table[here] == ~np.uint64(0)).any(axis=1)]
            keep = np.isin(owner, still, assume_unique=False)
            if not keep.all():
                elements, owner, order = elements[keep], owner[keep], order[keep]
            if not len(elements):
                return


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of each signature (sets x bands)."""
    sets, slots = signature.shape
    rows = slots // bands
    with np.errstate(over="ignore"):
        key = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64)), (sets, 1))
        for i in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, i : bands * rows : rows])
    return key
