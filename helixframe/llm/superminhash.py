"""SuperMinHash (Ertl, 2017): each element ranks all slots by a permutation of its own; signatures of sets, in numpy."""

from __future__ import annotations

import numpy as np

from .textkernel import GOLDEN, RADIX, U, mix

EMPTY = U(2**64 - 1)


#: Elements whose ranks, m each, are held at a time.
AT_ONCE = 1 << 16


def signatures(elements: np.ndarray, counts: np.ndarray, m: int) -> np.ndarray:
    """signatures_of over any number of elements: values of a set are the least over its parts."""
    if len(elements) <= AT_ONCE:
        return signatures_of(elements, counts, m)
    out, ends = np.full((len(counts), m), EMPTY, U), np.cumsum(counts)
    for a in range(0, len(elements), AT_ONCE):
        b = min(a + AT_ONCE, len(elements))
        own = np.clip(np.minimum(ends, b) - np.maximum(ends - counts, a), 0, None)
        some = np.flatnonzero(own)
        out[some] = np.minimum(out[some], signatures_of(elements[a:b], own[some], m))
    return out


def signatures_of(elements: np.ndarray, counts: np.ndarray, m: int) -> np.ndarray:
    """For each set (counts[i] elements, one set after another) m values; an empty set has EMPTY in all.

    Slot i of a set is the least over its elements e of j + r, where j is the rank that e gives to slot i and r in [0, 1)
    its random part there. Ranks are worked through level by level for all sets together. All values of level j are
    under j + 1, so once every slot of a set has a value, later levels can't lower any and the set is done.
    """
    n_sets = len(counts)
    out = np.full((n_sets, m), EMPTY, U)
    owner = np.repeat(np.arange(n_sets), counts)
    flat, ranks = out.reshape(-1), None
    for level in range(m):
        if not len(elements):
            break
        drawn = mix(elements * U(RADIX) + U((level + 1) * int(GOLDEN) % (1 << 64)))
        pick = level + (((drawn & U(0xFFFFFFFF)) * U(m - level)) >> U(32)).astype(np.int64)
        value = (U(level) << U(32)) | (drawn >> U(32))
        if ranks is None:
            slot = pick
        else:
            row = np.arange(len(elements))
            slot = ranks[row, pick].astype(np.int64)
            ranks[row, pick] = ranks[row, level]
        np.minimum.at(flat, owner * m + slot, value)
        full = np.ones(n_sets, bool)
        open_sets = np.unique(owner)
        full[open_sets] = (out[open_sets] != EMPTY).all(axis=1)
        stay = ~full[owner]
        if not stay.any():
            break
        elements, owner = elements[stay], owner[stay]
        if ranks is None:
            pick = pick[stay]
            ranks = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(elements), 1))
            ranks[np.arange(len(elements)), pick] = 0
        else:
            ranks = ranks[stay]
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of rows slots; keys of different bands differ."""
    n, m = signature.shape
    bands = signature.reshape(n, m // rows, rows)
    out = np.broadcast_to(np.arange(1, m // rows + 1, dtype=U) * GOLDEN, (n, m // rows)).copy()
    for k in range(rows):
        out = mix(out * U(RADIX) + bands[:, :, k])
    return out
