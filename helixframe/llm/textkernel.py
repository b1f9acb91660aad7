"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow column, without an object for each word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; a longer single text makes a longer piece.
PIECE = 1 << 20
U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)
RADIX = 0x2545F4914F6CDD1D
INVERSE = pow(RADIX, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words between white space: [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words of digits, lower-case letters and everything that is not ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = np.ones(256, bool)
for _a, _b in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    ALNUM[_a : _b + 1] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits without visible pattern (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


VALUE = mix(np.arange(1, 257, dtype=U) * GOLDEN)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """RADIX and its inverse to the powers 0 to n - 1, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, PIECE)
        for i, base in enumerate((RADIX, INVERSE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


@dataclass(frozen=True)
class Piece:
    """Texts first to last - 1 of a column: their bytes in lower case (A-Z only), and the bounds of each."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return self.last - self.first


@dataclass(frozen=True)
class Words:
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    counts: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray


def give_back() -> None:
    """Return freed memory to the system: idle Python workers of an executor hold what they have."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pieces(texts: pa.Array, size: int = PIECE, lower: bool = True) -> Iterator[Piece]:
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string()).fill_null("")
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        own = data[offsets[at] : offsets[end]]
        yield Piece(at, end, LOWER[own] if lower else own, offsets[at : end + 1] - offsets[at])
        at = end
    give_back()


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, the same wherever it stands: differences of one running sum."""
    up, down = powers(len(data) + 1)  # an empty span may begin where the data end
    total = np.zeros(len(data) + 1, U)
    np.cumsum(VALUE[data] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U) * GOLDEN)


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The items of all spans, one span after another."""
    out = np.cumsum(sizes)
    return data[np.repeat(starts - (out - sizes), sizes) + np.arange(out[-1] if len(out) else 0)]


def words(piece: Piece, inside: np.ndarray) -> Words:
    """The words of each text and a 64-bit hash of each, the same wherever it stands."""
    data, offsets, n = piece.data, piece.offsets, len(piece.data)
    if not n:
        none = np.empty(0, np.int64)
        return Words(none, none, none, np.zeros(len(piece), np.int64), np.zeros(len(piece) + 1, np.int64), np.empty(0, U))
    is_in = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = is_in.copy()
    starts[1:] &= ~is_in[:-1] | edge[1:n]
    ends = is_in.copy()
    ends[:-1] &= ~is_in[1:] | edge[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    counts = np.bincount(doc, minlength=len(piece))
    return Words(starts, ends, doc, counts, np.concatenate([[0], np.cumsum(counts)]), span_hashes(data, starts, ends))


def shingles(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each run of width words, in order; a text of fewer words, but not none, has its whole sequence as one."""
    n = len(w.hashes)
    size = np.minimum(w.counts, width)
    many = np.maximum(w.counts - width + 1, np.minimum(w.counts, 1))
    doc = np.repeat(np.arange(len(w.counts)), many)
    first = np.repeat(w.bounds[:-1], many) + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    length = size[doc]
    out = length.astype(U) * GOLDEN
    for k in range(width):
        out = np.where(k < length, mix(out * U(RADIX) + w.hashes[np.minimum(first + k, max(n - 1, 0))]), out) if n else out
    return out, doc


def distinct(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text in ascending order, one text after another, and how many each has."""
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    parts, counts = [], np.zeros(n_docs, np.int64)
    for i in range(n_docs):
        own = np.sort(hashes[bounds[i] : bounds[i + 1]])
        if len(own) > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        counts[i] = len(own)
        parts.append(own)
    return np.concatenate(parts) if parts else np.empty(0, U), counts


def binaries(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """An Arrow column of the bytes of counts[i] items each."""
    width = flat.dtype.itemsize
    offsets = np.concatenate([[0], np.cumsum(counts * width)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(flat).tobytes())])
