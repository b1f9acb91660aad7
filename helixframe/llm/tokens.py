"""Token ids of public tokenizer files, with the ids of pieces of text remembered between texts."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .textkernel import Piece, U, gathered, pieces, span_hashes

#: Pieces that a worker remembers, about 40 bytes each; beyond it the memory starts anew.
REMEMBERED = 1_000_000
PIECE_BYTES = 1 << 20
#: New pieces encoded in one text.
AT_ONCE = 8192
#: Kinds of bytes in plain text: white space, letters of ASCII and Latin-1, digits, marks but the apostrophe.
SPACE, LETTER, DIGIT, MARK, OTHER = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[[0x20, *range(0x09, 0x0E)]] = SPACE
KIND[0x21:0x7F] = MARK
KIND[0x27] = OTHER
KIND[ord("0") : ord("9") + 1] = DIGIT
KIND[ord("a") : ord("z") + 1] = KIND[ord("A") : ord("Z") + 1] = LETTER
KIND[0xC3] = KIND[0x80:0xC0] = LETTER


class TokenIds:
    """Ids of texts by a tokenizer that lower-cases, drops white space and cuts runs of letters, single digits and runs of marks.

    Such a tokenizer gives a text the ids of those pieces one after another, and ends each with a token that ends a word.
    So in plain text (ASCII without apostrophe or control characters, and the letters of Latin-1, which normalisation to
    NFC leaves alone) each distinct piece is encoded once, by its hash; any other text is encoded as it is.
    """

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        """Hashes in ascending order, where each has its ids in the pool, and how many."""
        self.hashes, self.starts, self.sizes = np.empty(0, U), np.empty(0, np.int32), np.empty(0, np.int32)
        self.pool, self.used = np.empty(1 << 16, self.kind), 0

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Encode new pieces, in ascending order of their hashes, many in a text with blanks between, and cut its ids where words end."""
        parts = []
        for i in range(0, len(hashes), AT_ONCE):
            letters, own = gathered(data, starts[i : i + AT_ONCE], sizes[i : i + AT_ONCE]), sizes[i : i + AT_ONCE]
            parts.append(self.whole(np.insert(letters, np.cumsum(own)[:-1], 0x20).tobytes().decode("utf-8")))
        ids = np.concatenate(parts)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(hashes):
            raise ValueError("this tokenizer doesn't cut text into the pieces that are assumed")
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.starts = np.insert(self.starts, at, self.used + np.concatenate([[0], ends[:-1]]))
        self.sizes = np.insert(self.sizes, at, np.diff(ends, prepend=0))
        self.used += len(ids)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        return self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)

    def spans(self, p: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which texts are plain; lower-case bytes; starts and ends of pieces."""
        data, offsets, n = p.data.copy(), p.offsets, len(p.data)
        before = np.zeros(n, np.uint8)
        before[1:] = data[:-1]
        kind = KIND[data]
        follows = (data >= 0x80) & (data < 0xC0)
        bad = (kind == OTHER) | (follows != (before == 0xC3)) | (follows & ((data == 0x97) | (data == 0xB7)))
        upper = ((data >= 65) & (data <= 90)) | (follows & (data <= 0x9E))
        data[upper] += 32
        total = np.zeros(n + 1, np.int64)
        np.cumsum(bad, out=total[1:])
        plain = total[offsets[1:]] == total[offsets[:-1]]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        new = edge[:n] | (kind == DIGIT)
        new[1:] |= kind[1:] != kind[:-1]
        at = np.flatnonzero(new)
        ends = np.append(at[1:], n)
        keep = kind[at] != SPACE
        return plain, data, at[keep], ends[keep]

    def piece(self, p: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts of a piece of a column, how many each has, and the hash and text of each span."""
        none = np.empty(0, np.int64)
        if not len(p.data):
            return np.empty(0, self.kind), np.zeros(len(p), np.int64), np.empty(0, U), none
        plain, data, starts, ends = self.spans(p)
        hashes = span_hashes(data, starts, ends)
        doc = np.searchsorted(p.offsets, starts, "right") - 1
        use = plain[doc]
        if not use.all():
            starts, ends = starts[use], ends[use]
        distinct, first, back = np.unique(hashes[use], return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > REMEMBERED:
            self.forget()
        new = np.flatnonzero(~self.known(distinct))
        if len(new):
            at = first[new]
            self.learn(distinct[new], data, starts[at], (ends - starts)[at])
        entry = np.searchsorted(self.hashes, distinct)[back]
        sizes = self.sizes[entry].astype(np.int64)
        ids = gathered(self.pool, self.starts[entry], sizes)
        counts = np.bincount(doc[use], weights=sizes, minlength=len(p)).astype(np.int64)
        if not plain.all():
            bounds, parts = np.concatenate([[0], np.cumsum(counts)]), []
            for i in range(len(p)):
                own = ids[bounds[i] : bounds[i + 1]] if plain[i] else self.whole(p.data[p.offsets[i] : p.offsets[i + 1]].tobytes().decode("utf-8", "replace"))
                counts[i] = len(own)
                parts.append(own)
            ids = np.concatenate(parts)
        return ids, counts, hashes, doc

    def __call__(self, text: str) -> list[int]:
        return np.concatenate([self.piece(p)[0] for p in pieces(pa.array([text]), PIECE_BYTES, lower=False)]).tolist()


_loaded: dict[int, TokenIds] = {}


def token_ids(definition: str) -> TokenIds:
    """One for each definition and worker process."""
    key = hash(definition)
    if key not in _loaded:
        _loaded[key] = TokenIds(definition)
    return _loaded[key]
