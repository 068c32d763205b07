"""Texts to sets of word n-grams as sorted 64-bit numbers, a batch at a time.

Words are what ASCII white space separates, A-Z in lower case. A word's hash is
a polynomial over its bytes, taken from running sums, so that no word becomes a
Python object; words of more than ``LONG`` bytes are hashed by xxhash. Texts
are read whole; very long ones in pieces that end at white space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from newsloom.llm.bloom import mix

PIECE = 1 << 18
LONG = 64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.random.default_rng(41).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B]
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE + 1, np.uint64(base))
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _word_hashes(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash and first byte of each word of a piece; a word ends also before each of ``starts``."""
    space = _SPACE[text]
    after = np.concatenate([[True], space, [True]])
    begins, ends = after[:-2].copy(), after[2:].copy()
    starts = starts[starts < len(text)]
    begins[starts] = True
    ends[starts[starts > 0] - 1] = True
    first = np.flatnonzero(~space & begins)
    last = np.flatnonzero(~space & ends) + 1
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_LETTER[text] * _UP[: len(text)], out=sums[1:])
    h = mix((sums[last] - sums[first]) * _DOWN[first])
    for k in np.flatnonzero(last - first > LONG).tolist():
        h[k] = xxhash.xxh3_64_intdigest(text[first[k] : last[k]].tobytes().lower())
    return h, first


def _long_words(text: np.ndarray) -> np.ndarray:
    """The word hashes of one text of any length."""
    out, at, n = [], 0, len(text)
    while at < n:
        past = min(n, at + PIECE)
        if past < n:
            inside = np.flatnonzero(_SPACE[text[at:past]])
            if len(inside):
                past = at + int(inside[-1]) + 1
            else:  # one word fills the piece
                while past < n and not len(inside := np.flatnonzero(_SPACE[text[past : past + PIECE]])):
                    past = min(n, past + PIECE)
                past += int(inside[0]) if past < n else 0
                out.append(np.array([xxhash.xxh3_64_intdigest(text[at:past].tobytes().lower())], np.uint64))
                at = past
                continue
        out.append(_word_hashes(text[at:past], np.zeros(1, np.int64))[0])
        at = past
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _groups(ends: np.ndarray):
    """Runs [i, j) of texts that fit a piece together; a longer text stands alone."""
    i, n = 0, len(ends) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + PIECE, side="right")) - 1)
        yield i, j
        i = j


class Shingler:
    """Texts to their sets of ``n``-word shingles; fewer words are one shingle together, no word gives an empty set."""

    def __init__(self, n: int):
        self.n = n
        self.odd = np.random.default_rng(n).integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All sets behind one another, each sorted, and where they begin and end."""
        column = pc.cast(column, pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        text = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        values, sizes = [], []
        for i, j in _groups(ends):
            part, own = text[ends[i] : ends[j]], ends[i:j] - ends[i]
            if len(part) > PIECE:
                h = _long_words(part)
                words = np.array([0, len(h)])
            else:
                h, first = _word_hashes(part, own)
                words = np.concatenate([np.searchsorted(first, own), [len(h)]])
            value, size = self._sets(h, words)
            values.append(value)
            sizes.append(size)
        size = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
        return np.concatenate(values) if values else np.empty(0, np.uint64), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)

    def _bound(self, h: np.ndarray) -> np.ndarray:
        k = min(self.n, len(h))
        total = np.full(len(h) - k + 1, np.uint64(k))
        for i in range(k):
            total += h[i : len(h) - k + 1 + i] * self.odd[i]
        return mix(total)

    def _sets(self, h: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, lengths = self.n, np.diff(words)
        count = np.where(lengths >= n, lengths - n + 1, np.minimum(lengths, 1))
        at = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(at[-1], np.uint64)
        whole = np.ones(at[-1], bool)
        for k in np.flatnonzero((lengths > 0) & (lengths < n)).tolist():
            out[at[k]] = self._bound(h[words[k] : words[k + 1]])[0]
            whole[at[k]] = False
        if len(h) >= n:
            across = (words[1:, None] - np.arange(1, n)[None, :]).ravel()
            inside = np.ones(len(h) - n + 1, bool)
            inside[across[(across >= 0) & (across < len(inside))]] = False
            out[whole] = self._bound(h)[inside]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            out[a:b].sort()
        new = np.concatenate([[True], out[1:] != out[:-1]]) if len(out) else np.empty(0, bool)
        new[at[:-1][count > 0]] = True
        kept = np.concatenate([[0], np.cumsum(new)])
        return out[new], np.diff(kept[at])
