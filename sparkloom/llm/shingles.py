"""Word and shingle hashes of whole text batches, vectorised over the UTF-8 bytes.

A word is a maximal run of bytes other than space and tab to carriage return, with A-Z lowered.  Its
64-bit hash comes from differences of one running polynomial sum over the batch, so that a text of
any length costs a fixed number of passes.  Batches are cut into pieces of about ``PIECE`` bytes to
bound memory; a longer text is a piece of its own, whose words are hashed in parts that end at blanks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 2 << 20
WIDTH = 5

_rng = np.random.default_rng(20240501)
_odd = lambda n: _rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = _odd(256)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = int(_odd(1)[0]) | 1
_BACK = pow(_BASE, -1, 1 << 64)
_PLACE = _odd(64)
_LENGTH = _odd(1)[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of an odd base modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.all = np.uint64(base), np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.all) < n:
            p = np.full(max(n, PIECE + 1), self.base, np.uint64)
            p[0] = 1
            self.all = np.multiply.accumulate(p)
        return self.all[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_BACK)


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the word offsets of each text.

    ``data`` holds the texts' bytes one after another; ``ends`` their end offsets.
    """
    if len(ends) > 1 or len(data) <= PIECE:
        h, _, offsets = _words(data, ends)
        return h, offsets
    parts, lo = [], 0
    while lo < len(data):
        hi = lo + PIECE
        while hi < len(data) and not _SPACE[data[hi]]:  # the next blank, looked for in steps
            blank = np.flatnonzero(_SPACE[data[hi : hi + PIECE]])
            hi = hi + int(blank[0]) if len(blank) else min(len(data), hi + PIECE)
        part = data[lo:hi]
        parts.append(_words(part, np.array([len(part)]))[0])
        lo = hi
    h = np.concatenate(parts)
    return h, np.array([0, len(h)])


def _words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(ends) + 1, np.int64)
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cut = ends[ends < n]
    first[cut] |= word[cut]  # a text's first byte starts a word
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[cut[cut > 0] - 1] |= word[cut[cut > 0] - 1]
    stops = np.flatnonzero(last) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _UP.upto(n), out=total[1:])
    h = (total[stops] - total[starts]) * _DOWN.upto(n)[starts] + (stops - starts).astype(np.uint64) * _LENGTH
    return mix(h), starts, np.concatenate([[0], np.searchsorted(starts, ends)])


def shingle_sets(h: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingles of every text; fewer than ``width`` words are one shingle."""
    n = len(h)
    rolled = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        rolled += h[k : n - width + 1 + k] * _PLACE[k] if n >= width else 0
    rolled = mix(rolled)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
        elif b > a:
            out.append(mix((h[a:b] * _PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64) + _PLACE[width + b - a]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def pieces(texts: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, end offsets) of runs of rows; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, off, buf = texts.buffers()
    at = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row + 1 : end + 1] - at[row]
        row = end


def text_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, shingle sets of the rows from there on), piece by piece."""
    for row, _, data, ends in pieces(texts):
        h, offsets = words(data, ends)
        yield row, shingle_sets(h, offsets, width)
