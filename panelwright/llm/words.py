"""Words of whole texts as 64-bit hashes, computed on Arrow's own buffers with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken in slices of about so many bytes, so that temporary arrays stay small.
SLICE_BYTES = 1 << 20

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): equal inputs agree, near ones scatter."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code = np.arange(256, dtype=np.uint8)
    is_word = (code >= 0x80) | ((code >= 0x30) & (code <= 0x39)) | ((code >= 0x61) & (code <= 0x7A))
    upper = (code >= 0x41) & (code <= 0x5A)
    is_word |= upper
    lower = np.where(upper, code + 32, code).astype(np.uint8)
    return is_word, lower, mixed((lower.astype(_U) + _U(1)) * _STEP)


#: Whether a byte belongs to a word, its lower case, and its random 64-bit value.
IS_WORD, LOWER, VALUE = _tables()
_POWERS = np.ones(1, dtype=_U)


def _powers(n: int) -> np.ndarray:
    """The first n powers of an odd multiplier, modulo 2^64."""
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 1024)
        steps = np.full(size, _U(0xD1342543DE82EF95), dtype=_U)
        steps[0] = 1
        _POWERS = np.cumprod(steps, dtype=_U)
    return _POWERS


class Words:
    """Words of a few consecutive rows.

    ``hashes``: one per word; ``starts``, ``stops``: byte range of each in ``data``;
    ``first``: for each row the index of its first word, with the total at the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = IS_WORD[data]
        edge = np.empty(n + 1, dtype=bool)
        edge[1:n] = inside[1:] != inside[:-1]
        edge[0] = edge[n] = True
        rows = offsets[(offsets > 0) & (offsets < n)]
        edge[rows] = True
        if n:
            cuts = np.flatnonzero(edge)
            begins, ends = cuts[:-1], cuts[1:]
            words = inside[begins]
            self.starts, self.stops = begins[words], ends[words]
        else:
            self.starts = self.stops = np.zeros(0, dtype=np.int64)
        self.first = np.searchsorted(self.starts, offsets)
        lengths = self.stops - self.starts
        if len(lengths):
            powers = _powers(int(lengths.max()))
            taken = data[inside]
            begins = np.cumsum(lengths) - lengths
            place = np.arange(len(taken), dtype=np.int64) - np.repeat(begins, lengths)
            self.hashes = mixed(np.add.reduceat(VALUE[taken] * powers[place], begins) + lengths.astype(_U))
        else:
            self.hashes = np.zeros(0, dtype=_U)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``width`` words within a row, and the row's first run index.

        A row with fewer words, but not none, has one run of all its words.
        """
        counts = np.diff(self.first)
        runs = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
        first = np.concatenate([[0], np.cumsum(runs)])
        row = np.repeat(np.arange(len(counts)), runs)
        at = np.arange(len(row)) - first[row] + self.first[row]
        last = self.first[row + 1]
        total = np.zeros(len(row), dtype=_U)
        for k in range(width):
            inside = at + k < last
            if inside.all():
                total = total * _STEP + self.hashes[at + k]
            else:
                total[inside] = total[inside] * _STEP + self.hashes[at[inside] + k]
        return mixed(total), first


def slices(texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(start, stop, words) for consecutive rows, about SLICE_BYTES at once; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    _, where, content = texts.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(content, dtype=np.uint8) if content is not None and content.size else np.zeros(0, np.uint8)
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, side="right")) - 1
        stop = min(max(stop, start + 1), len(texts))
        low, high = int(offsets[start]), int(offsets[stop])
        yield start, stop, Words(data[low:high], offsets[start : stop + 1] - low)
        start = stop
