"""Where a text's fixed-length windows may recur: anchors, and the regions around those that do.

A window of n units (bytes or words) has as its anchor the smallest hash of its k-unit grams. Equal
windows have equal anchors, whatever surrounds them, so only windows whose anchor occurs in more
than one place can recur, and equal windows meet under their anchor. Consecutive windows mostly share
an anchor, so there are few anchors: about 2 for every n - k + 2 units.

A region is a run of windows of one document with the same anchor, with all the units that they
cover. Each window lies in exactly one region.

Hashes here only bring windows together that may be equal. Whether they are is for others to say, by
their units.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from calorant.llm.common import mix

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPREAD = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_GAP = re.compile(rb"[\x20\x09-\x0D]")
#: Most grams of a batch of bytes, less than a power of two by one.
PLACES = (1 << 20) - 1
#: Most windows of a region, as a multiple of the window.
LONGEST = 4


@lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.empty(size, dtype=np.uint64)
    down = np.empty(size, dtype=np.uint64)
    for out, base in ((up, _BASE), (down, _INVERSE)):
        out[0], n = 1, 1
        while n < size:
            m = min(n, size - n)
            out[n : n + m] = out[:m] * np.uint64(pow(base, n, 1 << 64))
            n += m
    return up, down


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least `size` of each."""
    return _powers(1 << max(19, (size - 1).bit_length()))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of spread bytes times powers of the base: prefix[j] - prefix[i] is a hash of data[i:j] at i."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_SPREAD[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:stop] that don't depend on the place."""
    _, down = powers(len(prefix))
    return mix((prefix[stop] - prefix[start]) * down[start])


def window_hashes(prefix: np.ndarray, window: int) -> np.ndarray:
    """span_hash of every run of `window` bytes, in order."""
    n = max(0, len(prefix) - window)
    _, down = powers(len(prefix))
    return mix((prefix[window : window + n] - prefix[:n]) * down[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` consecutive values, by doubling."""
    n, size = len(values) - width + 1, 1
    if n <= 0:
        return values[:0]
    out = values
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[:n], out[width - size : width - size + n])


@dataclass(frozen=True)
class Regions:
    """Regions of a batch of texts in order: text, first window, windows, anchor."""

    text: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    #: Whether a region holds several grams with its anchor's hash, so that windows of it may be equal.
    inner: np.ndarray


class Units:
    """A batch of texts as units; first[d] is the place of text d's first unit among all.

    inner: whether to find out which regions hold several grams of their anchor. most: how many
    units of each text windows may start at.
    """

    inner = False

    def __init__(self, first: np.ndarray, grams: np.ndarray, window: int, gram: int, most: np.ndarray):
        self.first, self.window, self.most = first, window, most
        width = window - gram + 1
        if not self.inner:
            self.low = sliding_min(grams, width)
            return
        # the low bits of a gram's hash give way to its place, so that the least is the first or the last; as many bits in every batch
        if len(grams) > PLACES:
            raise ValueError(f"a batch holds {len(grams)} grams; {PLACES} at most")
        size = np.uint64(PLACES)
        high, at = grams & ~size, np.arange(len(grams), dtype=np.uint64)
        self.leftmost = sliding_min(high | at, width) & size
        self.rightmost = size - (sliding_min(high | (size - at), width) & size)
        self.low = grams[self.leftmost]

    def regions(self) -> Regions:
        """A region ends at LONGEST windows' length too, so that what one anchor holds is bounded by its regions."""
        n = np.minimum(np.maximum(self.first[1:] - self.first[:-1] - self.window + 1, 0), self.most)
        text = np.repeat(np.arange(len(n)), n)
        inside = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        at = inside + np.repeat(self.first[:-1], n)
        values = self.low[at]
        cut = inside == 0
        cut[1:] |= values[1:] != values[:-1]
        head = np.flatnonzero(cut)
        since = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
        head = np.flatnonzero(since % (LONGEST * self.window) == 0)
        windows = np.diff(np.append(head, len(at)))
        begin, anchor = at[head], values[head].view(np.int64)
        inner = self.leftmost[begin] != self.rightmost[begin + windows - 1] if self.inner else np.zeros(len(begin), dtype=bool)
        return Regions(text[head], inside[head], windows, anchor, inner)


class Words(Units):
    """Texts as words; equal windows of one text don't matter."""

    def __init__(self, texts: list[bytes], window: int, gram: int, most: np.ndarray):
        data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[data])).astype(np.int8)))
        self.data, self.start, self.stop = data, edge[::2], edge[1::2]
        ends = np.cumsum([len(t) + 1 for t in texts])
        first = np.searchsorted(self.start, np.concatenate(([0], ends)))
        words = span_hash(prefix_hash(data), self.start, self.stop)
        n = max(0, len(words) - gram + 1)
        sums = np.zeros(n, dtype=np.uint64)
        for k in range(gram):
            sums += words[k : k + n] * np.uint64(pow(_BASE, k + 1, 1 << 64))
        super().__init__(first, mix(sums), window, gram, most)

    def piece(self, d: int, i: int, j: int) -> bytes:
        """Units i to j of text d, or to its end: words joined by one space."""
        a, b = self.first[d] + i, min(self.first[d] + j, self.first[d + 1])
        return b" ".join(self.data[self.start[a] : self.stop[b - 1]].tobytes().split())

    @staticmethod
    def cut(text: bytes, size: int, reach: int) -> Iterator[tuple[int, int, bytes]]:
        """Pieces of whole words of about `size` bytes, with the words that a window reaches into: first word, words, bytes."""
        tail = re.compile(rb"(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]+){0,%d}" % (reach - 1))
        at = first = 0
        while at < len(text):
            gap = _GAP.search(text, min(at + size, len(text)))
            end = gap.start() if gap else len(text)
            n = len(text[at:end].split())
            yield first, n, text[at : tail.match(text, end).end()]
            at, first = end, first + n


class Bytes(Units):
    """Texts as bytes; equal windows of one text matter."""

    inner = True

    def __init__(self, texts: list[bytes], window: int, gram: int, most: np.ndarray):
        self.texts = texts
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        first = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        super().__init__(first, window_hashes(prefix_hash(data), gram), window, gram, most)

    def piece(self, d: int, i: int, j: int) -> bytes:
        return self.texts[d][i:j]

    @staticmethod
    def cut(text: bytes, size: int, reach: int) -> Iterator[tuple[int, int, bytes]]:
        """Pieces of `size` bytes with those that a window reaches into: first byte, bytes, content."""
        for at in range(0, len(text), size):
            yield at, size, text[at : at + size + reach - 1]


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each run of equal values, and the end of the last appended; and the runs' values."""
    if not len(values):
        return np.zeros(1, dtype=np.int64), values
    cut = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1))
    return np.append(cut, len(values)), values[cut]
