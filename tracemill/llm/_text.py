"""Vectorised words: spans and 64-bit hashes of the words of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 20)
        for base, name in ((_P, "_pow"), (_P_INV, "_inv")):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHasher:
    """Hashes of spans of one buffer, equal for equal content wherever it stands."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        pow_, self.inv = _powers(n + 1)
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * pow_[:n], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.inv[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return SpanHasher(buf)(starts, ends)


def spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of other than ASCII white space, none across a text's edge."""
    word = ~_SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(buf), bool)
    before[:1] = False
    before[1:] = word[:-1]
    after = np.empty(len(buf), bool)
    after[-1:] = False
    after[:-1] = word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty texts, without making Python strings."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return buf, offsets - offsets[0]


def pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def blocks(offsets: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes each; a longer text is alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to
        at = to


def shingles(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``width`` words (a shorter text is one run), and how many each has.

    words: hashes of all texts' words in order; counts: words of each text.
    """
    n = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    out = np.zeros(int(n.sum()), np.uint64)
    first = np.repeat(np.cumsum(counts) - counts - (np.cumsum(n) - n), n) + np.arange(len(out))
    have = np.repeat(np.minimum(counts, width), n)
    for j in range(width):
        use = have > j
        part = words[np.where(use, first + j, 0)] * np.uint64(pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64)) if len(words) else 0
        out = np.where(use, out + part, out) if not use.all() else out + part
    return mix(out + have.astype(np.uint64)), n


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions start .. start + count - 1 of each, one after the other."""
    total = int(counts.sum())
    out = np.ones(total, np.int64)
    keep = counts > 0
    starts, counts = starts[keep], counts[keep]
    if total:
        at = np.cumsum(counts) - counts
        out[at[0]] = starts[0]
        out[at[1:]] = starts[1:] - (starts[:-1] + counts[:-1] - 1)
        np.cumsum(out, out=out)
    return out
