"""Words of a batch of texts as numpy arrays, for use inside tasks.

A batch of texts becomes one byte buffer with document offsets; words
(``[^\\x20\\x09-\\x0D]+``), their 64-bit hashes and their documents are found
for the whole buffer at once. Callers slice batches so that a buffer stays
near ``SLICE_BYTES``, unless one document is longer; inside a buffer, work
goes in windows of ``WINDOW`` bytes, so a long document costs little more than
its own bytes and words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
WINDOW = 1 << 16

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES, _OTHER_BYTES = np.random.default_rng(20240501).integers(1, 1 << 63, (2, 256), dtype=np.uint64)


def _powers(base: np.uint64) -> np.ndarray:
    """base**i for i up to WINDOW, wrapping."""
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(WINDOW, base)]), dtype=np.uint64)


_UP, _DOWN = _powers(_STEP), _powers(_BACK)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one buffer, and n + 1 offsets; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``limit`` bytes; a longer row stands alone."""
    sizes = text_bytes(column)[1]
    begin = 0
    while begin < len(column):
        end = int(np.searchsorted(sizes, sizes[begin] + limit, "right")) - 1
        end = min(max(end, begin + 1), len(column))
        yield begin, end
        begin = end


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: bool = False) -> np.ndarray:
    """64-bit hashes of spans of bytes that do not overlap; ``other`` gives hashes that are independent of these."""
    values, plain = _OTHER_BYTES if other else _BYTES, np.zeros(len(start), np.uint64)
    for at in range(0, len(data), WINDOW):
        stop = min(at + WINDOW, len(data))
        total = np.zeros(stop - at + 1, np.uint64)
        np.cumsum(values[data[at:stop]] * _UP[: stop - at], out=total[1:])
        low, high = np.searchsorted(start, [at, stop])
        inside, begin = np.minimum(end[low:high], stop) - at, start[low:high] - at
        plain[low:high] = (total[inside] - total[begin]) * _DOWN[begin]
        if low and end[low - 1] > at:  # the rest of a span that began in an earlier window
            shift = np.uint64(pow(int(_STEP), int(at - start[low - 1]), 1 << 64))
            reach = min(end[low - 1], stop) - at
            plain[low - 1 : low] += total[reach : reach + 1] * shift
    return mix(plain + (end - start).astype(np.uint64))


class Words:
    """Words of a buffer: start and end bytes, document and hash of each, in order."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> None:
        self.data = _LOWER[raw] if lower else raw
        self.offsets = offsets
        starts, ends = [], []
        cuts = offsets[1:-1]
        for at in range(0, len(raw), WINDOW):
            stop = min(at + WINDOW, len(raw))
            word = ~_SPACE[raw[at:stop]]
            first, last = word.copy(), word.copy()
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            first[0] &= at == 0 or _SPACE[raw[at - 1]]
            last[-1] &= stop == len(raw) or _SPACE[raw[stop]]
            low, high = np.searchsorted(cuts, [at, stop])
            here = cuts[low:high] - at
            first[here] = word[here]
            low, high = np.searchsorted(cuts, [at + 1, stop + 1])
            here = cuts[low:high] - at - 1
            last[here] = word[here]
            starts.append(np.flatnonzero(first) + at)
            ends.append(np.flatnonzero(last) + at + 1)
        none = np.zeros(0, np.int64)
        self.start, self.end = np.concatenate([none, *starts]), np.concatenate([none, *ends])
        self.counts = np.searchsorted(self.start, offsets[1:]) - np.searchsorted(self.start, offsets[:-1])
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)
        self.hash = span_hashes(self.data, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")
