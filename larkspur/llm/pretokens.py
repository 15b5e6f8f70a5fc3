"""Boundaries of the byte-level pre-tokenizer, found for whole buffers at once.

The rule (fixed by the published pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+|
?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``) looks at most two characters
around a position, so a boundary is a local property: it holds or not whatever
came before, and texts can be cut into chunks with a small margin.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np

LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)
_table: np.ndarray | None = None
#: White space in the sense of the pattern's \\s (the Unicode property).
_WHITE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def classes() -> np.ndarray:
    """Class of every code point: letter, number, other, blank, other white space."""
    global _table
    if _table is None:
        table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        for code in range(sys.maxunicode + 1):
            kind = unicodedata.category(chr(code))[0]
            if kind == "L":
                table[code] = LETTER
            elif kind == "N":
                table[code] = NUMBER
        table[_WHITE] = WHITE
        table[0x20] = SPACE
        _table = table
    return _table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def boundaries(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Positions where a pre-token starts. ``breaks``: starts of texts in the buffer."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    fresh = np.zeros(n + 1, bool)
    fresh[breaks[breaks < n]] = True
    fresh[0] = fresh[n] = True
    # class before and after, with the ends of a text as a class of their own (9)
    before = np.full(n, 9, np.uint8)
    before[1:] = kind[:-1]
    before[fresh[:n]] = 9
    after = np.full(n, 9, np.uint8)
    after[:-1] = kind[1:]
    after[fresh[1:]] = 9
    solid, solid_after = kind < SPACE, after < SPACE
    # a run of letters, numbers or others starts where the class changes, unless a blank before it joins it
    start = solid & (before != kind) & (before != SPACE)
    # white space: a run starts; its last character stands apart when something solid follows
    start |= ~solid & ((before < SPACE) | (before == 9))
    start |= ~solid & solid_after
    # a last white character that is not a blank does not join what follows
    start |= solid & (before == WHITE)
    # contractions stand at an apostrophe that starts a pre-token
    quote = np.flatnonzero((points == 0x27) & (before != OTHER) & (before != SPACE))
    if len(quote):
        limit = np.searchsorted(np.append(np.flatnonzero(fresh[:n]), n), quote, "right")
        ends = np.append(np.flatnonzero(fresh[:n]), n)[limit]
        padded = np.concatenate([points, np.zeros(3, np.uint32)])
        one, two = padded[quote + 1], padded[quote + 2]
        has_one, has_two = quote + 1 < ends, quote + 2 < ends
        single = has_one & np.isin(one, [ord(c) for c in "stmd"])
        double = has_two & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for found, size in ((single, 2), (double & ~single, 3)):
            at = quote[found]
            for k in range(1, size):
                start[at + k] = False
            stop = at + size
            stop = stop[stop < n]
            start[stop] = True
    return np.flatnonzero(start | fresh[:n])


def pieces(texts: list[str], special: str = "") -> tuple[list[str], np.ndarray]:
    """Pre-tokens of all texts in order, and how many each text has.

    ``special`` is a string that stands apart as one piece wherever it occurs.
    """
    buffer = "".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes) - sizes
    breaks, inside = [begins], []
    for begin, text in zip(begins.tolist(), texts, strict=True):
        at = text.find(special) if special else -1
        while at >= 0:
            breaks.append(np.array([begin + at, begin + at + len(special)]))
            inside.append(np.arange(begin + at + 1, begin + at + len(special)))
            at = text.find(special, at + len(special))
    at = boundaries(code_points(buffer), np.unique(np.concatenate(breaks)))
    if inside:
        at = at[~np.isin(at, np.concatenate(inside))]
    counts = np.searchsorted(at, begins + sizes) - np.searchsorted(at, begins)
    stops = at.tolist()
    return [buffer[i:j] for i, j in zip(stops, [*stops[1:], len(buffer)], strict=False)], counts
