"""Words of many texts at once, as 64-bit hashes with positions.

Texts are laid end to end as code points; classes, lower case and hashes are table look-ups and
running sums over that array, so no Python object is made per word. A long text is worked
through in stretches, cut where no word is, so memory follows the stretch and not the text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points worked on at a time.
STRETCH = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BREAK = re.compile(r"[ \t-\r]")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: lower case, letter or mark, letter or mark or digit, no white space."""
    lower = np.arange(0x110000, dtype=np.uint32)
    letter = np.zeros(0x110000, bool)
    digit = np.zeros(0x110000, bool)
    for i in range(0x110000):
        c = chr(i)
        kind = unicodedata.category(c)[0]
        if kind == "L":
            letter[i] = True
            if len(small := c.lower()) == 1:
                lower[i] = ord(small)
        elif kind == "M":
            letter[i] = True
        elif kind == "N":
            digit[i] = True
    solid = np.ones(0x110000, bool)
    solid[[i for i in range(0x110000) if chr(i).isspace()]] = False
    return lower, letter, letter | digit, solid


@lru_cache(1)
def real_letters() -> np.ndarray:
    """By code point: a letter, marks not counted."""
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)])


@lru_cache(1)
def _ascii() -> tuple[np.ndarray, np.ndarray]:
    """By code point: lower case of A-Z only, no ASCII white space."""
    lower = np.arange(0x110000, dtype=np.uint32)
    lower[65:91] += 32
    solid = np.ones(0x110000, bool)
    solid[[32, *range(9, 14)]] = False
    return lower, solid


@lru_cache(1)
def _terms() -> np.ndarray:
    """By code point: an ASCII letter or digit, or no ASCII."""
    known = np.ones(0x110000, bool)
    known[:128] = [chr(i).isalnum() for i in range(128)]
    return known


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = STRETCH * 2
    while size < n:
        size *= 2
    return _powers(size)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def hash_spans(values: np.ndarray, inside: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the values in each span; equal runs of values have equal hashes."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(np.where(inside, (values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], np.uint64(0)), out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def stretches(text: str) -> Iterator[tuple[int, str]]:
    """The text in parts of about STRETCH code points, cut before ASCII white space."""
    at = 0
    while len(text) - at > STRETCH:
        cut = _BREAK.search(text, at + STRETCH)
        if cut is None:
            break
        yield at, text[at : cut.start()]
        at = cut.start()
    yield at, text[at:]


class Words:
    """Words of some texts: `hash`, `start` and `end` (code points in the laid-out text), `bounds` (first word of each
    text, and the number of words at the end), `origin` (where each text starts)."""

    def __init__(self, texts: list[str], kind: str = "word"):
        """Words are runs of letters, marks and digits; "spaced": of anything but white space; "ascii": of anything but ASCII
        white space, with only A-Z made lower; "term": of ASCII letters and digits and all that is not ASCII, with only A-Z made lower."""
        lower, _, known, solid = _tables()
        if kind == "spaced":
            known = solid
        elif kind == "ascii":
            lower, known = _ascii()
        elif kind == "term":
            lower, known = _ascii()[0], _terms()
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.origin = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1].astype(np.int64)
        parts = []
        for at, part in stretches("\n".join(texts)):
            points = lower[code_points(part)]
            inside = known[points]
            start, end = spans(inside)
            parts.append((hash_spans(points, inside, start, end), start + at, end + at))
        self.hash, self.start, self.end = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.bounds = np.searchsorted(self.start, np.append(self.origin, lengths.sum() + len(texts) + 1))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of n words in a row inside one text, with the index of the text and of the first word."""
        owner = self.text_of()
        if len(self.hash) < n:
            return np.empty(0, np.uint64), owner[:0], owner[:0]
        whole = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
        up, _ = powers(n + 1)
        total = np.zeros(len(whole), np.uint64)
        for j in range(n):
            total += self.hash[whole + j] * up[j]
        return mix(total), owner[whole], whole


def blocks(sizes: list[int], most: int = 2 * STRETCH) -> Iterator[slice]:
    """Runs of rows that hold about `most` code points each, a longer row alone."""
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield slice(first, i)
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield slice(first, len(sizes))


def text_blocks(column: pa.Array, most: int = 2 * STRETCH) -> Iterator[tuple[slice, list[str]]]:
    """Runs of rows of a column of texts that hold about `most` bytes, with their texts (null: empty)."""
    column = column.cast(pa.string())
    for rows in blocks(pc.fill_null(pc.binary_length(column), 0).to_pylist(), most):
        yield rows, [x or "" for x in column.slice(rows.start, rows.stop - rows.start).to_pylist()]
