"""Hashed word shingles of whole texts, in numpy."""

from collections.abc import Iterator

import numpy as np

WIDTH = 5
SLICE_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, bool)
_space[[32, 9, 10, 11, 12, 13]] = True
# White space and all other ASCII but letters and digits.
_marks = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int, name: str) -> np.ndarray:
    known = _powers.get(name)
    if known is None or len(known) < n:
        known = np.full(max(n, SLICE_BYTES + 65536), base & MASK, np.uint64)
        known[0] = 1
        known = _powers[name] = np.cumprod(known, dtype=np.uint64)
    return known[:n]


def word_hashes(texts: list[bytes], marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts in order, and the number of each word's text.

    A word's hash is a polynomial in its lower-cased bytes, taken from running sums over all bytes.
    With ``marks``, words end at punctuation too.
    """
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    blank = (_marks if marks else _space)[raw]
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(
        (_lower[raw].astype(np.uint64) + np.uint64(1)) * _power(BASE, len(raw), "up"), out=sums[1:]
    )
    down = _power(pow(BASE, -1, 1 << 64), len(raw), "down")
    hashes = (sums[ends] - sums[starts]) * down[starts]
    hashes = mixed(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(ends_of, starts, side="right")


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer words is one shingle.

    A null text is empty, and a text without words has none.
    """
    coded = [(t or "").encode() for t in texts]
    at = 0
    while at < len(coded):
        stop, size = at, 0
        while stop < len(coded) and (stop == at or size + len(coded[stop]) <= SLICE_BYTES):
            size += len(coded[stop]) + 1
            stop += 1
        part = coded[at:stop]
        words, owner = word_hashes(part)
        bounds = np.searchsorted(owner, np.arange(len(part) + 1))
        rolled = np.zeros(max(0, len(words) - WIDTH + 1), np.uint64)
        for k in range(WIDTH):
            rolled = rolled * np.uint64(0xC2B2AE3D27D4EB4F) + words[k : k + len(rolled)]
        rolled = mixed(rolled)
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b - a >= WIDTH:
                yield np.unique(rolled[a : b - WIDTH + 1])
            elif b > a:
                short = np.uint64(b - a)
                for h in words[a:b]:
                    short = np.uint64((int(short) * 0xC2B2AE3D27D4EB4F + int(h)) & MASK)
                yield mixed(np.array([short ^ np.uint64(0x5555)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
        at = stop
