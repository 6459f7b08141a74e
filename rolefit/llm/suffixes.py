"""Suffix arrays by induced sorting, and permuted common prefixes, over numpy arrays."""

import numpy as np

# Beyond so many symbols the reduced text is sorted by doubling: one bucket per symbol would be a loop
# over almost every suffix.
MOST_SYMBOLS = 4096
BASE = 0x9E3779B97F4A7C15 | 1


class Sums:
    """Running polynomial sums, from which any stretch's hash is read."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        power = np.full(n + 1, BASE, np.uint64)
        power[0] = 1
        self.down = np.full(n + 1, pow(BASE, -1, 1 << 64), np.uint64)
        self.down[0] = 1
        np.cumprod(power, out=power)
        np.cumprod(self.down, out=self.down)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * power[:n], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        return (self.sums[starts + sizes] - self.sums[starts]) * self.down[starts]


def smaller_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last counts as smaller."""
    n = len(text)
    differs = np.flatnonzero(text[1:] != text[:-1])
    types = np.ones(n, bool)
    if len(differs):
        nearest = np.searchsorted(differs, np.arange(differs[-1] + 1))
        at = differs[nearest]
        types[: differs[-1] + 1] = text[at] < text[at + 1]
    return types


def _dealt(bins: list[list[np.ndarray]], symbols: np.ndarray, suffixes: np.ndarray) -> None:
    """Append suffixes to the bins of their symbols, keeping their order."""
    if not len(symbols):
        return
    order = np.argsort(symbols, kind="stable")
    symbols, suffixes = symbols[order], suffixes[order]
    cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    for symbol, part in zip(symbols[np.concatenate(([0], cuts))], np.split(suffixes, cuts), strict=True):
        bins[symbol].append(part)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    if not parts:
        return np.zeros(0, np.int64)
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def induced(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in order, induced from the leftmost-smaller ones in the order of ``seeds``.

    Buckets are passed in order; within one, whole waves are dealt to the buckets of their
    predecessors at once, those of the own bucket forming the next wave.
    """
    starting: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    _dealt(starting, text[seeds], seeds)
    larger: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    placed: list[np.ndarray] = []
    for symbol in range(symbols):
        wave, waves = _joined(larger[symbol]), []
        while len(wave):
            waves.append(wave)
            before = wave[wave > 0] - 1
            before = before[~smaller[before]]
            of = text[before]
            own = of == symbol
            if not own.all():
                _dealt(larger, of[~own], before[~own])
            wave = before[own]
        placed.append(_joined(waves))
        before = _joined(starting[symbol])
        before = before[before > 0] - 1
        before = before[~smaller[before]]
        if len(before):
            _dealt(larger, text[before], before)
    less: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    less[text[-1]].append(np.array([len(text) - 1]))
    result: list[np.ndarray] = []
    for symbol in range(symbols - 1, -1, -1):
        wave, waves = _joined(less[symbol]), []
        while len(wave):
            waves.append(wave)
            before = wave[wave > 0] - 1
            before = before[smaller[before]]
            of = text[before]
            own = of == symbol
            if not own.all():
                _dealt(less, of[~own], before[~own])
            wave = before[own]
        result.append(_joined(waves))
        before = placed[symbol][::-1]
        result.append(before)
        before = before[before > 0] - 1
        before = before[smaller[before]]
        if len(before):
            _dealt(less, text[before], before)
    return _joined(result)[::-1]


def doubled(text: np.ndarray) -> np.ndarray:
    """The suffix array by prefix doubling."""
    n, rank, step = len(text), text.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        key = rank * (int(rank.max()) + 3) + after if step < n else rank
        _, rank = np.unique(key, return_inverse=True)
        if rank.max() == n - 1:
            return np.argsort(rank)
        step *= 2


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Suffixes of ``text`` in order; its last symbol is 0 and no other is. Symbols are below ``symbols``.

    Leftmost-smaller substrings are sorted by inducing, named, and the text of names is sorted
    recursively; the order of all suffixes is induced from it.
    """
    if symbols > MOST_SYMBOLS or len(text) < 3:
        return doubled(text)
    smaller = smaller_types(text)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(leftmost) < 2:
        return induced(text, smaller, leftmost, symbols)
    first = induced(text, smaller, leftmost, symbols)
    is_leftmost = np.zeros(len(text), bool)
    is_leftmost[leftmost] = True
    ordered = first[is_leftmost[first]]
    number = np.zeros(len(text), np.int64)
    number[leftmost] = np.arange(len(leftmost))
    sizes = np.append(np.diff(leftmost) + 1, 1)
    hashes = Sums(text).hashes(leftmost, sizes)
    which = number[ordered]
    new = np.ones(len(ordered), bool)
    new[1:] = (hashes[which[1:]] != hashes[which[:-1]]) | (sizes[which[1:]] != sizes[which[:-1]])
    names = np.zeros(len(leftmost), np.int64)
    names[which] = np.cumsum(new) - 1
    if new.all():
        order = which
    else:
        order = suffix_array(names, int(names.max()) + 1)
    return induced(text, smaller, leftmost[order], symbols)


def common_prefixes(text: np.ndarray, array: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position in text order: the suffix before it in the array, and their common prefix.

    ``left`` bounds the prefix of each suffix; prefixes are measured up to 255.
    """
    before = np.full(len(text), -1, np.int64)
    before[array[1:]] = array[:-1]
    here = np.flatnonzero(before >= 0)
    there = before[here]
    most = np.minimum(left[here], left[there])
    sums, size = Sums(text), np.zeros(len(here), np.int64)
    active = np.arange(len(here))
    for step in (128, 64, 32, 16, 8, 4, 2, 1):
        fits = active[size[active] + step <= most[active]]
        same = sums.hashes(here[fits] + size[fits], step) == sums.hashes(there[fits] + size[fits], step)
        size[fits[same]] += step
    result = np.zeros(len(text), np.int64)
    result[here] = size
    return before, result
