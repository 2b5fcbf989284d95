"""Rolling hashes over symbol sequences and the stretches of windows that share an anchor.

A window is ``length`` consecutive symbols. Its anchor is the position of the smallest hashed ``gram`` (leftmost
on ties) among the first ``reach`` gram positions of the window, so it depends on the window's own content only:
equal windows have their anchors at equal offsets. A *stretch* is a maximal run of consecutive windows with one
anchor. Two names describe it:

* ``core`` - the ``length - reach`` symbols from the anchor on, which every window of the stretch contains;
* ``whole`` - all symbols of all its windows, and the anchor's offset.

Equal windows therefore lie in stretches of equal ``core``. Stretches of equal ``whole`` hold the same windows.
All names are 64-bit fingerprints.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_MIX = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


def _odd(seed: int) -> int:
    return int(np.random.default_rng(seed).integers(1 << 62, 1 << 63)) * 2 + 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _HALF)
    x = x * _MIX
    return x ^ (x >> _HALF)


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown as sequences get longer."""

    def __init__(self, seed: int):
        self.base = _odd(seed)
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 14)
            for name, step in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(size, step, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


class Prefix:
    """Fingerprints of any range of one sequence, from the prefix sums of its symbols."""

    def __init__(self, symbols: np.ndarray, powers: Powers):
        n = len(symbols)
        powers.need(n + 1)
        self.powers = powers
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * powers.up[:n], out=self.sums[1:])

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.powers.down[:n])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.powers.down[start])


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    rest = width - size
    return np.minimum(a[:-rest], a[rest:]) if rest else a


@dataclass(frozen=True)
class Shape:
    """Window length, anchor gram and anchor reach, in symbols; ``gram + reach <= length``."""

    length: int
    gram: int
    reach: int


_POWERS = Powers(11)
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def byte_symbols(data: bytes) -> np.ndarray:
    return _BYTES[np.frombuffer(data, np.uint8)]


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every run of bytes other than 0x20 and 0x09-0x0D."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.ones(len(raw) + 2, bool)
    edge[1:-1] = _SPACE[raw]
    turns = np.flatnonzero(edge[1:] != edge[:-1])
    return turns[0::2], turns[1::2]


def word_symbols(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint, start and end of every word; a word's length enters its fingerprint."""
    start, end = word_bounds(data)
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    names = Prefix(byte_symbols(data), _POWERS).ranges(start, end)
    return mixed(names + (end - start).astype(np.uint64) * _MIX) | np.uint64(1), start, end


def stretches(symbols: np.ndarray, shape: Shape):
    """(first window, number of windows, core, whole) of every stretch, as arrays; empty below one window."""
    n = len(symbols) - shape.length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    prefix = Prefix(symbols, _POWERS)
    grams = prefix.windows(shape.gram)[: n + shape.reach - 1]
    grams = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    anchors = (sliding_min(grams, shape.reach) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(anchors[1:] != anchors[:-1]) + 1))
    count = np.diff(np.append(first, n))
    anchor = anchors[first]
    core = prefix.ranges(anchor, anchor + (shape.length - shape.reach))
    whole = prefix.ranges(first, first + count - 1 + shape.length)
    whole = mixed(whole + (anchor - first).astype(np.uint64) * _MIX + count.astype(np.uint64))
    return first, count, core.view(np.int64), whole.view(np.int64)


def window_names(symbols: np.ndarray, shape: Shape) -> np.ndarray:
    if len(symbols) < shape.length:
        return np.zeros(0, np.int64)
    return Prefix(symbols, _POWERS).windows(shape.length).view(np.int64)


def covered(first: np.ndarray, count: np.ndarray, length: int, size: int) -> np.ndarray:
    """Mask of the ``size`` symbols that lie in one of the windows given as runs (first, count)."""
    turns = np.zeros(size + 1, np.int32)
    np.add.at(turns, first, 1)
    np.add.at(turns, np.minimum(first + count - 1 + length, size), -1)
    return np.cumsum(turns[:-1]) > 0
