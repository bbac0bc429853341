"""Texts as numpy arrays: code points, words and rolling hashes for many texts at a time."""

from __future__ import annotations

from functools import cache

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C55)


def chunks(texts: list[str], most: int = 1_000_000):
    """(first, last) index ranges of at most ``most`` characters, or of one longer text."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and where each text begins (with the end as the last entry)."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), bounds


@cache
def alnum_table() -> np.ndarray:
    return np.array([chr(i).isalnum() for i in range(0x10000)] + [True])


def is_word(cps: np.ndarray) -> np.ndarray:
    """Letters and digits; everything beyond the basic plane counts as a letter."""
    return alnum_table()[np.minimum(cps, 0x10000)]


def runs(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; no run crosses a bound."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.zeros(n + 1, bool)
    fresh[bounds] = True
    before = np.zeros(n, bool)
    before[1:] = mask[:-1]
    start = mask & (~before | fresh[:-1])
    after = np.zeros(n, bool)
    after[:-1] = mask[1:]
    end = mask & (~after | fresh[1:])
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n + 1 of each."""
    size = max(1 << 16, 1 << int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        up, down = np.full(size + 1, BASE), np.full(size + 1, inverse)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Prefix sums of value * base**position; see ``substring_hashes``."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=out[1:])
    return out


def substring_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of [start, end), equal for equal strings wherever they stand."""
    _, down = powers(len(prefix) - 1)
    return (prefix[end] - prefix[start]) * down[start]


def word_hashes(cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed(substring_hashes(prefix_hashes(cps), start, end))
