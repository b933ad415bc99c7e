"""Content-defined places to cut texts, from a gear rolling hash over bytes."""

from __future__ import annotations

import numpy as np

#: Random words, one per byte value, from a fixed seed.
GEAR = np.random.default_rng(20_011).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling(data: np.ndarray, window: int) -> np.ndarray:
    """Gear hash of the last ``window`` bytes (a power of two, at most 32) at each byte.

    h(i) = sum of GEAR[data[i - k]] << k; a sum over 2w bytes is one over w plus the one before it, shifted.
    """
    h = GEAR[data]
    step = 1
    while step < window:
        if len(h) > step:
            h[step:] += h[:-step].copy() << np.uint32(step)
        step *= 2
    return h


def _later(values: np.ndarray, n: int) -> np.ndarray:
    """Largest of the next n values at each place, 0 beyond the end."""
    wide = np.concatenate((values[1:], np.zeros(n, values.dtype)))
    reach = 1
    while reach * 2 <= n:
        wide = np.maximum(wide[:len(wide) - reach], wide[reach:])
        reach *= 2
    return np.maximum(wide[:len(values)], wide[n - reach:n - reach + len(values)])


def peaks(data: np.ndarray, window: int, around: int, longest: int) -> np.ndarray:
    """Cuts after each byte whose hash exceeds those of the ``around`` bytes on either side.

    Whether there is a cut depends on window + 2 * around bytes only, so an insertion moves no cut further away.
    Chunks have more than ``around`` bytes; one longer than ``longest``, which only monotonous bytes give, is cut by length.
    Returns the ends of all chunks; the last is the length of the data.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    h = rolling(data, window)
    high = (h > _later(h, around)) & (h[::-1] > _later(h[::-1], around))[::-1]
    return _bounded(np.flatnonzero(high) + 1, data, longest)


def masked(data: np.ndarray, window: int, bits: int, longest: int) -> np.ndarray:
    """Cuts after each byte whose hash begins with ``bits`` zeros: chunks of 2**bits bytes on average."""
    if not len(data):
        return np.zeros(0, np.int64)
    return _bounded(np.flatnonzero(rolling(data, window) >> np.uint32(32 - bits) == 0) + 1, data, longest)


def _bounded(ends: np.ndarray, data: np.ndarray, longest: int) -> np.ndarray:
    ends = np.append(ends[ends < len(data)], len(data))
    gaps = np.diff(ends, prepend=0)
    if gaps.max() > longest:
        cut = [np.arange(e - g + longest, e, longest) for e, g in zip(ends[gaps > longest], gaps[gaps > longest])]
        ends = np.sort(np.concatenate([ends, *cut]))
    # never inside a character
    inner = ends[:-1]
    while len(inner) and (bad := (data[inner] & 0xC0) == 0x80).any():
        inner = inner + bad
        inner = inner[inner < len(data)]
    return np.append(np.unique(inner), len(data))
