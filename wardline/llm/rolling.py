"""Hashes of all runs of values of one length, and the lowest of each so many in a row."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, size: int) -> np.ndarray:
    if len(_powers.get(name, ())) < size:
        row = np.full(size, base, np.uint64)
        row[0] = 1
        _powers[name] = np.cumprod(row)
    return _powers[name][:size]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A well mixed hash of the ``gram`` bytes at each place, by one running sum over the data."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(data)), out=sums[1:])
    return _mixed((sums[gram:] - sums[:-gram]) * _power("down", _INVERSE, len(sums) - gram))


def run_hashes(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A well mixed hash of each run of bytes; the runs of these sizes fill the data."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(data)), out=sums[1:])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    return _mixed((sums[ends] - sums[starts]) * _power("down", _INVERSE, len(sums))[starts])


def _mixed(found: np.ndarray) -> np.ndarray:
    found ^= found >> np.uint64(31)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    found ^= found >> np.uint64(29)
    return found


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, from running minima of blocks in both directions."""
    size = len(values) - width + 1
    full = -(-len(values) // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:size], ahead[width - 1 : width - 1 + size])
