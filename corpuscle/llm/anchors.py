"""Anchors: places of a text that its repeated strings must share.

A window of ``length`` bytes is anchored at the least hash of its ``gram``-byte strings, the leftmost of equals. Equal windows have their
anchors at equal offsets, wherever they stand, so a window repeats only where its anchor's string does. Neighbouring windows mostly share
their anchor: about two anchors for each ``length - gram`` bytes stand for all windows.
"""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_PLACE = 31
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_ODD, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from every place on."""
    up, down = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window, hash) of every anchor of ``data``, by place; windows by their first byte."""
    if len(data) < length:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    h = gram_hashes(data, gram)
    width = length - gram + 1
    ranked = (h >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)
    blocks = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(h)] = ranked
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    n = len(data) - length + 1
    place = (np.minimum(ahead[:n], behind[width - 1 : width - 1 + n]) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
    last = np.concatenate((first[1:] - 1, [n - 1]))
    return place[first], first, last, h[place[first]]
