"""SuperMinHash signatures: correlated permutation ranks with early stopping, vectorised over the texts of a chunk."""

from __future__ import annotations

import numpy as np

from ._bytes import mix

_U = np.uint64
_FRACTION = 24
_EMPTY = np.int64(1 << 62)


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """One row of ``m`` values for each set of 64-bit hashes.

    Element e draws a random permutation of the m slots (Fisher-Yates, step by step) and offers slot number j of that
    permutation the value j + u, u uniform in [0, 1); a slot keeps its least offer. A set stops after step j when
    every slot holds a value below j + 1, since later offers cannot win; long texts stop after the first step.
    """
    sizes = np.array([len(s) for s in sets])
    h = np.full((len(sets), m), _EMPTY, np.int64)
    flat = h.ravel()
    if not sizes.sum():
        return h
    seed, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    slots: np.ndarray | None = None
    for j in range(m):
        with np.errstate(over="ignore"):
            x = mix(seed + _U((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        k = j + (((x & _U(0xFFFFFFFF)) * _U(m - j)) >> _U(32)).astype(np.int64)
        value = (x >> _U(64 - _FRACTION)).astype(np.int64) + (j << _FRACTION)
        if slots is None:
            slot = k
        else:
            row = np.arange(len(k))
            slot = slots[row, k].astype(np.int64)
            slots[row, k] = slots[:, j]
        np.minimum.at(flat, owner * m + slot, value)
        left = (h.max(axis=1) >> _FRACTION) > j
        stay = left[owner]
        if not stay.any():
            break
        if slots is None:
            seed, owner, k = seed[stay], owner[stay], k[stay]
            slots = np.tile(np.arange(m, dtype=np.uint16 if m > 256 else np.uint8), (len(k), 1))
            slots[np.arange(len(k)), k] = 0
        elif stay.mean() < 0.7:
            seed, owner, slots = seed[stay], owner[stay], slots[stay]
    return h


def packed(h: np.ndarray) -> np.ndarray:
    """Signature values as 16 bits each: equal values stay equal, others agree once in 65,536."""
    return (mix(h.astype(_U)) & _U(0xFFFF)).astype("<u2")
