"""Hashed character n-grams of many strings at once, in numpy."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(strings: list[str], orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of every n-gram of the orders; owner is the string's index, buckets have ``bits`` bits."""
    code = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(strings)), [len(s) for s in strings])
    owners, buckets = [], []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(orders) + 1):
        if n > len(code):
            break
        h = h[: len(code) - n + 1] * _BASE + code[n - 1 :] + np.uint64(1)
        if n in orders:
            whole = owner[: len(h)] == owner[n - 1 :]
            owners.append(owner[: len(h)][whole])
            buckets.append(((h[whole] + np.uint64(n)) * _MIX) >> np.uint64(64 - bits))
    if not owners:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(owners), np.concatenate(buckets).astype(np.int64)
