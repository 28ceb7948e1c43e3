"""Masks and elevation squares as numpy arrays, for use within tasks."""

from __future__ import annotations

import numpy as np


def triangular(width: int) -> np.ndarray:
    """Weights 1 .. width + 1 .. 1, of sum one."""
    k = np.concatenate([np.arange(1, width + 2), np.arange(width, 0, -1)]).astype(np.float64)
    return k / k.sum()


def blur(mask: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """A separable kernel along rows and columns, the last two axes; what lies outside counts as zero."""
    w = len(kernel) // 2
    for axis in (-1, -2):
        wide = np.pad(mask, [(w, w) if a == mask.ndim + axis else (0, 0) for a in range(mask.ndim)])
        size = mask.shape[axis]
        mask = sum(k * np.take(wide, range(d, d + size), axis) for d, k in enumerate(kernel[::-1]))
    return mask


def shore(mask: np.ndarray, width: int, mode: str = "sand") -> np.ndarray:
    """Water masks (0 to 255; the last two axes are a mask's) with a soft edge: ``sand`` blurs, ``rocks`` blurs and steepens, ``steps`` has three levels."""
    soft = blur(mask.astype(np.float64), triangular(width))
    if mode == "rocks":
        soft = 127.5 + 127.5 * np.tan((soft / 127.5 - 1) * np.pi / 4)
    elif mode == "steps":
        soft = np.select([soft >= 200, soft >= 100, soft > 30], [255, 160, 80], 0)
    elif mode != "sand":
        raise ValueError(f"mode is sand, rocks or steps, not {mode!r}")
    return np.clip(np.rint(np.maximum(soft, mask)), 0, 255).astype(np.uint8)


def rasterise(triangles: np.ndarray, size: int) -> np.ndarray:
    """Pixels of a square image whose middle lies in any of the triangles (n, 3, 2) in pixel units."""
    out = np.zeros((size, size), bool)
    for t in triangles:
        lo, hi = np.clip(np.floor(t.min(0)), 0, size).astype(int), np.clip(np.ceil(t.max(0)), 0, size).astype(int)
        y, x = np.mgrid[lo[1] : hi[1], lo[0] : hi[0]] + 0.5
        side = [(t[j, 0] - t[i, 0]) * (y - t[i, 1]) - (x - t[i, 0]) * (t[j, 1] - t[i, 1]) for i, j in ((0, 1), (1, 2), (2, 0))]
        out[lo[1] : hi[1], lo[0] : hi[0]] |= np.all([s >= 0 for s in side], 0) | np.all([s <= 0 for s in side], 0)
    return out


def three_times(z: np.ndarray) -> np.ndarray:
    """A square of n by n samples as 3 (n - 1) + 1 by as many, between which values go linearly."""
    n = 3 * (len(z) - 1) + 1
    at = np.arange(n) / 3
    low = np.minimum(at.astype(int), len(z) - 2)
    share = at - low
    rows = z[low] * (1 - share)[:, None] + z[low + 1] * share[:, None]
    return rows[:, low] * (1 - share) + rows[:, low + 1] * share


def smooth_within(z: np.ndarray, weight: np.ndarray, width: int) -> np.ndarray:
    """Smoothed where ``weight`` (0 to 1) is above zero, in that share, and fading into the old values at the square's sides."""
    if not width:
        return z
    k = triangular(width)
    top, bottom = blur(z * weight, k), blur(weight, k)
    some = weight > 0
    out = z.astype(np.float64).copy()
    out[some] = weight[some] * top[some] / bottom[some] + (1 - weight[some]) * z[some]
    near = np.minimum(np.arange(len(z)), np.arange(len(z))[::-1]) / width
    across = np.minimum(np.arange(z.shape[1]), np.arange(z.shape[1])[::-1]) / width
    share = np.minimum(near, 1)[:, None] * np.minimum(across, 1)[None, :]
    return share * out + (1 - share) * z
