"""Plain numpy forms that the tests hold operators against."""

from __future__ import annotations

import numpy as np


def squared_edt(mask: np.ndarray) -> np.ndarray:
    """Squared distance of each place of a mask to the nearest place outside it; beyond the frame is outside.

    Exact and separable: the distance along each axis in turn, minimised over
    all offsets of that axis (frames are crops, so the axes are short).
    """
    mask = np.pad(np.asarray(mask, bool), 1)
    far = sum(s * s for s in mask.shape)
    out = np.where(mask, far, 0).astype(np.int64)
    for axis in range(mask.ndim):
        line = np.moveaxis(out, axis, 0)
        best = line.copy()
        for step in range(1, line.shape[0]):
            if step * step >= best.max():
                break
            best[step:] = np.minimum(best[step:], line[:-step] + step * step)
            best[:-step] = np.minimum(best[:-step], line[step:] + step * step)
        out = np.moveaxis(best, 0, axis)
    return out[tuple(slice(1, -1) for _ in range(mask.ndim))]


def erode(mask: np.ndarray, times: int, outside: bool) -> np.ndarray:
    """Binary erosion by the cross; ``outside``: whether places beyond the frame count as set."""
    for _ in range(times):
        padded = np.pad(mask, 1, constant_values=outside)
        kept = mask.copy()
        for axis in range(mask.ndim):
            for d in (0, 2):
                kept &= padded[tuple(slice(d, d + s) if i == axis else slice(1, 1 + s) for i, s in enumerate(mask.shape))]
        mask = kept
    return mask


def farthest_points(points: np.ndarray, depth: np.ndarray, k: int, first: int) -> list[int]:
    """Greedy choice: each next point has the largest minD**2 / (1 + depth + 1e-3), the first of equals."""
    picked = [first]
    gap = ((points - points[first]) ** 2).sum(axis=1).astype(float)
    while len(picked) < min(k, len(points)):
        score = gap / (1.0 + depth + 1e-3)
        score[picked] = -1
        picked.append(int(score.argmax()))
        gap = np.minimum(gap, ((points - points[picked[-1]]) ** 2).sum(axis=1))
    return picked
