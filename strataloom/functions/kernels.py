"""Small numpy helpers for arrays that fit one task: a tile, a crop, a sample."""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import product

import numpy as np


def stable_seed(base: int, *parts) -> int:
    """BLAKE2b of the parts joined by ``::``, 8 bytes, modulo 2**32."""
    text = "::".join(map(str, (base, *parts)))
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big") % (1 << 32)


def neighbours(ndim: int, full: bool) -> list[tuple[int, ...]]:
    """Half of the neighbour offsets: those that lie before a place in raster order."""
    zero = (0,) * ndim
    return [d for d in product((-1, 0, 1), repeat=ndim) if d < zero and (full or sum(map(abs, d)) == 1)]


def components(labels: np.ndarray, full: bool) -> np.ndarray:
    """Components of equal non-zero values, numbered from 1 in raster order of their first places.

    Every place takes the least number among its equal neighbours, and numbers
    jump to their own numbers' numbers, until nothing changes.
    """
    labels = np.asarray(labels)
    root = np.where(labels != 0, np.arange(labels.size).reshape(labels.shape), -1)
    pairs = []
    for d in neighbours(labels.ndim, full):
        here = tuple(slice(max(0, -k), labels.shape[i] - max(0, k)) for i, k in enumerate(d))
        there = tuple(slice(max(0, k), labels.shape[i] - max(0, -k)) for i, k in enumerate(d))
        same = (labels[here] == labels[there]) & (labels[here] != 0)
        pairs.append((root[here][same], root[there][same]))
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*pairs, strict=True))
    parent = roots(labels.size, a, b)
    out = np.zeros(labels.size, np.int64)
    on = labels.ravel() != 0
    _, number = np.unique(parent[on], return_inverse=True)
    out[on] = number + 1
    return out.reshape(labels.shape)


def roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component: ``size`` nodes, edges (a, b)."""
    parent = np.arange(size)
    while True:
        ra, rb = parent[a], parent[b]
        live = ra != rb
        if not live.any():
            return parent
        a, b = a[live], b[live]
        np.minimum.at(parent, np.maximum(ra, rb)[live], np.minimum(ra, rb)[live])
        while (parent[parent] != parent).any():
            parent = parent[parent]


def gaussian(sigma: float, truncate: float = 3.0) -> np.ndarray:
    """Weights of radius int(truncate * sigma + 0.5), their sum 1."""
    radius = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return w / w.sum()


@lru_cache(maxsize=512)
def blur_matrix(n: int, sigma: float) -> np.ndarray:
    """The filter along an axis of n places as a banded matrix."""
    w = gaussian(sigma)
    radius = len(w) // 2
    d = np.arange(n)[None, :] - np.arange(n)[:, None]
    return np.where(np.abs(d) <= radius, w[np.clip(d + radius, 0, 2 * radius)], 0.0)


def smooth(data: np.ndarray, sigma: float, first: int = 0) -> np.ndarray:
    """Gaussian filter along all axes from ``first`` on; places beyond the frame count 0."""
    for axis in range(first, data.ndim):
        data = np.moveaxis(np.tensordot(blur_matrix(data.shape[axis], sigma), data, (1, axis)), 0, axis)
    return data


def shape_descriptor(mask: np.ndarray, sigma: float, step: int = 1, start: tuple[int, ...] | None = None) -> np.ndarray:
    """Local shape statistics of one instance: (channels, *shape), 0 outside the mask.

    Channels: mean offsets, variances, Pearson coefficients of axis pairs, mass.
    Sampled every ``step`` places from the frame's origin, then repeated. A
    frame that is a tile has its origin at ``start`` of the instance's frame, a
    multiple of the step.
    """
    ndim, shape = mask.ndim, mask.shape
    full = np.pad(mask.astype(float), [(0, -s % step) for s in shape])
    sub = full[(slice(None, None, step),) * ndim]
    place = np.stack(np.meshgrid(*(np.arange(s, dtype=float) * step for s in sub.shape), indexing="ij"))
    place += np.array(start or (0,) * ndim, float).reshape(-1, *(1,) * ndim)
    pairs = [(i, j) for i in range(ndim) for j in range(i, ndim)]
    # All moments in one product for each axis.
    mass, *rest = smooth(np.stack([sub, *(place[i] * sub for i in range(ndim)), *(place[i] * place[j] * sub for i, j in pairs)]), sigma / step, 1)
    mass = np.where(mass == 0, 1.0, mass)
    mean = np.stack(rest[:ndim]) / mass
    moment = {(i, j): m / mass - mean[i] * mean[j] for (i, j), m in zip(pairs, rest[ndim:], strict=True)}
    variance = np.maximum(np.stack([moment[i, i] for i in range(ndim)]), 1e-3)
    pearson = [moment[i, j] / np.sqrt(variance[i] * variance[j]) for i, j in pairs if i < j]
    channels = np.concatenate([(mean - place) / sigma * 0.5 + 0.5, variance / sigma**2, np.stack(pearson) * 0.5 + 0.5, mass[None]])
    channels = np.clip(channels, 0, 1)
    for axis in range(1, ndim + 1):
        channels = np.repeat(channels, step, axis=axis)
    return channels[(slice(None), *(slice(0, s) for s in shape))] * mask


def spread(seed: np.ndarray, right: np.ndarray, down: np.ndarray, rounds: int) -> np.ndarray:
    """Largest product of edge weights from a seed, after so many rounds over the four directions of the last two axes.

    A round that changes nothing is the last: those after it would change nothing either.
    """
    reach = seed.astype(float)
    for _ in range(rounds):
        new = reach.copy()
        new[..., 1:] = np.maximum(new[..., 1:], reach[..., :-1] * right[..., :-1])
        new[..., :-1] = np.maximum(new[..., :-1], reach[..., 1:] * right[..., :-1])
        new[..., 1:, :] = np.maximum(new[..., 1:, :], reach[..., :-1, :] * down[..., :-1, :])
        new[..., :-1, :] = np.maximum(new[..., :-1, :], reach[..., 1:, :] * down[..., :-1, :])
        if np.array_equal(new, reach):
            break
        reach = new
    return reach
