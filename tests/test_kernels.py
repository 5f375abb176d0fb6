"""Kernels against brute force on small random arrays."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from strataloom.functions import kernels
from tests import plain


@pytest.mark.parametrize(("shape", "full"), [((7, 9), False), ((7, 9), True), ((4, 5, 6), True)])
def test_components_are_flood_fills_in_raster_order(shape, full):
    rng = np.random.default_rng(0)
    for _ in range(20):
        labels = rng.integers(0, 3, shape)
        want, number = np.zeros(shape, int), 0
        steps = [d for d in np.ndindex(*(3,) * len(shape)) if full or sum(abs(k - 1) for k in d) == 1]
        for at in np.ndindex(*shape):
            if labels[at] and not want[at]:
                number += 1
                todo = [at]
                while todo:
                    p = todo.pop()
                    if want[p]:
                        continue
                    want[p] = number
                    for d in steps:
                        q = tuple(a + k - 1 for a, k in zip(p, d, strict=True))
                        if all(0 <= a < s for a, s in zip(q, shape, strict=True)) and labels[q] == labels[at] and not want[q]:
                            todo.append(q)
        assert (kernels.components(labels, full) == want).all()


def test_squared_edt_is_the_nearest_outside_place():
    rng = np.random.default_rng(1)
    for _ in range(20):
        mask = rng.random((6, 8)) < 0.8
        out = np.argwhere(~np.pad(mask, 1))
        want = np.array([[((out - (y + 1, x + 1)) ** 2).sum(axis=1).min() if mask[y, x] else 0 for x in range(8)] for y in range(6)])
        assert (plain.squared_edt(mask) == want).all()


def test_smoothing_equals_direct_sums_on_short_axes():
    rng = np.random.default_rng(2)
    data, w = rng.random((5, 21)), kernels.gaussian(2.5)
    want = np.zeros_like(data)
    for y, x in np.ndindex(*data.shape):
        for v, u in np.ndindex(*data.shape):
            if abs(v - y) <= 8 and abs(u - x) <= 8:
                want[y, x] += data[v, u] * w[v - y + 8] * w[u - x + 8]
    assert np.allclose(kernels.smooth(data, 2.5), want)


def test_seeds_are_blake2b():
    text = hashlib.blake2b(b"1998::a::7", digest_size=8).hexdigest()
    assert kernels.stable_seed(1998, "a", 7) == int(text, 16) % 2**32
