"""Mutual nearest pairs by cells that grow, against every two points."""

import time

import numpy as np
import pyarrow as pa

from cellgrain.operators import blocks


def cloud(rng, n, round_to=0.0):
    xy = np.stack([rng.exponential(50, n), rng.uniform(0, 1000, n)], axis=1)
    xy = np.unique(np.round(xy / round_to) * round_to, axis=0) if round_to else xy
    return blocks.Cloud(pa.table({"x": xy[:, 0], "y": xy[:, 1], "w": np.ones(len(xy)), "pt_id": rng.permutation(len(xy))}), "pt_id")


def plain(a, b, x, y, cap):
    d = np.sqrt((x[:, None] - a.x) ** 2 + (y[:, None] - a.y) ** 2)
    first = lambda d, ids: np.where(d.min(axis=1) <= cap, np.where(d == d.min(axis=1)[:, None], ids[None, :], 1 << 40).argmin(axis=1), -1)
    of_b, of_a = first(d, a.more[0]), first(d.T, b.more[0])
    return sum(k >= 0 and of_a[k] == i for i, k in enumerate(of_b))


def test_mutual_pairs_after_moves():
    rng = np.random.default_rng(4)
    for n, step, cap in ((1, 0, 20), (3, 0, 5), (90, 5, 20), (400, 0, 20), (400, 4, 9)):
        a, b = cloud(rng, n, step), cloud(rng, n + 2, step)
        pairs = blocks.Mutual(a, b, cap)
        for dx, dy in ((0, 0), (step * 2.0, step), (13.7, -220.3), (1e7, 0)):
            assert pairs.count(b.x + dx, b.y + dy) == plain(a, b, b.x + dx, b.y + dy, cap)


def test_mutual_pairs_do_not_meet_the_whole_plane():
    """Ten moves of 6,000 points against 6,000: 3.6e8 pairs if each met each."""
    rng = np.random.default_rng(5)
    a, b = cloud(rng, 6000), cloud(rng, 6000)
    pairs, began = blocks.Mutual(a, b, 20.0), time.time()
    assert all(0 < pairs.count(b.x + k, b.y - 3 * k) < 6000 for k in range(10))
    assert time.time() - began < 5
