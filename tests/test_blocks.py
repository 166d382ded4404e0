"""Pairs counted in blocks instead of as joined rows."""

import numpy as np

from cellgrain.operators import point_pattern, stochastic

SCHEMA = "s string, pt_id long, x double, y double"


def frame(spark, xy, s="a"):
    return spark.createDataFrame([(s, i, float(x), float(y)) for i, (x, y) in enumerate(xy)], SCHEMA)


def test_equal_positions_count_without_being_paired(spark):
    """300,000 points of one place on both sides: 9e10 pairs, which never ended as joined rows."""
    pts = spark.range(300_000).selectExpr("'a' s", "id pt_id", "7d x", "9d y")
    got = point_pattern.pair_counts(pts, pts, ["s"], 10.0, 2.0).collect()
    assert sorted((r["r_idx"], r["pairs"]) for r in got) == [(i, 300_000**2) for i in range(6)]
    lam = point_pattern.loo_intensity(pts, ["s"], 5.0, 100.0).agg({"lam": "max"}).first()[0]
    assert np.isclose(lam, 299_999 / (2 * np.pi * 25))


def test_crowded_bins_in_parts(spark, monkeypatch):
    """Bins beyond the size of a task are cut on both sides; results stay."""
    from cellgrain.operators import blocks

    rng = np.random.default_rng(3)
    a, b = rng.uniform(0, 40, (300, 2)), rng.uniform(0, 40, (400, 2))
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    plain = point_pattern.pair_counts(frame(spark, a), frame(spark, b), ["s"], 12.0, 1.5)
    one = {r["r_idx"]: r["pairs"] for r in plain.collect()}
    monkeypatch.setattr(blocks, "CROWD", 30)
    cut = {r["r_idx"]: r["pairs"] for r in point_pattern.pair_counts(frame(spark, a), frame(spark, b), ["s"], 12.0, 1.5).collect()}
    assert one == cut == {i: int((d <= i * 1.5).sum()) for i in range(9)}


def test_torus_beyond_the_window(spark):
    """Points right of the window wrap as the SQL has it; pairs over the edge used to be lost there."""
    a, b = [(560.0, 10.0), (5.0, 995.0)], [(115.0, 10.0), (480.0, 4.0), (240.0, 500.0)]
    got = {r["r"]: r["k"] for r in point_pattern.cross_k_torus(frame(spark, a), frame(spark, b), ["s"], 490.0, 1000.0).collect()}
    d = []
    for p in a:
        for q in b:
            dx, dy = abs(p[0] - q[0]), abs(p[1] - q[1])
            d.append(np.hypot(min(dx, abs(490 - dx)), min(dy, abs(1000 - dy))))
    for r, k in got.items():
        assert np.isclose(k, 490000 / 6 * sum(v <= r for v in d))


def test_intensity_of_redrawn_points(spark):
    rng = np.random.default_rng(8)
    xy = rng.uniform(0, 300, (700, 2))
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(axis=2)
    k = np.where(d2 <= 80**2, np.exp(-d2 / 800), 0)
    np.fill_diagonal(k, 0)
    expected = np.maximum(k.sum(axis=1) / (2 * np.pi * 400), 0.02 * 700 / 90000)
    got = {r["pt_id"]: r["lb"] for r in stochastic.with_intensity(frame(spark, xy), ["s"], 20.0, 90000.0).collect()}
    lam = {r["pt_id"]: r["lam"] for r in point_pattern.loo_intensity(frame(spark, xy), ["s"], 20.0, 90000.0).collect()}
    assert np.allclose([got[i] for i in range(700)], expected) and np.allclose([lam[i] for i in range(700)], expected)


def test_pairs_out_of_reach_are_left_out_by_columns(monkeypatch):
    """A histogram of many points works on about twice the pairs it counts, not on strips across the plane; counts stay."""
    import pyarrow as pa

    from cellgrain.operators import blocks

    rng = np.random.default_rng(9)
    cloud = lambda n, *more: blocks.Cloud(pa.table({"x": rng.uniform(-40, 500, n), "y": rng.uniform(0, 1000, n), "w": np.ones(n), "slot": rng.integers(0, 5, n)}), *more)
    a, b, worked, runs = cloud(2000), cloud(30_000, "slot"), [], blocks.blocks

    def counted(*args, **kwargs):
        for block in runs(*args, **kwargs):
            worked.append(block[2].size)
            yield block

    monkeypatch.setattr(blocks, "blocks", counted)
    got = blocks.histogram(a, b, 100.0, 5.0, slots=5)
    expected = np.zeros((5, 21))
    for k in range(0, len(b), 500):
        d = np.hypot(b.x[k : k + 500, None] - a.x, b.y[k : k + 500, None] - a.y)
        near = d <= 100
        np.add.at(expected, (np.broadcast_to(b.more[0][k : k + 500, None], d.shape)[near], np.ceil(d[near] / 5.0).astype(int)), 1)
    assert (got == expected).all()
    assert sum(worked) < 2.5 * expected.sum()
