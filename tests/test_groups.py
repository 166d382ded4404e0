"""Large groups: greedy matching by rounds, digests over sorted lines, mixtures of counted values."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import GroupedData

from cellgrain.operators import matching, proximity, stochastic


def test_greedy_rounds_equal_brute_force(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("all pairs of a group in one batch")

    monkeypatch.setattr(GroupedData, "applyInPandas", refused)
    rng = np.random.default_rng(51)
    a, b = rng.integers(0, 40, (60, 2)), rng.integers(0, 40, (50, 2))
    frame = lambda xy: spark.createDataFrame([("s", k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "s string, pt_id long, x double, y double")
    got = {(r["a_id"], r["b_id"]) for r in proximity.greedy_match(frame(a), frame(b), ["s"], 10.0).collect()}
    pairs = sorted((d, i, j) for i, p in enumerate(a) for j, q in enumerate(b) if (d := float(np.sqrt(((p - q) ** 2).sum()))) <= 10)
    expected, i_used, j_used = set(), set(), set()
    for _, i, j in pairs:
        if i not in i_used and j not in j_used:
            expected.add((i, j))
            i_used.add(i)
            j_used.add(j)
    assert got == expected


def test_manifest_streams_sorted_lines(spark):
    rows = [(k % 2, f"f{k * 7 % 50:02d}", str(k).encode()) for k in range(50)]
    files = spark.createDataFrame(rows, "tree int, name string, content binary").repartition(5)
    out = matching.dataset_manifest(files, ["tree"])
    assert "collect_list" not in out._jdf.queryExecution().toString()
    expected = {}
    for tree in (0, 1):
        lines = [f"{hashlib.sha256(c).hexdigest()}  {n}" for t, n, c in sorted(rows, key=lambda r: r[1]) if t == tree]
        expected[tree] = len(lines), hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert {r["tree"]: (r["n_files"], r["manifest"]) for r in out.collect()} == expected


def test_bins_give_the_mixture_of_the_cells(spark):
    """EM over cells one by one, written out plainly, against the fit to bins."""
    x = np.r_[np.random.default_rng(52).normal(0.1, 0.03, 300), np.random.default_rng(53).normal(0.5, 0.08, 200)]
    parts = [x[x <= np.median(x)], x[x > np.median(x)]]
    share, mean, var = [len(p) / len(x) for p in parts], [p.mean() for p in parts], [p.var() for p in parts]
    for _ in range(200):
        dens = np.array([w * np.exp(-((x - m) ** 2) / (2 * v)) / np.sqrt(v) for w, m, v in zip(share, mean, var, strict=True)])
        resp = dens / dens.sum(axis=0)
        share, mean = resp.mean(axis=1), resp @ x / resp.sum(axis=1)
        var = [(r * (x - m) ** 2).sum() / r.sum() for r, m in zip(resp, mean, strict=True)]
    grid = np.linspace(mean[0], mean[1], 200_001)
    dens = [w * np.exp(-((grid - m) ** 2) / (2 * v)) / np.sqrt(v) for w, m, v in zip(share, mean, var, strict=True)]
    cut = grid[np.argmin(abs(dens[0] - dens[1]) + (grid == mean[0]))]
    cells = spark.createDataFrame([("i", float(k)) for k in x] + [("i", None), ("i", float("nan")), ("few", 0.1)], "image string, v double")
    got = {r["image"]: r for r in stochastic.nuclear_thresholds(cells, ["image"], "v").collect()}
    assert got["i"]["n"] == 500 and got["i"]["threshold"] == pytest.approx(cut, abs=1e-3) and got["i"]["method"] == "gmm"
    assert got["few"]["n"] == 1 and got["few"]["abstain"] and got["few"]["threshold"] == 0.2


def test_architecture_scale_of_counts(spark):
    """Clusters of a known width have a scale near it; a pattern of few points has none."""
    rng = np.random.default_rng(9)
    centres = rng.uniform(100, 900, (12, 2))
    rows = [("a", i, *map(float, centres[i % 12] + rng.normal(0, 40, 2))) for i in range(3000)] + [("b", i, float(i), 1.0) for i in range(10)]
    got = {r["s"]: r for r in stochastic.architecture_scale(spark.createDataFrame(rows, "s string, pt_id long, x double, y double"), ["s"], 1000.0, 1000.0).collect()}
    assert 30 < got["a"]["scale"] < 120 and got["b"]["scale"] is None and got["b"]["n"] == 10
