"""The association of all marker pairs: plans, routes, errors, the reweighted null and planted attraction."""

import numpy as np
import pytest

from cellgrain.operators import point_pattern, stochastic
from cellgrain.plans import workflows

W = H = 400.0
POINTS = "s string, marker string, pt_id long, x double, y double"


def lam(points, h, area):
    d = np.hypot(*(points[:, None] - points[None]).transpose(2, 0, 1))
    kernel = np.where((d <= 4 * h) & ~np.eye(len(points), dtype=bool), np.exp(-d * d / (2 * h * h)) / (2 * np.pi * h * h), 0).sum(axis=1)
    return np.maximum(kernel, 0.02 * len(points) / area)


def test_reweighted_curves(spark):
    """Each permutation's curve from the drawn points themselves, their intensity estimated anew."""
    rng = np.random.default_rng(1)
    a, b = rng.uniform(0, W, (25, 2)), rng.uniform(0, W, (20, 2))
    sides = [spark.createDataFrame([("s", i, *map(float, p)) for i, p in enumerate(x)], "s string, pt_id long, x double, y double") for x in (a, b)]
    got = {(r["perm_id"], r["r_idx"]): r["k"] for r in stochastic.reweighted_null(*sides, ["s"], W, H, 3, 60.0, 20.0, 75.0, seed=4).collect()}
    assert len(got) == 3 * 4
    moved = stochastic.redrawn(sides[1], ["s"], W, H, 3, 25.0, 75.0, 4).collect()
    for perm in range(3):
        star = np.array([[r["x"], r["y"]] for r in moved if r["perm_id"] == perm])
        assert len(star) == 20 and star.min() >= 0 and star.max() <= W
        weight = 1 / np.outer(lam(a, 75, W * H), lam(star, 75, W * H))
        d = np.hypot(*(a[:, None] - star[None]).transpose(2, 0, 1))
        for k in range(4):
            assert got[perm, k] == pytest.approx((weight * (d <= 20.0 * k)).sum() / (W * H), rel=1e-9, abs=1e-9)


@pytest.fixture(scope="module")
def samples(spark):
    """Days with coarse tissue: a beside b (near), all apart (free), a rare marker (rare), an absent one (gone)."""
    rng, rows = np.random.default_rng(7), []
    for s in ("near", "free", "rare", "gone"):
        centres = rng.uniform(80, 320, (2, 2))
        draw = lambda n, c=centres: np.clip(c[rng.integers(2, size=n)] + rng.normal(0, 90, (n, 2)), 0, W - 1)
        sets = {"a": draw(60), "b": draw(60), "c": draw({"rare": 12, "gone": 2}.get(s, 50)), "other": draw(500)}
        if s == "near":
            sets["b"] = np.clip(sets["a"] + rng.normal(0, 6, (60, 2)), 0, W - 1)
        for m, pts in sets.items():
            rows += [(s, m, len(rows) + i, *map(float, p)) for i, p in enumerate(pts)]
    return spark.createDataFrame(rows, POINTS)


def test_all_pairs(spark, samples):
    certs = spark.createDataFrame([("near", "CERTIFIED", 9.0), ("free", "RADIUS_LIMITED", 25.0), ("rare", "CERTIFIED", None), ("gone", "CERTIFIED", 5.0)], "s string, verdict string, floor_um double")
    out = workflows.association_pairs(samples, ["s"], ["a", "b", "c"], W, H, 39, 60.0, 4.0, certs)
    got = {(r["s"], r["pair"]): r for r in out.collect()}
    assert set(got) == {(s, p) for s in ("near", "free", "rare", "gone") for p in ("a__b", "a__c", "b__c")}
    plan = {r["s"]: r["primary_null"] for r in got.values()}
    assert plan["rare"] == "dense_morphology" and plan["gone"] == "none" and plan["near"] in ("reweighted", "dense_morphology")
    assert got["gone", "a__c"]["error"] == "marker_absent" and got["gone", "a__b"]["error"] == "null_unavailable" and got["gone", "a__b"]["p"] is None
    best = got["near", "a__b"]
    assert best["error"] is None and best["p"] < 0.05 and best["direction"] == "association" and best["coloc"] == "attraction"
    assert all(r["coloc"] == "not_resolvable" for (s, _), r in got.items() if s == "free")
    assert (got["rare", "a__c"]["n_a"], got["rare", "a__c"]["n_b"]) == (60, 12)
    tested = [r for r in got.values() if r["p"] is not None]
    assert all(r["q"] >= r["p"] for r in tested) and len(tested) == 9


def test_fails_closed(spark, samples):
    """No certificate: a plan that needs the support null has none; a floor beyond the radii leaves no test."""
    none = spark.createDataFrame([("rare", "NOT_CERTIFIABLE", 5.0), ("near", "CERTIFIED", 80.0)], "s string, verdict string, floor_um double")
    got = {(r["s"], r["pair"]): r["error"] for r in workflows.association_pairs(samples.where("s in ('rare', 'near')"), ["s"], ["a", "b", "c"], W, H, 9, 60.0, 4.0, none).collect()}
    assert got["rare", "a__b"] == "null_unavailable" and got["near", "a__b"] == "no_interpretable_radius_band"


def test_power_and_warp(spark, samples):
    """Planted attraction is found; a known turn and shift is undone by its inverse; points that leave the window go."""
    pts = samples.where("s = 'free'")
    a, b = (pts.where(f"marker = '{m}'").drop("marker") for m in "ab")
    near = stochastic.attracted(a, b, ["s"], 0.8, 4.0)
    counts = [point_pattern.pair_counts(a, x, ["s"], 12.0, 4.0).orderBy("r_idx").collect()[-1]["pairs"] for x in (b, near)]
    assert counts[1] > 3 * max(counts[0], 5) and near.count() == 60
    back = stochastic.rotated(stochastic.rotated(a, 20.0, 0, 0, 200.0, 200.0), -20.0, 0, 0, 200.0, 200.0)
    assert max(abs(x["x"] - y["x"]) for x, y in zip(a.orderBy("pt_id").collect(), back.orderBy("pt_id").collect(), strict=True)) < 1e-9
    moved = stochastic.displaced(a, ["s"], 50.0, W, H)
    assert 0 < moved.count() <= 60 and moved.where(f"x < 0 or x > {W}").count() == 0
