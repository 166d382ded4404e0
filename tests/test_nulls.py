"""Monte-Carlo queries at production's number of permutations and radii."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrain.operators import point_pattern
from cellgrain.plans import pattern_queries

WIDTH, HEIGHT = pattern_queries.WIDTH, pattern_queries.HEIGHT
SCHEMA = "sample_id string, marker string, pt_id long, x double, y double"


@pytest.fixture
def days(spark, monkeypatch):
    """Two days instead of the test tables: views around clicks, and views anywhere."""
    rng, rows, xy = np.random.default_rng(21), [], {}
    for day in ("near", "free"):
        a = rng.uniform(0, 1, (30, 2)) * [WIDTH, HEIGHT]
        b = np.clip(a + rng.normal(0, 5, a.shape), 0, [WIDTH - 1, HEIGHT - 1]) if day == "near" else rng.uniform(0, 1, (30, 2)) * [WIDTH, HEIGHT]
        xy[day] = a, b
        rows += [(day, m, i + 1000 * (m == "view"), *map(float, p)) for m, pts in (("click", a), ("view", b)) for i, p in enumerate(pts)]
    frame = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(pattern_queries, "points", lambda *_: frame)
    return xy


def counts(a, b, radii):
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    return np.array([(d <= r).sum() for r in radii])


def test_toroidal_null_equals_brute_force(spark, days):
    got = {}
    for r in pattern_queries.toroidal_null(spark, "").collect():
        got[r["sample_id"], r["perm_id"], r["r_idx"]] = r["k"]
    assert len(got) == 2 * 1000 * 51
    radii = np.arange(51) * 2.0
    for day, (a, b) in days.items():
        for i in (0, 1, 500, 999):
            moved = (b + [math.fmod(i * 137.5 + 61, WIDTH), math.fmod(i * 271.25 + 97, HEIGHT)]) % [WIDTH, HEIGHT]
            expected = WIDTH * HEIGHT / (len(a) * len(b)) * counts(a, moved, radii)
            assert np.allclose([got[day, i, k] for k in range(51)], expected, rtol=1e-12)


def test_strong_association_is_significant(spark, days):
    """With 19 shifts p was never below 0.05."""
    test = {r["sample_id"]: r for r in pattern_queries.dclf_global(spark, "").collect()}
    assert test["near"]["significant"] and test["near"]["direction"] == "association" and test["near"]["p_two"] < 0.01
    bands = {(r["sample_id"], r["band"]): r for r in pattern_queries.dclf_bands(spark, "").collect()}
    assert bands["near", "coloc"]["direction"] == "association"


@pytest.mark.parametrize("name", ["csr_null", "kde_null", "dense_null", "tile_null"])
def test_nulls_have_all_permutations_and_radii(spark, days, name):
    got = getattr(pattern_queries, name)(spark, "").agg(F.countDistinct("perm_id"), F.countDistinct("r_idx"), F.max("r"), F.count(F.lit(1))).first()
    assert tuple(got) == (1000, 51, 100.0, 2 * 1000 * 51)


def test_permuted_k_equals_cross_k(spark, days):
    a, b = pattern_queries.sides(spark, "")
    perms = spark.range(3).select(F.col("id").alias("perm_id"))
    moved = b.crossJoin(perms).withColumn("x", F.col("x") + F.col("perm_id"))
    one = point_pattern.permuted_k(a, b, moved, perms, ["sample_id"], WIDTH * HEIGHT, 100.0, 2.0)
    two = point_pattern.cross_k(a.crossJoin(perms), moved, ["sample_id", "perm_id"], WIDTH * HEIGHT).select(*one.columns)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_lookup_in_a_table_beyond_broadcast_sorts_nothing(spark, monkeypatch):
    from cellgrain.operators import proximity

    monkeypatch.setattr(proximity, "BROADCAST_ROWS", 2)
    table = spark.createDataFrame([("a", k, float(k)) for k in range(5)], "s string, k int, x double")
    rows = spark.createDataFrame([("a", i, i % 6) for i in range(20)], "s string, pt_id int, k int")
    out = proximity.looked_up(rows, table, ["s", "k"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted((r["pt_id"], r["x"]) for r in out.collect()) == [(i, float(i % 6)) for i in range(20) if i % 6 < 5]
