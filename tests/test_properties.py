"""Known answers and invariances of the point-pattern, registration and mixture operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrain.functions import geometry
from cellgrain.operators import aggregates, envelopes, point_pattern, proximity, registration, stochastic, thresholds

BY = ["s"]


def points(spark, xy, sample="a"):
    return spark.createDataFrame([(sample, k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "s string, pt_id long, x double, y double")


def uniform(n, seed, size=1000):
    return np.random.default_rng(seed).uniform(0, size, (n, 2))


def test_csr_has_no_excess(spark):
    k = point_pattern.cross_k(points(spark, uniform(300, 1)), points(spark, uniform(300, 2)), BY, 1e6)
    assert abs(k.where("r = 20").first()["lmr"]) < 8
    assert k.where("r = 0").first()["k"] == 0


def test_attraction_shows(spark):
    a = uniform(200, 3)
    rng = np.random.default_rng(4)
    b = a[rng.integers(0, 200, 300)] + rng.normal(0, 6, (300, 2))
    assert point_pattern.cross_k(points(spark, a), points(spark, b), BY, 1e6).where("r = 20").first()["lmr"] > 12


def test_curve_is_monotone_and_moves_with_nothing(spark):
    a, b = uniform(150, 5), uniform(120, 6)
    one = [r["pairs"] for r in point_pattern.pair_counts(points(spark, a), points(spark, b), BY).orderBy("r_idx").collect()]
    two = [r["pairs"] for r in point_pattern.pair_counts(points(spark, a + 5000).repartition(7), points(spark, b + 5000), BY).orderBy("r_idx").collect()]
    assert one == sorted(one) and one == two


def test_boundary_pairs_count(spark):
    got = {r["r_idx"]: r["pairs"] for r in point_pattern.pair_counts(points(spark, [(0, 0)]), points(spark, [(2, 0), (0, 6), (100, 0), (0, 0)]), BY).collect()}
    assert (got[0], got[1], got[2], got[3], got[49], got[50]) == (1, 2, 2, 3, 3, 4)


def test_empty_side_gives_zero_rows(spark):
    k = point_pattern.cross_k(points(spark, [(1, 1)]), points(spark, []), BY, 1e6)
    assert k.count() == 51 and k.agg(F.max("k")).first()[0] == 0


def test_nearest_matches_brute_force(spark):
    a, b = uniform(120, 7), np.concatenate([uniform(30, 8, 100), [[5000, 5000]]])
    got = {r["a_id"]: r["b_id"] for r in proximity.nearest(points(spark, a), points(spark, b), BY, 10.0).collect()}
    d = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    assert got == dict(enumerate(d.argmin(axis=1).tolist()))


def test_greedy_takes_nearest_first(spark):
    m = proximity.greedy_match(points(spark, [(0, 0), (3, 0)]), points(spark, [(2, 0), (9, 0)]), BY, 10.0).collect()
    assert {(r["a_id"], r["b_id"]) for r in m} == {(1, 0), (0, 1)}


def test_similarity_recovers_a_transform(spark):
    m = uniform(20, 9)
    t, s = math.radians(12), 1.1
    r = s * (m @ np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]])) + [30, -8]
    lm = spark.createDataFrame([("p", k, *map(float, (*r[k], *m[k]))) for k in range(20)], "pair_id string, lm_id int, rx double, ry double, mx double, my double")
    fit = registration.similarity_fit(lm, ["pair_id"]).first()
    assert math.isclose(fit["a"], s * math.cos(t), abs_tol=1e-9) and math.isclose(fit["b"], s * math.sin(t), abs_tol=1e-9)
    assert registration.leave_one_out(lm, ["pair_id"]).agg(F.max("loo_err")).first()[0] < 1e-6
    bent = lm.withColumn("rx", F.when(F.col("lm_id") < 2, F.col("rx") + 300).otherwise(F.col("rx")))
    robust = registration.huber_similarity(bent, ["pair_id"]).first()
    assert abs(robust["a"] - s * math.cos(t)) < 0.02
    assert registration.certify(lm, ["pair_id"], 0.5, 1000.0, 1000.0).first()["verdict"] == "CERTIFIED"


def test_centroids(spark):
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (4, 0), (4, 2), (0, 2)]])
    line = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(0.0).alias("y")) for x in (0, 1, 5)])
    row = spark.range(1).select(*geometry.shoelace_centroid(square), *geometry.shoelace_centroid(line)).first()
    assert tuple(row) == (2.0, 1.0, 2.0, 0.0)


def test_draws_do_not_depend_on_partitioning(spark):
    a, b = points(spark, uniform(40, 10)), points(spark, uniform(40, 11))
    runs = [sorted(map(tuple, stochastic.csr_null(a.repartition(n), b.repartition(n), BY, 1000.0, 1000.0, 3, 60.0, 4.0).collect())) for n in (1, 5)]
    assert runs[0] == runs[1]


def test_null_sizes(spark):
    """Of independent patterns few are significant, of attracted ones all."""
    rows_a, rows_b = [], []
    rng = np.random.default_rng(12)
    for k in range(24):
        a = rng.uniform(0, 500, (60, 2))
        b = rng.uniform(0, 500, (60, 2)) if k < 18 else a + rng.normal(0, 6, a.shape)
        rows_a += [(f"s{k:02d}", i, *map(float, p)) for i, p in enumerate(a)]
        rows_b += [(f"s{k:02d}", i, *map(float, p)) for i, p in enumerate(b)]
    a, b = (spark.createDataFrame(r, "s string, pt_id long, x double, y double") for r in (rows_a, rows_b))
    observed = point_pattern.cross_k(a, b, BY, 250000.0, 60.0, 4.0)
    test = envelopes.global_test(stochastic.csr_null(a, b, BY, 500.0, 500.0, 39, 60.0, 4.0), observed, BY, {"all": (10.0, 50.0)}).collect()
    assert sum(r["significant"] for r in test if r["s"] < "s18") <= 5
    assert all(r["direction"] == "association" for r in test if r["s"] >= "s18")


def test_mixture_finds_the_gap():
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.normal(0.1, 0.03, 500), rng.normal(0.5, 0.08, 300)])
    g = stochastic.mixture(np.ones(len(x)), x, x * x)
    assert 0.18 < g["cut"] < 0.35 and g["ashman"] > 2 and g["bic2"] < g["bic1"]
    assert stochastic.mixture(np.ones(5), np.arange(5.0), np.arange(5.0) ** 2) is None


def test_exact_test_known_value(spark):
    t = spark.createDataFrame([(8, 2, 1, 5), (0, 0, 0, 0), (3, 0, 0, 3)], "n11 long, n10 long, n01 long, n00 long")
    p = {r["n11"]: r["p_fisher"] for r in aggregates.fisher_exact(t).collect()}
    assert math.isclose(p[8], 0.03496503, rel_tol=1e-6) and p[0] == 1 and math.isclose(p[3], 0.1, rel_tol=1e-9)


def test_adjustment_is_monotone(spark):
    t = spark.createDataFrame([(1, k, p) for k, p in enumerate([0.01, 0.04, 0.03, None, 0.5, float("nan")])], "fam int, ord int, p double")
    q = {r["ord"]: r["q"] for r in envelopes.adjust(t, ["fam"]).collect()}
    assert q[0] == 0.04 and math.isclose(q[2], 0.04 * 4 / 3) and math.isclose(q[1], 0.04 * 4 / 3) and q[4] == 0.5 and q[3] is None and q[5] is None


def test_thresholds_on_separated_values(spark):
    v = spark.createDataFrame([("i", float(x)) for x in [0.1] * 50 + [0.9] * 50 + [float("nan")]], "image string, v double")
    assert 0.1 <= thresholds.otsu_capped(v, ["image"], "v").first()["threshold"] <= 0.9
    s = spark.createDataFrame([("i", float(k), int(k >= 5)) for k in range(10)], "image string, score double, y int")
    assert thresholds.rank_auc(s, ["image"], "score", "y").first()["auc"] == 1
    assert thresholds.best_f1(s, ["image"], "score", "y").first()["cut"] == 4


def test_points_in_a_ring_with_a_hole(spark):
    ring = [(0, 0, 10, 0), (10, 0, 10, 10), (10, 10, 0, 10), (0, 10, 0, 0), (4, 4, 6, 4), (6, 4, 6, 6), (6, 6, 4, 6), (4, 6, 4, 4)]
    edges = spark.createDataFrame([("a", *map(float, e)) for e in ring], "s string, x0 double, y0 double, x1 double, y1 double")
    inside = proximity.points_in_rings(points(spark, [(1, 1), (5, 5), (11, 5), (9, 3)]), edges, BY)
    assert sorted(r["pt_id"] for r in inside.collect()) == [0, 3]


@pytest.mark.parametrize("n", [1, 3, 10])
def test_strided_is_even(spark, n):
    got = [r["id"] for r in aggregates.strided(spark.range(100), "id", n).orderBy("id").collect()]
    assert got == ([0] if n == 1 else [round(i * 99 / (n - 1)) for i in range(n)])
