"""The nulls of all pairs are planned and done one after another; support that pairs share is given once."""

import numpy as np
from pyspark.sql import functions as F

from cellgrain.operators import stochastic
from cellgrain.plans import workflows

W = H = 300.0


def points(spark):
    rng = np.random.default_rng(3)
    rows = [("s", m, 1000 * k + i, *map(float, p)) for k, (m, n) in enumerate({"a": 12, "b": 10, "c": 11, "other": 480}.items()) for i, p in enumerate(rng.uniform(0, W, (n, 2)))]
    return spark.createDataFrame(rows, "s string, marker string, pt_id long, x double, y double")


def test_what_is_returned_plans_no_null(spark):
    out = workflows.association_pairs(points(spark), ["s"], ["a", "b", "c"], W, H, 9, 60.0, 10.0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" not in plan and len(plan) < 50_000
    assert out.count() == 3 and out.where("p is null").isEmpty()


def test_shared_support(spark):
    pts = points(spark)
    pairs = F.explode(F.array(F.lit("p"), F.lit("q")))
    a, b = (pts.where(f"marker = '{m}'").select("s", pairs.alias("pair"), "pt_id", "x", "y") for m in "ab")
    shared = pts.select("s", "pt_id", "x", "y")
    curves = [sorted(map(tuple, stochastic.support_null(a, b, x, ["s", "pair"], W, H, 5, 60.0, 10.0).collect())) for x in (shared, shared.withColumn("pair", pairs))]
    assert curves[0] == curves[1] and len(curves[0]) == 2 * 5 * 7
