"""The support null drawn, placed and counted inside tasks, against the same draws as joined rows."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrain.operators import blocks, stochastic

SCHEMA = "g string, pt_id long, x double, y double"


def frame(spark, rng, n, first, groups="ab"):
    return spark.createDataFrame([(g, first + i, *map(float, p)) for g in groups for i, p in enumerate(np.stack([rng.exponential(20, n).clip(0, 200), rng.uniform(0, 300, n)], axis=1))], SCHEMA)


@pytest.mark.parametrize("fixed", [0, blocks.FIXED])
def test_same_curves_as_joined_rows(spark, monkeypatch, fixed):
    rng = np.random.default_rng(6)
    a, b, support = frame(spark, rng, 30, 0), frame(spark, rng, 25, 100), frame(spark, rng, 60, 500, "abc")
    a, b = (d.withColumn("pair", F.lit("p")) for d in (a, b))  # support is shared by a sample's pairs
    run = lambda: sorted(map(tuple, stochastic.support_null(a, b, support, ["g", "pair"], 200.0, 300.0, 60, 30.0, 2.0).collect()))
    monkeypatch.setattr(blocks, "FIXED", fixed)
    new = run()
    monkeypatch.setattr(stochastic, "SUPPORT", 0)
    assert len(new) == 2 * 60 * 16 and new == run()


def test_hash_is_that_of_spark(spark):
    rows = spark.range(300).select(F.xxhash64(F.lit(3), F.lit("g"), "id").alias("h"), F.xxhash64(F.lit(3), F.lit("g"), "id", F.lit(77), F.lit("v")).alias("hv"), stochastic.uniform(F.lit(3), F.lit("g"), "id", F.lit("s")).alias("s")).toPandas()
    h = rows["h"].to_numpy().view(np.uint64)
    with np.errstate(over="ignore"):
        assert (stochastic.hashed_on(stochastic.hashed_on(h, 77), "v").view(np.int64) == rows["hv"].to_numpy()).all()
        assert (stochastic.uniform_on(h, "s") == rows["s"].to_numpy()).all()


def test_draws_that_leave_the_window_are_cheap(spark):
    """200,000 draws at a corner, three in four of which leave the window: lists of 127 further positions for each before."""
    corner = spark.range(200).select(F.lit("g").alias("g"), F.col("id").alias("pt_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    began = time.time()
    got = stochastic.support_null(corner.limit(1), corner, corner, ["g"], 100.0, 100.0, 1000, 20.0, 2.0).where("r_idx = 10").agg(F.min("k"), F.max("k"), F.count(F.lit(1))).first()
    assert got[0] == got[1] == 10_000.0 and got[2] == 1000  # all held inside, all within 20 of the corner
    assert time.time() - began < 25
