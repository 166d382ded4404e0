"""Redrawn points are counted where they are drawn: the same curves, and no shuffle of drawn points."""

from pyspark.sql import functions as F

from cellgrain.operators import blocks, stochastic

BY = ["s"]


def side(spark, seed, n=40):
    key = [F.lit(seed), F.col("id")]
    return spark.range(n).select((F.col("id") % 3).cast("string").alias("s"), F.col("id").alias("pt_id"), (stochastic.uniform(*key, F.lit("x")) * 490).alias("x"), (stochastic.uniform(*key, F.lit("y")) * 1000).alias("y"))


def test_both_ways_count_alike(spark, monkeypatch):
    a, b = side(spark, 1), side(spark, 2)
    run = lambda: sorted(tuple(r) for r in stochastic.csr_null(a, b, BY, 490.0, 1000.0, 60, 100.0, 20.0).collect())
    here = run()
    monkeypatch.setattr(blocks, "FIXED", 0)
    assert here == run() and len(here) == 3 * 60 * 6 and any(r[-1] > 0 for r in here)


def test_every_permutation_comes_once(spark):
    out = stochastic.permutations(side(spark, 1), 120, BY)
    assert out.count() == 40 * 120 == out.select("pt_id", "perm_id").distinct().count() and out.agg(F.max("perm_id")).first()[0] == 119


def test_drawn_points_are_not_dealt_out(spark, monkeypatch):
    seen, real = [], blocks.together
    monkeypatch.setattr(blocks, "together", lambda *k: seen.append(k[2]) or real(*k))
    stochastic.kde_null(side(spark, 1), side(spark, 2), BY, 490.0, 1000.0, 20, 100.0, 20.0)
    assert not seen
