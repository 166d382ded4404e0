"""Whole tables and sizes of the findings of round four, on small fixtures."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrain.operators import matching, regions
from cellgrain.plans import pair_queries
from cellgrain.sources import adapters
from conftest import DATA


def test_local_affine_takes_every_point(spark):
    days = adapters.landmarks(spark, DATA).select(F.col("pair_id").alias("sample_id")).distinct()
    expected = {r["pt_id"] for r in adapters.points(spark, DATA).join(days, "sample_id").select("pt_id").collect()}
    got = [r["pt_id"] for r in pair_queries.catalogue.queries["local_affine"](spark, DATA).select("pt_id").collect()]
    assert len(got) == len(expected) and set(got) == expected


def test_calibrations_of_one_name_meet_requests_once(spark):
    """20,000 calibrations of a name and as many requests for it: 4e8 rows if each met each."""
    saved = spark.range(20_000).select(F.lit("n").alias("name"), F.lit("m").alias("marker"), F.col("id").alias("ord"), (F.col("id") % 777).cast("double").alias("value"))
    named = spark.range(20_000).select(F.col("id").alias("req_id"), F.when(F.col("id") > 0, "n").alias("name"), F.lit("m").alias("marker"))
    began = time.time()
    got = matching.calibration_lookup(named, saved).groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("req_id").alias("least")).collect()
    assert {(r["value"], r["n"], r["least"]) for r in got} == {(776.0, 19_999, 1), (19_999 % 777.0, 1, 0)}
    assert time.time() - began < 20


def test_seeds_where_points_are_crowded(spark, monkeypatch):
    """3,000 points against 3,000 in 100 x 100, five turns: pairs in reach of a shift are no rows."""
    monkeypatch.setattr(regions, "range_join", None)
    ref = np.random.default_rng(8).uniform(0, 100, (3000, 2))
    frame = lambda xy: spark.createDataFrame([("g", i, *map(float, p)) for i, p in enumerate(xy)], "g string, pt_id long, x double, y double")
    got = regions.grid_seed(frame(ref), frame(ref - [20, -10]), ["g"], (50.0, 50.0), 0.01, 40.0, 10.0).first()
    assert (got["degrees"], got["dx"], got["dy"], got["hits"]) == (0.0, 20.0, -10.0, 3000)


@pytest.mark.parametrize(("seeds", "votes"), [(3, 0), (20_000, 0), (20_000, 10_000)])
def test_seeds_against_every_pair(spark, monkeypatch, seeds, votes):
    monkeypatch.setattr(regions, "SEEDS", seeds)
    monkeypatch.setattr(regions, "VOTES", votes)
    rng = np.random.default_rng(9)
    ref, mov = rng.integers(0, 60, (40, 2)), rng.integers(0, 60, (30, 2))
    ids = [*range(25), 3, 3, 4, 5, 6]  # some ids lie in several places
    hits = {}
    for k, deg in enumerate((-3, 0)):
        c, s = np.cos(np.radians(deg)), np.sin(np.radians(deg))
        x, y = mov[:, 0] - 30, mov[:, 1] - 30
        at = np.stack([c * x - s * y + 30, s * x + c * y + 30], axis=1)
        for i in range(5):
            for j in range(5):
                d = ref[None] - at[:, None] - np.array([i * 10 - 20, j * 10 - 20])
                hits[k, i, j] = len({ids[m] for m in np.flatnonzero(((d**2).sum(axis=2) <= 25).any(axis=1))})
    k, i, j = min(hits, key=lambda t: (-hits[t], t))
    frame = lambda xy, ids: spark.createDataFrame([("g", n, *map(float, p)) for n, p in zip(ids, xy, strict=True)], "g string, pt_id long, x double, y double")
    got = regions.grid_seed(frame(ref, range(40)), frame(mov, ids), ["g"], (30.0, 30.0), 5.0, 20.0, 10.0, degrees=(-3, 0)).first()
    assert (got["degrees"], got["dx"], got["dy"], got["hits"]) == ((-3.0, 0.0)[k], i * 10.0 - 20, j * 10.0 - 20, hits[k, i, j])
