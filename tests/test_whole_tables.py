"""Queries that run over whole tables, against brute force on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrain.operators import registration, stochastic
from cellgrain.plans import cell_queries, pair_queries
from cellgrain.sources import adapters
from conftest import DATA

QUERIES = pair_queries.catalogue.queries


def loo_f1(s, y):
    """Every cut tried again without each cell."""
    if len(s) < 4 or not 2 <= y.sum() <= len(y) - 2:
        return None
    called = np.zeros(len(s), int)
    for i in range(len(s)):
        keep = np.arange(len(s)) != i
        cuts = np.unique(s[keep])
        above = s[keep][None, :] > cuts[:, None]
        f1 = 2 * (above & (y[keep] == 1)).sum(axis=1) / np.maximum(above.sum(axis=1) + y[keep].sum(), 1)
        called[i] = s[i] > cuts[f1.argmax()]
    return 2 * int((called & y).sum()) / max(1, int(called.sum() + y.sum()))


def test_calibration_equals_leaving_each_out(spark):
    rng, rows, expected = np.random.default_rng(31), [], {}
    for k in range(40):
        n = int(rng.integers(1, 40))
        s, y = rng.integers(0, [3, 12, 1000][k % 3], n).astype(float), rng.integers(0, 2, n)
        rows += [(f"g{k}", float(a), int(b)) for a, b in zip(s, y, strict=True)]
        expected[f"g{k}"] = n, loo_f1(s, y)
    got = {r["g"]: (r["n"], r["loo_f1"]) for r in stochastic.calibrate_loo(spark.createDataFrame(rows, "g string, s double, y int"), ["g"], "s", "y").collect()}
    assert got == expected


def test_calibration_has_every_language(spark):
    got = {r["sample_id"] for r in cell_queries.calibrate_loo(spark, DATA).collect()}
    assert got == {r["sample_id"] for r in adapters.labelled(spark, DATA).select("sample_id").distinct().collect()} and len(got) > 2


@pytest.fixture
def day(spark, monkeypatch):
    """20 clicks and 18 views of one day."""
    rng = np.random.default_rng(32)
    xy = {"click": rng.uniform(0, 400, (20, 2)), "view": rng.uniform(0, 400, (18, 2))}
    rows = [("d", m, 100 * (m == "view") + i, *map(float, p)) for m, pts in xy.items() for i, p in enumerate(pts)]
    frame = spark.createDataFrame(rows, "sample_id string, marker string, pt_id long, x double, y double")
    monkeypatch.setattr(adapters, "points", lambda *_: frame)


def fitted(m, r):
    p, q = (m @ [1, 1j], r @ [1, 1j])
    z = ((q - q.mean()) * np.conj(p - p.mean())).sum() / (abs(p - p.mean()) ** 2).sum()
    return z, q.mean() - z * p.mean()


def test_all_landmarks_count(spark, day):
    rows = adapters.landmarks(spark, "").orderBy("lm_id").collect()
    m, r = np.array([[x["mx"], x["my"]] for x in rows]), np.array([[x["rx"], x["ry"]] for x in rows])
    z, _ = fitted(m, r)
    fit = QUERIES["similarity_fit"](spark, "").first()
    assert fit["n"] == len(rows) == 18 and math.isclose(fit["a"], z.real, abs_tol=1e-7) and math.isclose(fit["b"], z.imag, abs_tol=1e-7)
    loo = {x["lm_id"]: x["loo_err"] for x in QUERIES["loo_tre_ls"](spark, "").collect()}
    for i, row in enumerate(rows):
        keep = np.arange(len(rows)) != i
        z, t = fitted(m[keep], r[keep])
        assert math.isclose(loo[row["lm_id"]], abs(z * (m[i] @ [1, 1j]) + t - r[i] @ [1, 1j]), abs_tol=2e-5)
    assert QUERIES["certify_landmarks"](spark, "").first()["n"] == QUERIES["rtre_summary"](spark, "").first()["n"] == 18
    assert QUERIES["irls_similarity"](spark, "").count() == 1


def test_two_landmarks_leave_no_fit(spark):
    lm = spark.createDataFrame([("p", k, 1.0 * k, 2.0, 3.0 * k + 1, 0.1) for k in range(2)], "pair_id string, lm_id int, rx double, ry double, mx double, my double")
    assert [r["loo_err"] for r in registration.leave_one_out(lm, ["pair_id"]).collect()] == [None, None]


def test_names_and_counts_come_from_whole_tables(spark, monkeypatch):
    suppliers = spark.range(1, 101).select(F.col("id").alias("s_suppkey"))
    items = spark.createDataFrame([(20 * k, s) for s, n in ((1, 2), (31, 2), (32, 3), (90, 2)) for k in range(n)], "l_partkey long, l_suppkey long")
    monkeypatch.setattr(adapters, "read", lambda *_: suppliers)
    monkeypatch.setattr(pair_queries, "read", lambda *_: items)
    names = {r["name"] for r in QUERIES["normalize_name"](spark, "").collect()}
    sep = "_- "
    a = {f"LL{k % 20}{sep[k % 3]}Liver{sep[k % 3]}{'H&E' if k % 7 == 0 else 'CD8'}{sep[k % 3]}x10.png" for k in range(1, 101)}
    assert {n for n in names if n.endswith("png")} == a
    assert {(r["a"], r["b"]) for r in QUERIES["equal_count_pairs"](spark, "").collect()} == {(x, y) for x in (1, 31, 90) for y in (1, 31, 90) if x != y}
