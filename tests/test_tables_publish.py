"""Wide tables, manifests, settings, registries, publishing, stains and membrane cutoffs."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellgrain.functions import stains
from cellgrain.operators import membrane
from cellgrain.sources import publish, tables


def test_cell_table_reads_named_columns(spark, tmp_path):
    head = "id,spots,ClusterName,X:X,Y:Y,CD8 - cytotoxic:Cyc_3,PD1:Cyc_12\n"
    (tmp_path / "t.csv").write_text(head + "1,s1,T cell,1.5,2,7,8\n2,s1,tumour,bad,2,1,1\n3,s2,,4,5,x,2\n")
    t = tables.read_cell_table(spark, str(tmp_path / "t.csv"), extra=["PD1:Cyc_12"])
    assert [tuple(r) for r in t.orderBy("sample_id").collect()] == [("s1", "T cell", 1.5, 2.0, 8.0), ("s2", None, 4.0, 5.0, 2.0)]
    read = t._jdf.queryExecution().executedPlan().toString().split("ReadSchema:")[1]
    assert "CD8" not in read and "id:" not in read and "spots" in read
    with pytest.raises(ValueError, match="lacks the columns nope"):
        tables.read_cell_table(spark, str(tmp_path / "t.csv"), label="nope")


def test_manifest(spark, tmp_path):
    root = tmp_path / "data set"
    for name, n in (("a", 5), ("b", 5), ("c", 4), ("d", 3), ("e", 3)):
        (root / "COAD_01/scale-10pc").mkdir(parents=True, exist_ok=True)
        (root / f"COAD_01/scale-10pc/{name}.csv").write_text(",X,Y\n" + "".join(f"{i},{i},{i}\n" for i in range(n)))
        (root / f"COAD_01/scale-10pc/{name}.jpg").write_bytes(b"x")
    at = "COAD_01/scale-10pc/"
    pair = lambda s, t, status, d: f"{at}{s}.jpg,{at}{s}.csv, {at}{t}.jpg,{at}{t}.csv,{status},{d}\n"
    (tmp_path / "m.csv").write_text("Source image,Source landmarks,Target image,Target landmarks,status,Image diagonal [pixels]\n" + pair("a", "b", "training", 100.5) + pair("a", "c", "training", 1) + pair("d", "e", "training", 1) + pair("a", "zz", "training", 1) + pair("b", "a", "evaluation", "?"))
    got = tables.read_manifest(spark, str(tmp_path / "m.csv"), str(root)).orderBy("status").collect()
    assert [(r["pair_id"], r["set"], r["n"], r["diagonal_px"], r["scale_pc"]) for r in got] == [("COAD_01|evaluation|b->a", "COAD_01", 5, None, 10.0), ("COAD_01|training|a->b", "COAD_01", 5, 100.5, 10.0)]
    assert tables.read_manifest(spark, str(tmp_path / "m.csv"), str(root), "training").count() == 1
    assert {r["rel"] for r in tables.list_files(spark, str(root), ["*.JPG", "a.*"]).collect()} == {f"{at}{n}.jpg" for n in "abcde"} | {f"{at}a.csv"}


def test_results_settings_and_registry(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"pair": "a__b", "p": 0.1}, {"pair": "c__d", "p": 0.2, "output_dir": "there"}]))
    rows = {r["pair"]: r for r in tables.read_pair_results(spark, str(tmp_path / "r.json"), "pair string, p double, output_dir string").collect()}
    assert rows["a__b"]["output_dir"].endswith(tmp_path.name) and rows["c__d"]["output_dir"] == "there"
    s = tables.settings({"input_dir": "in", "dab_threshold": 0.3, "objective": None})
    assert (s["dab_threshold"], s["objective"], s["dashboard_dir"], s["mode"]) == (0.3, "10x", "in/output_results", "automated")
    assert tables.settings({"mode": "spatial", "output_dir": "out"})["dashboard_dir"] == "out"
    with pytest.raises(ValueError, match="input_dir"):
        tables.settings({"input_dir": ""})
    kept = {r["key"]: json.loads(r["value"]) for r in tables.settings_rows(spark, "run", s | {"_secret": 1}).collect()}
    assert kept["dab_threshold"] == 0.3 and "_secret" not in kept
    names = spark.createDataFrame([("x",), ("y",), ("z",)], "name string")
    places = spark.createDataFrame([("x", 0, "root/x", "root/x/key"), ("x", 1, "old/x", "old/x"), ("y", 0, "root/y", "root/y"), ("z", 2, "late/z", "late/z"), ("z", 1, "old/z", "old/z")], "name string, ord int, path string, probe string")
    there = spark.createDataFrame([("old/x",), ("late/z",), ("old/z",), ("old/z",)], "path string")
    assert {r["name"]: r["path"] for r in tables.resolved(names, places, there).collect()} == {"x": "old/x", "y": None, "z": "old/z"}
    assert {tuple(r) for r in tables.status_counts(spark.createDataFrame([("ok",), ("ok",), ("missing",)], "status string")).collect()} == {("ok", 2), ("missing", 1)}
    reg = spark.createDataFrame([(2, "a"), (1, "a"), (3, None)], "id int, c string")
    assert {(r["category"], tuple(r["ids"])) for r in tables.by_category(reg, F.col("c")).collect()} == {("a", (1, 2)), (None, (3,))}


def test_publish_replaces_whole_or_not_at_all(spark, tmp_path):
    path, rows = str(tmp_path / "out"), spark.range(3).withColumn("_private", F.lit(1))
    made = publish.provenance(spark, {"mode": "spatial", "_x": 1, "spatial_pairs": [1, 2]}, n_perm=1000)
    for name in ("a_detections.csv", "b_detections.csv", "c_summary.json"):
        (tmp_path / name).write_text("x")
    assert publish.publish(rows, path, made, clear=[f"{tmp_path}/*_detections.csv", f"{tmp_path}/none*"]) == 2
    assert (tmp_path / "c_summary.json").exists() and spark.read.json(path).columns == ["id"] and spark.read.json(path).count() == 3
    back = publish.read_provenance(spark, path)
    assert back["config_snapshot"] == {"mode": "spatial", "spatial_pairs_count": 2} and back["analysis_params"] == {"n_perm": 1000} and back["spark"] == spark.version
    (tmp_path / "d_detections.csv").write_text("x")
    bad = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        publish.publish(bad, path, clear=[f"{tmp_path}/*_detections.csv"])
    assert spark.read.json(path).count() == 3 and (tmp_path / "d_detections.csv").exists()
    assert publish.publish(spark.range(5), path) == 0 and spark.read.json(path).count() == 5 and publish.read_provenance(spark, path) is None
    assert sorted(p.name for p in tmp_path.iterdir() if p.name.startswith("out")) == ["out"]


def test_unmixing_and_choice(spark):
    vectors, white = ((0.65, 0.70, 0.29), (0.27, 0.57, 0.78), (0.71, 0.42, 0.56)), (250.0, 245.0, 240.0)
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (50, 3)).astype(float)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(rgb)] + [(99, None, 1.0, 1.0)], "i int, r double, g double, b double")
    cols = stains.unmixed((F.col("r"), F.col("g"), F.col("b")), vectors, white)
    got = {r["i"]: (r["h"], r["d"], r["o"]) for r in df.select("i", *[c.alias(n) for c, n in zip(cols, "hdo", strict=True)]).collect()}
    m = np.array([np.array(v) / np.linalg.norm(v) for v in vectors])
    expected = -np.log10((rgb + 1) / white) @ np.linalg.inv(m)
    assert all(got[i] == pytest.approx(tuple(expected[i])) for i in range(50)) and got[99] == (None, None, None)
    px = [("s", "good", 0.3, v, v) for v in (0.1, 0.2, 0.4)] + [("s", "perfect but invalid", -0.3, v, v) for v in (0.1, 0.2, 0.4)] + [("s", "poor", 0.3, 0.4 - v, v) for v in (0.1, 0.2, 0.4)] + [("t", "a", 0.0, v, w) for v, w in ((0.1, 0.2), (0.2, 0.1), (0.3, 0.3))] + [("t", "b", 0.0, v, v) for v in (0.1, 0.2)]
    pixels = spark.createDataFrame(px, "image string, candidate string, hema double, dab double, reference double")
    assert {r["image"]: r["candidate"] for r in stains.stain_choice(pixels, ["image"]).collect()} == {"s": "good", "t": "b"}


def test_membrane_cutoffs_by_hand(spark):
    rng = np.random.default_rng(2)
    cells = [("m", f"i{k % 3}", k, int(k % 2), rng.normal(0.35 if k % 2 else 0.15, 0.12, rng.integers(20, 40)), rng.normal(0.1, 0.05, 40)) for k in range(24)]
    rows = [(m, im, k, lab, float(d), None if j % 7 == 0 else float(h[j])) for m, im, k, lab, dab, h in cells for j, d in enumerate(dab)]
    rows += [("few", "i", k, k % 2, 0.1 * k, None) for k in range(6)] + [("m", "i9", 99, 1, None, 0.1), ("m", "i9", 98, None, 0.3, 0.1)]
    px = spark.createDataFrame(rows, "marker string, image string, cell_idx int, label int, dab double, hema double")
    got = {r["marker"]: r for r in membrane.fit_membrane(px, ["marker"]).collect()}
    ok = [[j % 7 == 0 or d > h[j] for j, d in enumerate(dab)] for *_, dab, h in cells]
    y = np.array([c[3] == 1 for c in cells])
    frac = lambda t: np.array([np.mean([o and d > t for o, d in zip(own, c[4], strict=True)]) for own, c in zip(ok, cells, strict=True)])

    def cut(f, t):
        best, at = -1.0, 0.0
        for v in np.unique(f):
            p = f > v
            f1 = 2 * (p & t).sum() / max(p.sum() + t.sum(), 1)
            if f1 > best:
                best, at = f1, v
        return at, best

    pool = lambda out=None: np.percentile(np.concatenate([c[4] for c in cells if c[3] == 0 and c[2] != out]), 99)
    auc = lambda f: np.mean([(p > n) + (p == n) / 2 for p in f[y] for n in f[~y]])
    held, called = [], []
    for i, c in enumerate(cells):
        t, rest = pool(c[2]), np.arange(len(cells)) != i
        held.append(frac(t)[i])
        called.append(held[-1] > cut(frac(t)[rest], y[rest])[0])
    hits = sum(a and b for a, b in zip(called, y, strict=True))
    m = got["m"]
    assert (m["n_pos"], m["n_neg"], m["n_images"]) == (12, 12, 3) and m["pix_thr"] == pytest.approx(pool())
    assert (m["frac_min"], m["f1"]) == pytest.approx(cut(frac(pool()), y)) and m["auc"] == pytest.approx(auc(frac(pool())))
    assert m["loo_auc"] == pytest.approx(auc(np.array(held))) and m["loo_f1"] == pytest.approx(2 * hits / (sum(called) + y.sum())) and m["callable"] == (m["loo_auc"] >= 0.75)
    assert got["few"]["n_pos"] == 3 and got["few"]["pix_thr"] is None and got["few"]["callable"] is False and not math.isnan(m["f1"])
