"""Readers, writers and the streaming counts."""

import json

from pyspark.sql import functions as F

from cellgrain.sources import readers, writers
from cellgrain.streaming import incremental


def test_cells_of_all_shapes(spark, tmp_path):
    square = [[0, 0], [4, 0], [4, 2], [0, 2], [0, 0]]
    features = [
        {"geometry": {"type": "Polygon", "coordinates": [square]}, "properties": {"objectType": "detection", "classification": {"name": "Positive"}, "measurements": {"DAB": 0.3}}},
        {"geometry": {"type": "MultiPolygon", "coordinates": [[square], [square]]}, "properties": {"classification": "Negative"}},
        {"geometry": {"type": "Point", "coordinates": [7, 8]}, "properties": {}},
    ]
    (tmp_path / "img1.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = readers.read_cells(spark, str(tmp_path)).orderBy("cell_idx").collect()
    assert [(r["image"], r["class"], r["x"], r["y"]) for r in rows] == [("img1", "Positive", 2.0, 1.0), ("img1", "Negative", 2.0, 1.0), ("img1", None, 7.0, 8.0)]
    assert rows[0]["meas"] == {"DAB": 0.3} and rows[1]["object_type"] == "detection"
    writers.write_cells_json(readers.read_cells(spark, str(tmp_path)), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 3


def test_holes_and_parts_survive(spark, tmp_path):
    outer, hole, other = [[0, 0], [9, 0], [9, 9], [0, 9], [0, 0]], [[2, 2], [4, 2], [4, 4], [2, 2]], [[20, 0], [25, 0], [25, 5], [20, 0]]
    features = [{"geometry": {"type": "Polygon", "coordinates": [outer, hole]}, "properties": {"classification": "Positive", "measurements": {"a": 1.5}}}, {"geometry": {"type": "MultiPolygon", "coordinates": [[outer, hole], [other]]}, "properties": {}}, {"geometry": {"type": "Point", "coordinates": [7, 8]}, "properties": {}}, {"geometry": None, "properties": {}}]
    (tmp_path / "im.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    writers.write_cells_json(readers.read_cells(spark, str(tmp_path / "im.geojson")), str(tmp_path / "out"))
    back = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted((f["geometry"]["type"], f["geometry"]["coordinates"]) for f in back if f["geometry"]) == [("MultiPolygon", [[outer, hole], [other]]), ("Point", [7.0, 8.0]), ("Polygon", [outer, hole])]
    assert {"name": "Positive"} in [f["properties"].get("classification") for f in back] and sum(f["geometry"] is None for f in back) == 1
    readers.read_cells(spark, str(tmp_path / "im.geojson")).select("image", "class", "ring", "meas").write.parquet(str(tmp_path / "bare"))
    writers.write_cells_json(spark.read.parquet(str(tmp_path / "bare")), str(tmp_path / "out2"))
    assert spark.read.text(str(tmp_path / "out2")).count() == 4


def test_detections_and_landmarks(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("Image\tClassification\tCentroid X µm\tCentroid Y µm\na\tPositive\t10\t20\na\tNegative\tbad\t1\n")
    assert [tuple(r) for r in readers.read_detections(spark, str(tmp_path / "d.tsv"), 0.5).collect()] == [("a", "Positive", 20.0, 40.0)]
    (tmp_path / "lm.csv").write_text(",X,Y\n0,1,2\n1,3,4\n")
    assert [tuple(r) for r in readers.read_landmarks(spark, str(tmp_path / "lm.csv"), 2.0).orderBy("lm_id").collect()] == [("lm", 0, 2.0, 4.0), ("lm", 1, 6.0, 8.0)]


def test_summaries(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"image": "a", "total_cells": 5}))
    row = readers.read_summaries(spark, str(tmp_path / "s.json")).first()
    assert (row["total"], row["positive"], row["px_um"]) == (5, 0, 0.5)
    none = spark.createDataFrame([("b",)], "image string")
    assert readers.read_summaries(spark, str(tmp_path / "s.json"), none).count() == 0


def test_images_are_listed_by_suffix(spark, tmp_path):
    for name in ("b.TIF", "a.png", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [r["name"] for r in readers.list_images(spark, str(tmp_path)).collect()] == ["a.png", "b.TIF"]


def test_results_leave_private_columns_out(spark, tmp_path):
    writers.write_results(spark.range(2).withColumn("_x", F.lit(1)), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).columns == ["id"]
    writers.write_detections(spark.range(2).withColumn("a", F.array(F.lit(1))), str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).columns == ["id"]


def test_counts_follow_arriving_files(spark, tmp_path):
    cells = spark.createDataFrame([("a", 0.3), ("a", 0.1), ("b", float("nan"))], "image string, dab double")
    cells.write.parquet(str(tmp_path / "in"))
    stream = incremental.running_counts(incremental.arriving_cells(spark, str(tmp_path / "in"), cells.schema, 1), "dab", 0.2)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("counts").collect()} == {("a", 2, 1), ("b", 1, 0)}
