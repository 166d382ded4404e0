"""Writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_detections(cells: DataFrame, path: str) -> None:
    """Tab-separated table with a header."""
    flat = cells.select(*[c for c, t in cells.dtypes if not t.startswith(("array", "map", "struct"))])
    flat.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_cells_json(cells: DataFrame, path: str) -> None:
    """One GeoJSON feature for each line, partitioned by image: all parts and holes of a cell (or its ring, where it has no parts; or its point)."""
    ring = F.transform("ring", lambda p: F.array(p["x"], p["y"]))
    shaped = cells if "parts" in cells.columns else cells.withColumn("parts", F.lit(None).cast("array<array<array<array<double>>>>"))
    parts = F.coalesce("parts", F.when(F.size("ring") >= 3, F.array(F.array(ring))))
    text = lambda kind, c: F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), F.to_json(c), F.lit("}"))
    geometry = F.when(F.size("parts") == 1, text("Polygon", F.get("parts", F.lit(0)))).when(F.col("parts").isNotNull(), text("MultiPolygon", F.col("parts"))).when(F.size("ring") > 0, text("Point", F.get(ring, F.lit(0)))).otherwise("null")
    kept = [F.col("object_type").alias("objectType")] if "object_type" in cells.columns else []
    properties = F.to_json(F.struct(*kept, F.struct(F.col("class").alias("name")).alias("classification"), F.col("meas").alias("measurements")))
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), properties, F.lit("}"))
    shaped.withColumn("parts", parts).select("image", feature.alias("value")).write.mode("overwrite").partitionBy("image").text(path)


def write_results(rows: DataFrame, path: str, private: str = "_") -> None:
    """JSON lines without columns whose name starts with `private`."""
    rows.select(*[c for c in rows.columns if not c.startswith(private)]).write.mode("overwrite").json(path)
