"""Readers of the files that segmentation and registration tools leave: GeoJSON cells, detection tables, summaries, landmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import shoelace_centroid, vertex_mean
from ..functions.names import IMAGE_SUFFIXES, base_name, stem

_FEATURES = "struct<features: array<struct<geometry: string, properties: struct<objectType: string, classification: string, measurements: map<string, double>>>>>"
_RING = "array<array<double>>"


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """Image files of a folder, not of its subfolders: path, name, size, in name order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "length")
    name = base_name(F.col("path"))
    suffix = F.concat(F.lit("."), F.element_at(F.split(F.lower(name), "[.]"), -1))
    return files.withColumn("name", name).where(suffix.isin(IMAGE_SUFFIXES)).select("path", "name", F.col("length").alias("size")).orderBy("name")


def class_name(raw: Column) -> Column:
    """A classification that is an object with a name, or a plain string."""
    return F.coalesce(F.get_json_object(raw, "$.name"), F.when(~raw.startswith("{"), F.regexp_replace(raw, '^"|"$', "")))


def _outer_ring(geometry: Column) -> Column:
    """Outer ring of a Polygon, that of the first part of a MultiPolygon, the one vertex of a Point."""
    kind = F.get_json_object(geometry, "$.type")
    one = lambda path, schema: F.from_json(F.get_json_object(geometry, path), schema)
    ring = F.when(kind == "Polygon", one("$.coordinates[0]", _RING)).when(kind == "MultiPolygon", one("$.coordinates[0][0]", _RING)).when(kind == "Point", F.array(one("$.coordinates", "array<double>")))
    return F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def _parts(geometry: Column) -> Column:
    """All rings of a Polygon or MultiPolygon: parts, each an outer ring and its holes, of [x, y]; null for other shapes."""
    kind = F.get_json_object(geometry, "$.type")
    one = lambda schema: F.from_json(F.get_json_object(geometry, "$.coordinates"), schema)
    return F.when(kind == "Polygon", F.array(one(f"array<{_RING}>"))).when(kind == "MultiPolygon", one(f"array<array<{_RING}>>"))


def read_cells(spark: SparkSession, path: str, centroid: str = "area") -> DataFrame:
    """cells(image, cell_idx, object_type, class, ring, parts, x, y, meas) of GeoJSON files; a cell's place in its file is its key.

    `ring` is the outer ring of the first part, `parts` has every part with its holes.

    `centroid` is "area" (shoelace) or "vertices" (mean of the outer ring).
    """
    raw = spark.read.option("wholetext", "true").text(path).select(F.from_json("value", _FEATURES).alias("g"), F.col("_metadata.file_path").alias("path"))
    one = raw.select("path", F.posexplode("g.features").alias("cell_idx", "f"))
    out = one.select(stem(base_name(F.col("path"))).alias("image"), "cell_idx", F.lower(F.coalesce("f.properties.objectType", F.lit("detection"))).alias("object_type"), class_name(F.col("f.properties.classification")).alias("class"), _outer_ring(F.col("f.geometry")).alias("ring"), _parts(F.col("f.geometry")).alias("parts"), F.col("f.properties.measurements").alias("meas"))
    x, y = (shoelace_centroid if centroid == "area" else vertex_mean)(F.col("ring"))
    return out.withColumn("x", x).withColumn("y", y)


def read_detections(spark: SparkSession, path: str, px_um: float) -> DataFrame:
    """Tab-separated detections with centroids in micrometres: name, class, x and y in pixels; rows without numbers are left out."""
    t = spark.read.csv(path, sep="\t", header=True, mode="PERMISSIVE")
    x, y = (F.expr(f"try_cast(`Centroid {c} µm` as double)") / px_um for c in "XY")
    image = F.col("Image") if "Image" in t.columns else stem(base_name(F.col("_metadata.file_path")))
    return t.select(image.alias("image"), F.col("Classification").alias("class"), x.alias("x"), y.alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")


def read_summaries(spark: SparkSession, path: str, whitelist: DataFrame | None = None) -> DataFrame:
    """One row for each image summary, missing fields at their defaults; a whitelist(image) keeps its images only."""
    schema = "image string, pixel_size_um double, image_width int, image_height int, total_cells long, positive_cells long, negative_cells long, positivity_pct double, dab_threshold double"
    t = spark.read.schema(schema).json(path, multiLine=True)
    out = t.select("image", F.coalesce("pixel_size_um", F.lit(0.5)).alias("px_um"), F.col("image_width").alias("width"), F.col("image_height").alias("height"), *[F.coalesce(c, F.lit(0)).alias(n) for c, n in (("total_cells", "total"), ("positive_cells", "positive"), ("negative_cells", "negative"))], F.coalesce("positivity_pct", F.lit(0.0)).alias("pct"), F.col("dab_threshold").alias("threshold"))
    return out if whitelist is None else out.join(whitelist.select("image"), "image", "left_semi")


def read_landmarks(spark: SparkSession, path: str, factor: float = 1.0) -> DataFrame:
    """Landmark CSVs (unnamed index, X, Y): stem, lm_id, x, y, rescaled."""
    t = spark.read.csv(path, header=True)
    index = t.columns[0]
    return t.select(stem(base_name(F.col("_metadata.file_path"))).alias("stem"), F.col(index).cast("int").alias("lm_id"), (F.col("X").cast("double") * factor).alias("x"), (F.col("Y").cast("double") * factor).alias("y"))
