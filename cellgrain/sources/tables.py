"""Readers of cell tables, pair manifests, combined results, run settings and dataset registries."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import base_name, scale_percent, stem


def read_cell_table(spark: SparkSession, path: str, sample: str = "spots", label: str = "ClusterName", x: str = "X:X", y: str = "Y:Y", extra: Iterable[str] = ()) -> DataFrame:
    """points(sample_id, marker, x, y, extra..) of a wide single-cell CSV with a header; rows without coordinates are left out.

    Only the named columns are parsed, whatever the table's width (its header is read once, on the driver).
    """
    names = spark.read.csv(path, header=True).columns
    missing = [c for c in (sample, label, x, y, *extra) if c not in names]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    t = spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in names))
    number = lambda c: F.expr(f"try_cast(`{c}` as double)")
    t = t.select(F.col(f"`{sample}`").alias("sample_id"), F.col(f"`{label}`").alias("marker"), number(x).alias("x"), number(y).alias("y"), *[number(c).alias(c.replace(":", "_")) for c in extra])
    return t.where("x is not null and y is not null and not isnan(x) and not isnan(y)")


def list_files(spark: SparkSession, root: str, patterns: Iterable[str] = ("*",)) -> DataFrame:
    """Files below a folder that fit any of the patterns: path, rel (path below the folder), size.  A file that fits several comes once; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    tail = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), F.lit("^.*" + _quoted(root.rstrip("/").rpartition("/")[2]) + "/"), F.lit(""))
    name = F.lower(base_name(F.col("path")))
    fits = [name.rlike("^" + "".join({"*": ".*", "?": "."}.get(c, _quoted(c)) for c in p.lower()) + "$") for p in patterns]
    held = fits[0]
    for f in fits[1:]:
        held = held | f
    return files.where(held).select("path", tail.alias("rel"), "size")


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_/" else "\\" + c for c in text)


def read_manifest(spark: SparkSession, path: str, root: str, status: str | None = None, least: int = 4) -> DataFrame:
    """Pairs of a manifest whose four files exist below `root` and whose landmark files have as many marks (at least `least`).

    Rows: pair_id, set, status, moving_img, fixed_img, moving_lm, fixed_lm (below root), scale_pc, diagonal_px, n.
    """
    m = spark.read.csv(path, header=True)
    col = lambda c: F.trim(F.col(f"`{c}`"))
    sides = {"moving_img": "Source image", "moving_lm": "Source landmarks", "fixed_img": "Target image", "fixed_lm": "Target landmarks"}
    diagonal = F.expr("try_cast(`Image diagonal [pixels]` as double)")
    p = m.select(F.coalesce(col("status"), F.lit("")).alias("status"), *[col(c).alias(n) for n, c in sides.items()], F.when(diagonal > 0, diagonal).alias("diagonal_px"))
    p = p if status is None else p.where(F.col("status") == status)
    there = list_files(spark, root).select("rel")
    for n in sides:
        p = p.join(there.withColumnRenamed("rel", n), n, "left_semi")
    counts = spark.read.csv(root, header=True, recursiveFileLookup=True, pathGlobFilter="*.csv").select(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    base = root.rstrip("/").rpartition("/")[2]
    counts = counts.select(F.regexp_replace("path", F.lit("^.*" + _quoted(base) + "/"), F.lit("")).alias("rel"), "n")
    p = p.join(counts.select(F.col("rel").alias("moving_lm"), "n"), "moving_lm").join(counts.select(F.col("rel").alias("fixed_lm"), F.col("n").alias("_m")), "fixed_lm").where((F.col("n") == F.col("_m")) & (F.col("n") >= least))
    group = F.substring_index("moving_img", "/", 1)
    names = [stem(base_name(F.col(c))) for c in ("moving_img", "fixed_img")]
    return p.select(F.concat(group, F.lit("|"), "status", F.lit("|"), names[0], F.lit("->"), names[1]).alias("pair_id"), group.alias("set"), "status", "moving_img", "fixed_img", "moving_lm", "fixed_lm", F.coalesce(scale_percent(F.col("moving_img")), F.lit(25.0)).alias("scale_pc"), "diagonal_px", "n")


def read_pair_results(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Combined results of pairs (one JSON array or JSON lines) with the folder they came from, unless they name one."""
    t = spark.read.schema(schema).json(folder, multiLine=True)
    own = F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/[^/]*$", 1)
    return t.withColumn("output_dir", F.coalesce("output_dir", own) if "output_dir" in t.columns else own)


#: Settings that a run takes where it is given none.
DEFAULTS: dict[str, object] = {"dab_threshold": 0.2, "default_pixel_size": 0.5, "magnification": "auto", "mode": "automated", "image_extensions": ["*.tif", "*.tiff", "*.svs", "*.ndpi", "*.png"], "pixel_size_mode": "global", "objective": "10x", "adaptive_threshold": False, "nuclear_adaptive": False, "nuclear_ashman_min": 1.25, "max_radius_um": 100.0, "radius_step_um": 2.0}


def settings(given: Mapping[str, object], required: Iterable[str] = ("input_dir",), defaults: Mapping[str, object] = DEFAULTS) -> dict[str, object]:
    """A run's settings: what is given, else the defaults; the dashboard's folder follows the input's, or the output's.  A required one that is missing or empty is an error; input_dir isn't required in spatial mode."""
    missing = [k for k in required if not given.get(k) and not (k == "input_dir" and given.get("mode") == "spatial")]
    if missing:
        raise ValueError(f"required settings are missing: {', '.join(missing)}")
    out = {**defaults, **{k: v for k, v in given.items() if v is not None}}
    if not out.get("dashboard_dir"):
        out["dashboard_dir"] = f"{out['input_dir']}/output_results" if out.get("input_dir") else out.get("output_dir")
    return out


def settings_rows(spark: SparkSession, run: str, values: Mapping[str, object]) -> DataFrame:
    """Settings as rows (run, key, value as JSON), to be joined and kept with results; keys that begin with _ are left out."""
    import json

    return spark.createDataFrame([(run, k, json.dumps(v, sort_keys=True)) for k, v in sorted(values.items()) if not k.startswith("_")], "run string, key string, value string")


def resolved(datasets: DataFrame, candidates: DataFrame, there: DataFrame) -> DataFrame:
    """Where each dataset is read from: name, path (null where none of its places exists).

    candidates(name, ord, path, probe): places in the order of preference, each taken if its probe is among the paths
    `there`(path).
    """
    held = candidates.join(there.select(F.col("path").alias("probe")).distinct(), "probe", "left_semi").groupBy("name").agg(F.min_by("path", "ord").alias("path"))
    return datasets.select("name").join(held, "name", "left")


def status_counts(datasets: DataFrame) -> DataFrame:
    """How many datasets are in each state (status)."""
    return datasets.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def by_category(registry: DataFrame, category: Column) -> DataFrame:
    """Ids of a registry's entries by category, in order."""
    return registry.groupBy(category.alias("category")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
