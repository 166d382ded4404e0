"""Publishing results: written aside, put in place whole with their provenance, intermediates cleared only then."""

from __future__ import annotations

import datetime
import json
import platform
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

#: File of a result's provenance; readers of the folder pass over names that begin with _.
PROVENANCE = "_provenance.json"


def provenance(spark: SparkSession, config: Mapping[str, object], skip: Iterable[str] = ("spatial_pairs",), **params: object) -> dict:
    """What a result was made with: time, versions, parameters and settings, without private keys; skipped lists leave their length."""
    skip = set(skip)
    kept = {k: v for k, v in config.items() if not k.startswith("_") and k not in skip}
    return {
        "generated_utc": datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds"), "python": platform.python_version(), "spark": spark.version,
        "analysis_params": params, "config_snapshot": kept | {f"{k}_count": len(config.get(k) or []) for k in sorted(skip)},
    }


def _files(spark: SparkSession, path: str):
    """Spark's own access to the file system of `path`, whatever it is."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def publish(rows: DataFrame, path: str, made_with: Mapping[str, object] | None = None, clear: Iterable[str] = (), private: str = "_") -> int:
    """Write `rows` (without columns whose name begins with `private`) as JSON lines to the folder `path`, which is replaced as a whole.

    Rows and provenance go to a folder beside it, which is renamed when all is there, so a write that fails or is killed
    leaves the earlier result; what it began stays in `<path>.staging-...`, and is deleted where the failure is seen.
    Between the two renames of a replacement the earlier result is in `<path>.before-...`.  After that, and only after,
    the files that fit the glob patterns `clear` are deleted; gives their number.
    """
    spark = rows.sparkSession
    fs, Path = _files(spark, path)
    tag = uuid.uuid4().hex
    staging, before = f"{path}.staging-{tag}", f"{path}.before-{tag}"
    try:
        rows.select(*[f"`{c}`" for c in rows.columns if not c.startswith(private)]).write.json(staging)
        if made_with is not None:
            out = fs.create(Path(f"{staging}/{PROVENANCE}"), True)
            out.write(bytearray(json.dumps(made_with, sort_keys=True, default=str).encode()))
            out.close()
    except BaseException:
        fs.delete(Path(staging), True)
        raise
    replaced = fs.exists(Path(path)) and fs.rename(Path(path), Path(before))
    if not fs.rename(Path(staging), Path(path)):
        if replaced:
            fs.rename(Path(before), Path(path))
        raise OSError(f"{staging} could not be renamed to {path}")
    if replaced:
        fs.delete(Path(before), True)
    return clear_files(spark, clear)


def clear_files(spark: SparkSession, patterns: Iterable[str]) -> int:
    """Delete the files and folders that fit glob patterns, such as `out/*_detections.csv`; gives their number."""
    gone = 0
    for pattern in patterns:
        fs, Path = _files(spark, pattern)
        for found in fs.globStatus(Path(pattern)) or []:
            gone += bool(fs.delete(found.getPath(), True))
    return gone


def read_provenance(spark: SparkSession, path: str) -> dict | None:
    """The provenance of a published folder; None where it has none."""
    fs, Path = _files(spark, path)
    if not fs.exists(Path(f"{path}/{PROVENANCE}")):
        return None
    return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(fs.open(Path(f"{path}/{PROVENANCE}")), "UTF-8"))
