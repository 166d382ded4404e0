"""Image and batch counts kept up to date while cell files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.calls import dab_positive


def arriving_cells(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    """Parquet cell files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_counts(cells: DataFrame, signal: str, threshold: float) -> DataFrame:
    """total and positive of each image so far; state is one row for each image."""
    return cells.groupBy("image").agg(F.count(F.lit(1)).alias("total"), F.count_if(dab_positive(F.col(signal), threshold)).alias("positive"))


def windowed_counts(events: DataFrame, time: str, late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Events of each type in time windows; state older than the watermark is dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count(F.lit(1)).alias("n"))
