"""The shared folder of checkpoints."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession) -> None:
    """Make sure that checkpoints have a folder: that of spark.checkpoint.dir, a temporary one in local mode, else an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = context.getConf().get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="spark-cellgrain-", dir="/tmp")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        shared = f"file://{own}"
    context.setCheckpointDir(shared)
