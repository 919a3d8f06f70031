"""The folder for derived files that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new place below the folder of spark.checkpoint.dir; where none is set, below a temporary one if all runs in one process, else an error."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        told = f"file://{tempfile.mkdtemp(prefix='tacgrid-')}"
        spark.sparkContext.setCheckpointDir(told)
    return f"{told.rstrip('/')}/{name}-{uuid.uuid4().hex}"
