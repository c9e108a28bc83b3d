"""Tables between the rounds of an iterative operator, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only where that setting is absent and the master is local (tests) a temporary folder is set; on a cluster its absence raises."""
    path = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="mosaiq-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def checkpointed(rows: DataFrame) -> DataFrame:
    """Rows read back from the shared folder: a lost executor costs its tasks, never the rounds before."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()
