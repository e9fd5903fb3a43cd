"""Writing a table between the rounds of an iteration."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder that the cluster names in spark.checkpoint.dir; its lineage ends there.

    A machine-local folder is taken only where the whole of Spark runs on this machine and no folder is named.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder for what is written between jobs."""
    sc = spark.sparkContext
    if not (sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="marlspark-"))
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
