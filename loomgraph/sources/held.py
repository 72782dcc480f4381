"""Rows written to the shared folder, so that what follows reads them instead of making them again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_folder(spark: SparkSession) -> None:
    """Use the folder that spark.checkpoint.dir names; where it is unset, a temporary one on a local master only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        found = context.getConf().get("spark.checkpoint.dir")
        if not found and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="loomgraph-"))


def held(df: DataFrame) -> DataFrame:
    ensure_folder(df.sparkSession)
    return df.checkpoint()
