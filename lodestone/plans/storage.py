"""Where intermediate relations are cut from their lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; one of our own only where none is named."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestone-"))
    return context.getCheckpointDir()


def materialised(df: DataFrame) -> DataFrame:
    """df as written to the shared folder: later plans read it and survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
