"""Tables written to the folder that driver and executors share, where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; where it names none, a temporary one if all
    runs on this machine. On a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spatialis-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/spatialis-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
