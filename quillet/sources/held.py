"""Tables that outlive a job: written to the shared folder and read back."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a local one in local mode (tests), an error on a cluster."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillet-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder in spark.checkpoint.dir."""
    return f"{shared_dir(spark)}/quillet-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def held(df: DataFrame, name: str) -> DataFrame:
    """Written to the folder in spark.checkpoint.dir and read back, so that plans stay short and survive lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
