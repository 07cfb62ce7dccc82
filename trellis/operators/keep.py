"""Tables between the rounds of an operator: written where the whole cluster can read them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_file(spark: SparkSession, tag: str) -> str:
    """A new path in spark.checkpoint.dir, the folder that the cluster shares; where it is unset on one machine, in one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-trellis-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/trellis/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as written to the shared folder and read again: it survives its executors, and what led to it isn't run again."""
    path = shared_file(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
