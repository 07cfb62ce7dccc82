"""Tables that outlive an executor: written to the folder the cluster shares, then read back."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII letters, for lower-casing that leaves other alphabets alone.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset on one machine (tests, a laptop), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-trellis-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def table_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/trellis/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the written table.

    It cuts the lineage as a checkpoint does, and a lost executor takes none of it away."""
    path = table_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_pieces(batches: Iterator, rows: int = 512) -> Iterator:
    """Arrow batches as smaller ones, so that a worker holds the results of so many rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def spread(df: DataFrame, rows: int, *keys: str, each: int = 2_000_000) -> DataFrame:
    """``df``, a small table that will become ``rows`` rows, dealt so that a task makes about ``each`` of them. A small
    file is otherwise one task, however much is made of it."""
    return df.repartition(max(1, -(-rows // each)), *keys)


def let_go(spark: SparkSession) -> None:
    """Have Spark remove the shuffles of what is written by now. They stay on the executors' disks until the driver's
    garbage collector has seen that nobody refers to them, which may take half an hour; so it is asked to
    look, twice, as what it finds first holds on to the rest."""
    for _ in range(2):
        spark._jvm.System.gc()
        time.sleep(0.1)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that materialize() wrote and nothing needs any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
