"""Small files that say which folders of a table count: written whole, once, where the cluster can read them."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, folder: str) -> list[str]:
    """What is in a folder, sorted; nothing where there is none."""
    fs, at = _at(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def put_once(spark: SparkSession, path: str, content: dict) -> bool:
    """Writes a JSON file under another name and renames it; False, and no change, where the file is there."""
    fs, at = _at(spark, path)
    _, temporary = _at(spark, f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}")
    out = fs.create(temporary, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    done = not fs.exists(at) and fs.rename(temporary, at)
    if not done:
        fs.delete(temporary, False)
    return done


def get(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)
