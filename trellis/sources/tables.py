"""JSON seed files, two-file listings, and stores of page snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions.text import safe_url
from trellis.operators.nest import by_digest_prefix, latest_snapshots


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_seed(spark: SparkSession, path: str, items: str) -> DataFrame:
    """The objects in the array ``items`` of a JSON file."""
    return spark.read.json(path, multiLine=True).select(F.explode(items).alias("i")).select("i.*")


def listings(camps: DataFrame, providers: DataFrame, limit: int | None = None) -> DataFrame:
    """camps: name, programProviderId, corporateProviderId; providers: id, name, url. name, provider, url of each
    provider's first camp by name; providers without a web address are left out.

    The program's provider counts before the corporate one. limit: as many as the caller asks for, by name."""
    keyed = camps.withColumn("pid_", F.coalesce("programProviderId", "corporateProviderId"))
    by = providers.select(F.col("id").alias("pid_"), F.col("name").alias("provider"), safe_url("url").alias("url")).where("url is not null")
    found = keyed.join(by, "pid_").groupBy("pid_", "provider", "url").agg(F.min("name").alias("name")).select("name", "provider", "url")
    return found.orderBy("name", "provider", "url").limit(limit) if limit is not None else found


def put_snapshots(pages: DataFrame, path: str) -> None:
    """Append pages (source, fetched_at, body) that the store doesn't have, by hash, in folders by the hash's first letters."""
    spark = pages.sparkSession
    rows = pages.withColumn("body_hash", F.sha2("body", 256)).withColumn("shelf", F.concat(F.lit("h-"), F.substring("body_hash", 1, 2)))  # never a number
    new = rows.dropDuplicates(["source", "body_hash"])
    try:
        known = spark.read.parquet(path).select("source", "body_hash")
    except Exception as e:  # noqa: BLE001  the store doesn't exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        new = new.join(known, ["source", "body_hash"], "left_anti")
    new.write.mode("append").partitionBy("shelf").parquet(path)


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All snapshots, each source's numbered from the newest."""
    return latest_snapshots(spark.read.parquet(path), "source", "fetched_at", "body_hash")


def snapshot(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """The snapshot with this hash, or the only one whose hash begins so. Only one folder is read if the prefix has two letters."""
    rows = spark.read.parquet(path)
    rows = rows.where(F.col("shelf") == f"h-{prefix[:2]}") if len(prefix) >= 2 else rows
    return by_digest_prefix(rows, "body_hash", prefix)


def unchanged(pages: DataFrame, known: DataFrame) -> DataFrame:
    """pages with unchanged: the body is that of the source's newest snapshot, so there is nothing to do."""
    newest = known.where("rank = 1").select("source", F.col("body_hash").alias("h_"))
    return pages.join(newest, "source", "left").withColumn("unchanged", F.coalesce(F.sha2("body", 256) == F.col("h_"), F.lit(False))).drop("h_")
