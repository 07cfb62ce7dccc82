"""Roll-ups kept up to date: only the subjects that have new events are derived again.

Events and roll-up are dealt over buckets by a hash of the subject. A batch of events is added to the log, a folder for each batch and
bucket; the subjects it touches are derived from their whole log, which lies in as many buckets as they do, and merged into those buckets of
the roll-up, written anew. A manifest for each batch says which version of each bucket counts, so that a reader never sees half
a batch, and one that is added again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.operators import manifests


@dataclass(frozen=True)
class RollUp:
    """derive: of subjects (one column, key) and their events a row for each subject, with the columns of ``schema``, which begin with key. due: a
    column that says from when on a row is no longer right by itself, or none."""

    spark: SparkSession
    path: str
    key: str
    schema: str
    derive: Callable[[DataFrame, DataFrame], DataFrame]
    due: str | None = None
    buckets: int = 64

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def versions(self) -> dict[int, int]:
        """Bucket -> the batch that wrote it last."""
        done = [n for n in manifests.names(self.spark, f"{self.path}/manifests") if n.endswith(".json")]
        return {int(b): v for b, v in manifests.get(self.spark, f"{self.path}/manifests/{done[-1]}")["buckets"].items()} if done else {}

    def rows(self, of: list[int] | None = None) -> DataFrame:
        """The roll-up, or those buckets of it."""
        folders = [f"{self.path}/rows/{v}/bucket={b}" for b, v in sorted(self.versions().items()) if of is None or b in of]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def add(self, events: DataFrame, batch: int, as_of: str | None = None) -> list[int]:
        """Adds a batch of events; batches have rising numbers. Which buckets were written. With ``as_of`` subjects that are due by then
        are derived again, too. A batch that was added isn't again; one that failed on the way is, from its start.

        The list of buckets, as long as there are buckets at most, is all that comes to the driver."""
        done = [int(n.split(".")[0]) for n in manifests.names(self.spark, f"{self.path}/manifests") if n.endswith(".json")]
        if batch in done:
            return []
        if done and batch < max(done):
            raise ValueError(f"batch {batch} comes after batch {max(done)}")
        events.withColumn("bucket", self._bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/log/batch={batch}")
        log = self.spark.read.option("basePath", f"{self.path}/log").parquet(*[f"{self.path}/log/batch={b}" for b in [*done, batch] if self._has(b)])
        touched = log.where(F.col("batch") == batch).select(self.key) if "batch" in log.columns and self._has(batch) else self.rows().select(self.key).limit(0)
        if self.due and as_of is not None:
            touched = touched.unionByName(self.rows().where(F.col(self.due) <= F.lit(as_of)).select(self.key))
        touched = touched.distinct()
        of = sorted(r[0] for r in touched.select(self._bucket()).distinct().collect())
        # folders of other buckets aren't read
        theirs = log.where(F.col("bucket").isin(of)).join(touched, self.key, "left_semi").drop("batch", "bucket")
        columns = self.rows().columns
        made = self.derive(touched, theirs).select(*columns)
        whole = self.rows(of).join(touched, self.key, "left_anti").select(*columns).unionByName(made)
        whole.withColumn("bucket", self._bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/{batch}")
        kept = self.versions() | dict.fromkeys(of, batch)
        manifests.put_once(self.spark, f"{self.path}/manifests/{batch:012d}.json", {"buckets": kept})
        return of

    def _has(self, batch: int) -> bool:
        return any(n.startswith("bucket=") for n in manifests.names(self.spark, f"{self.path}/log/batch={batch}"))
