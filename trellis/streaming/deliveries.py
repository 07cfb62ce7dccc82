"""Batches delivered once: staged, finished by a manifest, and reconciled after a failure.

A batch's rows are first written to a folder of their own, which nobody reads. Then a manifest names that folder; it is written
under another name and renamed, which succeeds for one attempt only. A table is what the manifests name, so that a batch which was staged twice, or whose
stream died between the two steps, counts once. Folders that no manifest names are removed by reconcile().
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trellis.operators import manifests


@dataclass(frozen=True)
class Deliveries:
    """A table in a folder that the cluster shares. key: a row is new if no delivered row has it."""

    spark: SparkSession
    path: str
    key: tuple[str, ...]
    schema: str

    def manifests(self) -> list[dict]:
        """Of each finished batch: batch, folder, inserted, ignored. As many as batches, a line each."""
        if not any(n.endswith(".json") for n in manifests.names(self.spark, f"{self.path}/manifests")):
            return []
        rows = self.spark.read.schema("batch long, folder string, inserted long, ignored long").json(f"{self.path}/manifests/*.json")
        return sorted((r.asDict() for r in rows.collect()), key=lambda m: m["batch"])

    def rows(self) -> DataFrame:
        """What was delivered, with its batch."""
        folders = [f"{self.path}/staged/{m['folder']}" for m in self.manifests() if m["inserted"]]
        schema = f"{self.schema}, batch long"
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def stage(self, batch: DataFrame, number: int) -> dict:
        """Writes the batch's new rows where nobody reads them yet; of rows that repeat a key the first by all columns counts."""
        columns = [c.split()[0] for c in self.schema.split(",")]
        once = batch.select(*columns).withColumn("n_", F.row_number().over(W.partitionBy(*self.key).orderBy(*columns))).where("n_ = 1").drop("n_")
        delivered = self.rows().select(*self.key).distinct()
        same = [once[k].eqNullSafe(delivered[k]) for k in self.key]
        folder = f"{number}-{uuid.uuid4().hex}"
        once.join(delivered, same, "left_anti").withColumn("batch", F.lit(number).cast("long")).write.parquet(f"{self.path}/staged/{folder}")
        inserted = self.spark.read.parquet(f"{self.path}/staged/{folder}").count()
        return {"batch": number, "folder": folder, "inserted": inserted, "ignored": batch.count() - inserted}

    def finish(self, staged: dict) -> bool:
        """Makes a staged batch part of the table; False if another attempt has done that."""
        return manifests.put_once(self.spark, f"{self.path}/manifests/{staged['batch']:012d}.json", staged)

    def reconcile(self) -> int:
        """Removes what was staged and never finished; how many folders there were. Only while no stream delivers."""
        kept = {m["folder"] for m in self.manifests()}
        gone = [n for n in manifests.names(self.spark, f"{self.path}/staged") if n not in kept]
        for n in gone:
            manifests.remove(self.spark, f"{self.path}/staged/{n}")
        return len(gone)

    def deliver(self, batch: DataFrame, number: int, between: Callable[[dict], None] = lambda staged: None) -> None:
        """For foreachBatch(): a batch whose manifest is there was delivered, and isn't again. ``between`` is called between the steps."""
        if any(m["batch"] == number for m in self.manifests()):
            return
        batch.persist()  # read for its rows and for its count
        try:
            staged = self.stage(batch, number)
        finally:
            batch.unpersist()
        between(staged)
        self.finish(staged)

    def start(self, stream: DataFrame, checkpoint: str, between: Callable[[dict], None] = lambda staged: None):
        """Delivers a stream until its source is used up; a restart goes on with the batch that wasn't finished."""
        run = lambda batch, number: self.deliver(batch, number, between)
        return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
