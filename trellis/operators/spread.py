"""How many tasks the steps of a large job are dealt over, so that what one task holds doesn't grow with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: A task has about so many rows of the largest table.
ROWS = 500_000


def tasks_for(rows: DataFrame) -> int | None:
    """Tasks of about ROWS rows each; None where the session's own number is enough. Rows of a Parquet table are counted without reading them."""
    tasks = -(-rows.count() // ROWS)
    return tasks if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(rows: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``rows`` over so many tasks by their keys, which what groups or joins on these keys keeps; as they are if ``tasks`` is None."""
    return rows.repartition(tasks, *keys) if tasks else rows
