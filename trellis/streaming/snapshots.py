"""Pages as they come, compared with each source's last: only those that changed go on.

What is kept of a source is its newest page's hash and moment, in the stream's state, which Spark checkpoints; bodies never enter it, nor
the shuffle to it. A source that isn't fetched for long is forgotten, and its next page counts as the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trellis.deploy import ship

_OUT = "source string, at_ long, body_hash string, previous_hash string, change string"


def changed_pages(pages: DataFrame, expires_days: float = 90) -> DataFrame:
    """pages, a stream: source, fetched_at, body. source, fetched_at, body_hash, previous_hash, change (first or changed): a row for each page
    that differs from its source's last, by fetched_at; one that was fetched before the last is late and tells nothing. The body is where
    pages are stored, by its hash.

    Pages without a source or a moment are left out; a null body is an empty one. What lies ``expires_days`` behind the newest page of all
    is over: such pages tell nothing, and sources without a later one are forgotten."""
    ship(pages.sparkSession)

    def compare(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, digest = state.get if state.exists else (None, None)
        # a batch's pages of one source, without their bodies
        seen, out = sorted({(int(a), d) for p in parts for a, d in zip(p["at_"], p["body_hash"], strict=True)}), []
        for a, d in seen:
            if at is not None and a < at:
                continue
            if d != digest:
                out.append((key[0], a, d, digest, "changed" if digest else "first"))
            at, digest = a, d
        state.update((at, digest))
        state.setTimeoutTimestamp(max(at // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["source", "at_", "body_hash", "previous_hash", "change"])

    known = pages.where("source is not null and fetched_at is not null")
    known = known.withColumn("moment", F.col("fetched_at").cast("timestamp")).withWatermark("moment", f"{int(expires_days * 86_400)} seconds")
    known = known.select("source", "moment", F.unix_micros("moment").alias("at_"), F.sha2(F.coalesce("body", F.lit("")), 256).alias("body_hash"))
    told = known.groupBy("source").applyInPandasWithState(compare, _OUT, "at_ long, body_hash string", "append", GroupStateTimeout.EventTimeTimeout)
    return told.select("source", F.timestamp_micros("at_").alias("fetched_at"), "body_hash", "previous_hash", "change")
