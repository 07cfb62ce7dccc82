"""Queries without SQL handle every row of their table."""

from __future__ import annotations

from tests.compare import DATA
from trellis.queries import QUERIES


def test_every_part_is_matched_or_created(spark):
    found = QUERIES["n11_match_or_create"](spark, DATA)
    parts = spark.read.parquet(f"{DATA}/part.parquet").select("p_partkey")
    assert sorted(r.id for r in found.select("id").collect()) == sorted(r.p_partkey for r in parts.collect())
