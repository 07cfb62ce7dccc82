"""Every registered query of the directory's operators against its SQL."""

from __future__ import annotations

import pytest

from tests import compare
from trellis.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con():
    return compare.connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, compare.DATA)
    if name in ORACLE_SQL:
        assert compare.differences(df, ORACLE_SQL[name], con) == ""
    else:
        assert df.count() > 0


def test_confidence_of_odd_lines(spark, tmp_path):
    """Lines without a flag don't count, and means that are no number stay so, as in the SQL."""
    lines = [(k, flag, c) for k, cs in enumerate([[0.05, 0.02], [None], [None, 0.03], [float("nan"), 0.1], [float("inf")], [1e300], [-0.001]]) for c in cs for flag in ("A", "R", "N", None)]
    lines += [(None, "A", 0.01), (90, None, 0.07), (91, "R", 0.07)]
    spark.createDataFrame(lines, "l_orderkey long, l_returnflag string, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = QUERIES["a29_overall_confidence"](spark, str(tmp_path))
    assert compare.differences(found, ORACLE_SQL["a29_overall_confidence"], compare.connect(str(tmp_path))) == ""
