"""Each registered query: its columns, and its SQL where it has one."""

from __future__ import annotations

import pytest

from tests import compare
from trellis.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con():
    return compare.connect()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, con, name):
    assert compare.differences(QUERIES[name](spark, compare.DATA), ORACLE_SQL[name], con) == ""


def test_one_query_for_each_operator():
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted(f"op{i}" for i in range(1, 14))
