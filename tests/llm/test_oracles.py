"""Numbered queries with SQL, against DuckDB at the smallest scale."""

import os

import pytest
from compare import compare, duck

from weftline.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_as_sql(spark, name):
    compare(spark, duck(SF), queries.QUERIES[name], queries.ORACLES[name], SF)
