"""Tables that are grouped or sorted by their ends are dealt to parts in proportion to their rows."""

import pytest
from compare import compare, duck

from weftline import catalog
from weftline.sources import store

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["set_08_merged_edges", "grf_22_correction_write", "lin_13_channel_merge", "grf_20_merged_dependencies", "grf_14_corrections"])
def test_parts_grow_with_rows(spark, monkeypatch, name):
    monkeypatch.setattr(store, "MOST_ROWS", 500)
    assert catalog.QUERIES[name](spark, SF).rdd.getNumPartitions() >= 12  # some 6,000 edges; the session has 4
    compare(spark, duck(SF), catalog.QUERIES[name], catalog.ORACLES[name], SF)


def test_small_tables_are_left_to_the_session(spark):
    df = spark.range(100)
    assert store.dealt(df, 4 * store.MOST_ROWS, "id") is df
    assert store.dealt(df, 4 * store.MOST_ROWS + 1, "id").rdd.getNumPartitions() == 5
