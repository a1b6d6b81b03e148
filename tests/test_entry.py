import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 10


def test_oracles_are_of_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["V1_L1_cosine_knn", "F1_point_filter", "J8_changes", "A2_index_totals"])
def test_some_queries_run(spark, name):
    assert entry.queries()[name](spark, SF).columns
