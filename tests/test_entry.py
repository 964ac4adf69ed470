import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no driver tables here")
def test_flagship(spark):
    assert entry.entry(spark).columns == ["uuid", "series_id", "score", "series_size"]
