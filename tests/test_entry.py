"""The driver contract."""

from pathlib import Path

import pytest

import __spark_entry__ as entry


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no tables")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 100 and {"d", "stability", "state", "dd"} <= set(df.columns)
