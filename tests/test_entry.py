import os

import pytest

import __spark_entry__ as entry


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 64 and all(0 < r["p"] <= 1 for r in rows)
