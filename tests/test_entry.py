"""The driver's contract: names, a query that runs, and two engines that agree."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["folder_link_status", "tags", "canonical_reasons", "structure_profiles"])
def test_agrees_with_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = entry.queries()[name](spark, SF)
    want = db.execute(entry.oracle_sql()[name]).fetch_df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(repr, want[columns].itertuples(index=False, name=None)))
