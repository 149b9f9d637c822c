import os

import pytest

SF = "/root/testdata/sf0.001"


def compare(frame, oracle):
    assert sorted(frame.columns) == sorted(oracle.columns)
    columns = sorted(frame.columns)
    left, right = (f[columns].astype(str).sort_values(columns).reset_index(drop=True) for f in (frame, oracle))
    assert left.equals(right)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_every_query_equals_its_sql(spark):
    import duckdb

    from scriptloom.plans.queries import ORACLES, QUERIES

    db = duckdb.connect()
    for name in ("documents", "pages", "conversations", "events"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, f in QUERIES.items():
        frame = f(spark, SF).toPandas()
        if name in ORACLES:
            compare(frame, db.execute(ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir(SF):
        assert entry.entry(spark).count() == 5
