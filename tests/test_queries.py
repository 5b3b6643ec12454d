import glob
import os

import pytest

from cairn.plans import queries as core

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows):
    return sorted(tuple(str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_agrees_with_sql(spark, sf, db, name):
    df = core.QUERIES[name](spark, sf)
    rows = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    if name in core.ORACLES:
        rel = db.sql(core.ORACLES[name])
        assert sorted(rel.columns) == sorted(df.columns)
        at = [rel.columns.index(c) for c in sorted(df.columns)]
        assert plain(rows) == plain([r[k] for k in at] for r in rel.fetchall())
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
