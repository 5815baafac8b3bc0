"""Each query with SQL is compared with DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from glyphflow.plans.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(found, names):
    return sorted(([None if v is None else round(v, 6) if isinstance(v, float) else v for v in (r[n] for n in names)] for r in found), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = rows([r.asDict() for r in df.collect()], names)
    if name not in SQL:
        assert got or name == "orphan_attempts"
        return
    cur = duck.execute(SQL[name])
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == names
    assert got == rows([dict(zip(cols, r)) for r in cur.fetchall()], names)


def test_entry_imports_without_corpus_folder(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0
