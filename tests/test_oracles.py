"""Every registered query against its DuckDB SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from gridquarry.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    text = lambda v: "~" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return [columns[k] for k in order], sorted(tuple(text(float(r[k]) if isinstance(r[k], (float, int)) and not isinstance(r[k], bool) else r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    found = catalogue.QUERIES[name](spark, DIR)
    rows = [tuple(r) for r in found.collect()]
    if name in catalogue.ORACLES:
        answer = duck.execute(catalogue.ORACLES[name])
        columns = [d[0] for d in answer.description]
        assert canonical(found.columns, rows) == canonical(columns, answer.fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["x", "y", "lx", "ly", "avg"]
