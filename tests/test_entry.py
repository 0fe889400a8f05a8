"""The driver contract: every query runs on the smallest tables and agrees with its SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lucidra.plans import registry


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_agrees_with_sql(spark, data, name):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    found = con.execute(registry.oracles()[name])
    names = [c[0] for c in found.description]
    want = [dict(zip(names, r)) for r in found.fetchall()]
    got = [r.asDict() for r in registry.queries()[name](spark, data).collect()]
    canon = lambda rows: sorted(repr(sorted((k, round(float(v), 7) if isinstance(v, float) or type(v).__name__ == "Decimal" else v) for k, v in r.items())) for r in rows)
    assert canon(got) == canon(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_other_queries_run(spark, data, name):
    registry.queries()[name](spark, data).collect()
