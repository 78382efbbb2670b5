from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from palimpsest.plans import catalog
from tools_compare import compare


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_queries_without_a_twin_run(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twins_agree(spark, sf, name):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    assert compare(spark, con, sf, name).startswith("ok")
