"""Every registered query with SQL, next to DuckDB on the smallest data set."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import TABLES, canonical  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

DATA = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(entry.queries()) and len(ORACLES) >= 100


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


# The table queries run always; GEOSTAT_ALL_QUERIES=1 adds those that search neighbours or fit models, whose
# operators have brute-force tests of their own.
QUICK = [n for n in sorted(ORACLES) if entry.queries()[n].__module__.endswith("tabular")]
NAMES = sorted(ORACLES) if os.environ.get("GEOSTAT_ALL_QUERIES") else QUICK


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(columns, cursor.fetchall())
