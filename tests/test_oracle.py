"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

import os

import pytest

from waxcrate.plans import queries as _registered  # noqa: F401
from waxcrate.plans.registry import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def text(v) -> str:
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLE[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    expected = sorted(tuple(text(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall())
    assert sorted(tuple(text(r[c]) for c in sorted(columns)) for r in df.collect()) == expected


def test_entries_shuffle_what_their_columns_need(spark, duck):
    """Rows that tie in line and track are equal in the view, so the rest of its order isn't read; and conversions number the entries once."""
    from waxcrate.plans.fixtures import VIEWS, view

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    entries = view(spark, SF, "entries")
    assert "l_extendedprice" not in plan(entries)
    found = sorted(tuple(r[c] for c in ("playlist_ord", "pos", "track_id")) for r in entries.collect())
    assert found == sorted(duck.execute(VIEWS["entries"].replace("@", "")).fetchall())
    assert "l_orderkey" not in plan(QUERIES["converted_collection"](spark, SF))
