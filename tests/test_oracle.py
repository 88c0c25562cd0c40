"""Every registered query against its SQL twin, value by value."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points
from freshet.plans import testdata, testdata_sql

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

QUERIES = testdata.registered()
ORACLE = testdata_sql.statements()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df.reindex(sorted(df.columns), axis=1)
    out = df.apply(lambda s: s.map(lambda v: "<null>" if pd.isna(v) else repr(float(v))
                                   if isinstance(v, (int, float)) else str(v)))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLE) <= set(entry_points.oracle_sql())


def check(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    want = duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) and len(got) > 0
    a, b = canonical(got), canonical(want)
    differing = (a != b).any(axis=1)
    assert not differing.any(), (
        f"{differing.sum()} of {len(a)} rows differ\n{a[differing].head(5)}\n{b[differing].head(5)}")


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, duck, name):
    check(spark, duck, name)


@pytest.mark.parametrize("name", ["supply_curve", "nested_supply_curves", "running_totals_nulls", "box_summary",
                                  "median_by_group"])
def test_matches_sql_for_other_slice_counts(spark, duck, name):
    """The same results for one slice and for many."""
    for slices in ("1", "37"):
        spark.conf.set("spark.sql.shuffle.partitions", slices)
        try:
            check(spark, duck, name)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
