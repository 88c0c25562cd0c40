"""Every query with a third of the facts on one site and a third on one part.

Nothing derived may be broadcast, joins split hot keys at a few kilobytes and
the results must not change.
"""

import duckdb
import pytest
from test_oracle import ORACLE, QUERIES, TABLES, canonical

SOURCE = "/root/testdata/sf0.001"
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
}


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"COPY (SELECT * FROM '{SOURCE}/{name}.parquet') TO '{folder}/{name}.parquet'")
    con.execute(f"""
        COPY (SELECT * REPLACE (CASE WHEN l_orderkey % 3 = 0 THEN 11 ELSE l_partkey END AS l_partkey,
                                CASE WHEN l_orderkey % 3 = 1 THEN 7 ELSE l_suppkey END AS l_suppkey)
              FROM '{SOURCE}/lineitem.parquet') TO '{folder}/lineitem.parquet'""")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), con


@pytest.fixture(autouse=True)
def settings(spark):
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", list(QUERIES))
def test_hot_keys_do_not_change_results(spark, skewed, name):
    folder, con = skewed
    got, want = QUERIES[name](spark, folder).toPandas(), con.execute(ORACLE[name]).df()
    assert len(got) == len(want)
    a, b = canonical(got), canonical(want)
    differing = (a != b).any(axis=1)
    assert not differing.any(), f"{a[differing].head(3)}\n{b[differing].head(3)}"
