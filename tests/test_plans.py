"""Physical plans: what is broadcast, shuffled, read, and kept out of Python."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from freshet.plans import testdata
from freshet.operators import apportion, flow, slices, windows
from freshet.session import TASK_BYTES, tune

SF_DIR = "/root/testdata/sf0.001"
QUERIES = testdata.registered()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@contextmanager
def conf(spark, **settings):
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_python_and_no_nested_loops(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for bad in ("EvalPython", "InPandas", "InArrow", "CartesianProduct", "NestedLoopJoin"):
        assert bad not in text


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_nested_loops_when_nothing_is_small(spark, name):
    """At scale Spark finds no side small: only literal dimensions and the ends of slices are broadcast."""
    with conf(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        text = plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    for part in text.split("BroadcastExchange")[1:]:
        # everything below a broadcast, up to the next sibling, is a literal table, or two rows for each slice
        source = next(line for line in part.splitlines()[1:] if "Scan" in line or "Range (" in line)
        ends = "_slice" in source and "SelectedBucketsCount" in source
        numbers = "Scan ExistingRDD" in source and "_part" in source
        assert ends or numbers or "LocalTableScan" in source or "OneRowRelation" in source


@pytest.mark.parametrize("name", ["curve_lookup_many", "curve_lookup", "curve_lookup_regions", "mean_cost_matrix"])
def test_no_frame_from_a_row_to_the_end(spark, name):
    """Such a frame is read anew for every row: the time goes with the square of a group."""
    text = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding$(), currentrow$()" in text
    assert "currentrow$(), unboundedfollowing$()" not in text


def test_fact_scan_reads_only_what_it_needs(spark):
    text = QUERIES["scenario_window_join"](spark, SF_DIR)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_quantity:double,l_shipdate:timestamp_ntz>" in text


def test_filters_reach_the_scan(spark):
    days = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").select(
        "l_linenumber", F.col("l_linenumber").alias("d"))
    text = windows.tag_windows(days, "d")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(l_linenumber,121)" in text
    assert "LessThanOrEqual(l_linenumber,239)" in text


def test_runs_and_pulse_share_one_shuffle(spark):
    days = spark.range(1000).selectExpr("id % 20 AS s", "CAST(id / 20 AS INT) AS d",
                                        "rand(1) AS gap", "rand(2) > 0.5 AS need")
    kept = flow.keep_groups_with(days, ["s"], F.col("need"))
    runs = flow.consecutive_runs(kept, ["s"], "d", where=F.col("need"), unique=True)
    for out in (flow.required_pulse(runs, ["s"], "d", "gap"),
                flow.with_required_pulse(runs, ["s"], "d", "gap"),
                flow.augmentation_ratio(runs, ["s"], "d", "gap", "gap")):
        assert plan(out).count("Exchange") == 1


@pytest.mark.parametrize("name", ["supply_curve", "nested_supply_curves", "running_totals_nulls"])
def test_curves_take_one_range_exchange(spark, monkeypatch, name):
    """The rows are exchanged by range once; what reads the slices exchanges their ends alone."""
    ranged, cut = [], slices.cut
    monkeypatch.setattr(slices, "cut", lambda df, keys, order, *a, **b: ranged.append(
        df.repartitionByRange(8, *keys, *order)) or cut(df, keys, order, *a, **b))
    text = plan(QUERIES[name](spark, SF_DIR))
    assert len(ranged) == 1 and plan(ranged[0]).count("rangepartitioning") == 1
    assert text.count("rangepartitioning") == 0
    exchanges = [part.split("FileScan")[0] for part in text.split("Exchange hashpartitioning")[1:]]
    assert all("_before" in part or "_in_" in part for part in exchanges) and len(exchanges) <= 1


def test_hot_key_is_split(spark):
    """A key with a third of the parts is joined by several tasks."""
    keys = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000)
    parts = spark.range(300_000).select(keys.alias("k"), F.col("id").alias("part"),
                                        F.rand(1).alias("size"), F.lit(9.0).alias("whole"))
    whole = spark.range(5000).select(F.col("id").alias("k"), F.rand(2).alias("m"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB"}
    with conf(spark, **settings):
        shared = apportion.apportion_to_parts(whole, parts, ["k"], part_size="size",
                                              whole_size="whole", measures={"mp": "m"})
        # the aggregate on the join key is the case that needs the forced split
        out = shared.groupBy("k").agg(F.count("*").alias("n"), F.sum("mp").alias("mp"))
        rows = out.collect()
        assert "skew=true" in plan(out)
    assert sum(r.n for r in rows) == 300_000
    assert max(r.n for r in rows) > 100_000


def test_rollup_does_not_multiply_rows(spark):
    whole = spark.range(100).select((F.col("id") % 10).alias("k"), F.rand(1).alias("m"))
    parts = spark.range(1000).select((F.col("id") % 10).alias("k"), F.rand(2).alias("size"),
                                     F.lit(1.0).alias("whole"))
    text = plan(apportion.rollup_parts(whole, parts, ["k"], part_size="size",
                                       whole_size="whole", measures={"m": "m"}, size_out="area"))
    join = text.index("Join")
    assert text.index("HashAggregate") > join  # parts are reduced below the join


def test_bytes_of_a_task_are_bounded_unless_the_session_says(spark):
    """A join with an aggregate above it holds 20 to 30 times the bytes that were shuffled to a task."""
    fresh = spark.newSession()
    for key in TASK_BYTES:
        fresh.conf.unset(key)
    tune(fresh)
    assert {key: fresh.conf.get(key) for key in TASK_BYTES} == {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m", "spark.sql.files.maxPartitionBytes": "32m"}
    said = spark.newSession()
    for key in TASK_BYTES:
        said.conf.set(key, "100m")
    tune(said)
    assert {said.conf.get(key) for key in TASK_BYTES} == {"100m"}
