"""One test per rule in which Spark's default would differ silently."""

import math

import pytest
from pyspark.sql import functions as F

from freshet.functions import dims, keys, semantics as sem, units
from freshet.operators import flow, impact, report, windows


def values(df, *columns):
    rows = [tuple(r) for r in df.select(*columns).collect()]
    return [r[0] for r in rows] if len(columns) == 1 else rows


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(v):
    return F.lit(v).cast("double")


@pytest.mark.parametrize("n, d, want", [(1.0, 0.0, None), (0.0, 0.0, None), (1.0, 4.0, 0.25),
                                        (None, 2.0, None)])
def test_ratio_is_null_over_zero(spark, n, d, want):
    assert one(spark, sem.ratio(lit(n), lit(d))) == want


def test_bad_number_text_is_null(spark):
    df = spark.createDataFrame([("1.5",), ("n/a",), (None,)], "t string")
    assert values(df.select(sem.number("t").alias("v")), "v") == [1.5, None, None]


def test_null_condition_gives_null(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    out = df.select(sem.if_else(F.col("x") > 2, F.lit("YES"), F.lit("NO")).alias("v"))
    assert values(out, "v") == ["NO", "YES", None]


def test_negated_membership_keeps_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert values(df.where(sem.not_in_values("x", ["a"])), "x") == ["b", None]
    listed = spark.createDataFrame([("a",), (None,)], "y string")
    assert set(values(sem.not_in_table(df, listed, {"x": "y"}), "x")) == {"b", None}
    assert values(sem.is_in_table(df, listed, {"x": "y"}), "x") == ["a"]
    assert values(sem.is_in_table(df, listed.union(listed), {"x": "y"}), "x") == ["a"]


def test_null_keys_join(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 10), ("y", 20)], "k string, b int")
    assert values(sem.null_safe_join(a, b, ["k"]), "k", "a", "b") == [(None, 1, 10)]


def test_merge_pairs_equal_rows(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "p")], "k int, s string")
    b = spark.createDataFrame([(1, None), (3, "q")], "k int, s string")
    got = sorted(values(sem.null_safe_merge(a, b), "k", "s"), key=str)
    assert got == [(1, None), (1, None), (2, "p"), (3, "q")]
    got = sorted(values(sem.null_safe_merge(b, a), "k", "s"), key=str)
    assert got == [(1, None), (1, None), (2, "p"), (3, "q")]


def test_nan_becomes_null_and_is_skipped(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (None,)], "x double")
    clean = sem.nan_to_null(df)
    assert values(clean.agg(F.avg("x").alias("v")), "v") == [1.0]
    assert sem.complete_cases(df).count() == 1


def test_infinite_is_not_finite(spark):
    df = spark.createDataFrame([(1.0,), (math.inf,), (-math.inf,), (math.nan,), (None,)],
                               "x double")
    assert values(df.where(sem.finite("x")), "x") == [1.0]


def test_sum_of_nothing_is_zero(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0), ("b", None)], "k string, x double")
    out = df.groupBy("k").agg(sem.sum_or_zero("x").alias("v")).orderBy("k")
    assert values(out, "v") == [0.0, 2.0]


def test_pair_max_is_null_with_null(spark):
    assert one(spark, sem.pair_max(lit(1.0), lit(None))) is None
    assert one(spark, sem.pair_max(lit(1.0), lit(2.0))) == 2.0


@pytest.mark.parametrize("x, want", [(0.5, 0.0), (1.5, 2.0), (2.5, 2.0), (-0.5, 0.0)])
def test_rounding_is_half_to_even(spark, x, want):
    assert one(spark, sem.half_even(lit(x))) == want


def test_exact_sum(spark):
    df = spark.range(1000).select((F.lit(0.1) * 1).alias("x"))
    assert df.agg(sem.exact_sum("x", 1).alias("v")).first().v == 100.0


@pytest.mark.parametrize("text, value, flag", [
    ("1,200", 1200.0, "Open"), ("1,200 (Closure)", 1200.0, "Closure"), ("n/a", None, "Open"),
    ("350", 350.0, "Open"), ("1,234,567", 1234567.0, "Open"), (None, None, "Open")])
def test_rule_text(spark, text, value, flag):
    df = spark.createDataFrame([(text,)], "MIFR_rules string")
    row = flow.parse_rules(df).first()
    assert (row.MIFR_rules, row.Condition) == (value, flag)


def test_keys(spark):
    c = lambda v: F.lit(v).cast("string")
    assert one(spark, keys.five_decimals(lit(46.1))) == "46.10000"
    assert one(spark, keys.five_decimals(lit(None))) is None
    assert one(spark, keys.grid_site_from_cell(c("46.15625_-118.40625"))
               ) == "46.15625N118.40625W"
    assert one(spark, keys.slashed_date(c("1998-03-07"))) == "3/7/1998"
    assert one(spark, keys.slashed_date(c("3/7/1998"))) == "3/7/1998"
    assert one(spark, keys.slashed_date(c(None))) is None
    assert one(spark, keys.day_of_season(c("1998205"))) == 205
    assert one(spark, keys.year_of_dated_label(c("1998-07-24(205)"))) == 1998
    assert one(spark, keys.repaired_station_id(c("3.20E+51"))) == "32E050"
    assert one(spark, keys.repaired_station_id(c("12447200"))) == "12447200"
    assert one(spark, keys.merge_regions(c("Naches"))) == "Yakima"
    assert one(spark, keys.composite_key(c("a"), c(None), F.lit(3))) == "a_NA_3"


def test_units_case(spark):
    assert one(spark, units.cfs_to_acre_feet(lit(2.5))) == pytest.approx(74.38, abs=0.005)
    assert one(spark, units.cfs_to_acre_feet(lit(1.39))) == pytest.approx(41.36, abs=0.005)


def test_dimensions(spark):
    assert dims.scenario_days(spark).count() == 119
    assert dims.selling_units(spark).count() == 19
    assert dims.crop_groups(spark).where("crop_kind = 'Annual_crop'").count() == 11
    assert dims.crop_groups(spark).where("crop_kind = 'Hay_crop'").count() == 8
    codes = {r.station: r.station_code for r in dims.stations(spark).collect()}
    assert codes["TR_Dayton"] == "NFTDA" and codes["Oroville"] is None


def test_window_edges(spark):
    days = spark.createDataFrame(
        [(d,) for d in (120, 121, 135, 136, 150, 151, 164, 165, 239, 240)], "d int")
    got = dict(values(windows.tag_windows(days, "d"), "d", "simulation"))
    assert got == {121: "Scenario01", 135: "Scenario01", 136: "Scenario02", 150: "Scenario02",
                   151: "Scenario03", 164: "Scenario03", 165: "Scenario04", 239: "Scenario08"}


def test_overlapping_windows_repeat_rows(spark):
    table = spark.createDataFrame([("a", 1, 5), ("b", 4, 8)],
                                  "simulation string, start_date int, stop_date int")
    days = spark.createDataFrame([(d,) for d in (1, 4, 5, 8, 9)], "d int")
    got = sorted(values(windows.tag_windows(days, "d", table), "d", "simulation"))
    assert got == [(1, "a"), (4, "a"), (4, "b"), (5, "a"), (5, "b"), (8, "b")]


@pytest.mark.parametrize("harvest, demand", [(150, 7.0), (151, 0.0), (156, 0.0), (157, 7.0),
                                             (None, None)])
def test_harvest_rule(spark, harvest, demand):
    daily = spark.createDataFrame([("s", 152, 3.0, harvest), ("s", 160, 4.0, harvest)],
                                  "site string, d int, mm double, h int")
    out = windows.window_demand(daily, ["site"], day="d", measure="mm", harvest="h").first()
    assert (out.simulation, out.target_harvest_date) == ("Scenario03", 156)
    assert out.irrigation_demand_mm == demand


@pytest.mark.parametrize("v, closed, open_", [
    (0.0, "[0, 25]", "0"), (25.0, "[0, 25]", "0 – 25"), (25.1, "(25, 50]", "25 – 50"),
    (50.0, "(25, 50]", "25 – 50"), (99.9, "(75, 100)", "75 – 100"), (100.0, "100", "100"),
    (-1.0, "0", "0"), (101.0, "0", "0"), (None, None, None)])
def test_bins(spark, v, closed, open_):
    assert one(spark, report.bin_percent(lit(v))) == closed
    assert one(spark, report.bin_percent(lit(v), closed=False)) == open_


def test_shares(spark):
    df = spark.createDataFrame([("a", "x", 30.0), ("a", "y", 30.0), ("a", "z", 40.0),
                                ("b", "x", 1.0), ("b", "y", 1.0), ("b", "z", 1.0)],
                               "s string, g string, Acres double")
    out = report.share_of_total(df, ["s"], "Acres").orderBy("s", "g")
    assert values(out, "Percentage") == [30.0, 30.0, 40.0, 33.3, 33.3, 33.3]


def test_sold_units_of_unlisted_crop_are_zero(spark):
    df = spark.createDataFrame([("Corn_grain", 254.0), ("Onion", 1000.0), ("Timothy", 2000.0),
                                ("Kelp", 5.0), ("Oats", None)], "crop string, kg double")
    got = dict(values(impact.sold_units(df, "kg", "u"), "crop", "u"))
    assert got["Corn_grain"] == pytest.approx(10.0)
    assert (got["Onion"], got["Timothy"], got["Kelp"], got["Oats"]) == (19.0, 2.0, 0.0, None)
