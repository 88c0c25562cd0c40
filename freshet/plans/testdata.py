"""The operators applied to the shipped test tables.

The tables stand in for the study's inputs:

    region / site / crop     supplier's nation / supplier / part type
    Year, DOY, simulation    ship date, and the pause window it falls into
    supply, output, area     l_quantity, l_extendedprice, number of line items
    baseline, scenarios      return flag N, return flags A and R
    stations (nested)        every site feeds its nation's and its region's station
    daily discharge          quantity shipped per station and day

Every function takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
tables.  Results are rounded so they can be compared with the SQL twins in
``testdata_sql``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import dims, units
from ..functions import fixed_values as fv
from ..functions import keys as k
from ..functions import semantics as sem
from ..operators import apportion, curve, flow, impact, intervals, long_runs, report, windows
from ..operators.running import running_totals, stage
from ..session import shared_dir, tune
from ..sources import readers

BASE, SCENARIOS = "N", ["A", "R"]
STATION_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
#: part types standing in for grain crops, hay crops, and the display groups
GRAIN, HAY = ["MEDIUM", "LARGE", "STANDARD"], ["SMALL", "PROMO"]
GROUPS = {"MEDIUM": "Corn and onion", "LARGE": "Grain crops", "STANDARD": "Grain crops",
          "SMALL": "Hay crops", "PROMO": "Hay crops", "ECONOMY": "Hay crops"}
UNITS = [("MEDIUM", 1 / fv.KG_PER_BUSHEL), ("LARGE", 1 / fv.KG_PER_BUSHEL),
         ("STANDARD", fv.TON_PER_KG), ("SMALL", fv.TON_PER_KG), ("PROMO", fv.CWT_PER_KG)]
#: parts of this brand stand for interruptible rights
INTERRUPTIBLE_BRAND = "Brand#1"
#: share of a window's shipped quantity taken as the augmentation rate
AUG_SHARE = 0.02
SUPPLY_KEYS = ["station", "Year", "simulation"]
HALVES = {w[0]: w[4] for w in fv.SCENARIO_WINDOWS}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- shared inputs --------------------------------------------------------------
def shipments(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("part"),
        F.year("l_shipdate").alias("Year"), F.dayofyear("l_shipdate").alias("DOY"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def sites(spark, sf_dir) -> DataFrame:
    """site, region (nation), basin (region)."""
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return (table(spark, sf_dir, "supplier")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(F.col("s_suppkey").alias("site"), F.col("n_name").alias("region"),
                    F.col("r_name").alias("basin")))


def bridge(spark, sf_dir) -> DataFrame:
    """station, site: each site feeds its nation's and its region's station."""
    return sites(spark, sf_dir).select(
        "site", F.explode(F.array("region", "basin")).alias("station"))


def crops(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part"), F.col("p_type").alias("crop"), "p_brand")


def crop_units(spark) -> DataFrame:
    return dims.literal_table(spark, ["crop", "units_per_kg"], UNITS)


def crop_prices(spark, sf_dir) -> DataFrame:
    """Mean price per crop, written out so that Spark knows it is small.

    The planner would otherwise size it like the part table below it and join it
    by shuffling all rows on a handful of crops.
    """
    return stage(table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("crop")).agg(
        (sem.exact_sum("p_retailprice", 2) / F.count(F.lit(1))).alias("mean_Price")), "prices")


def cropped(spark, sf_dir) -> DataFrame:
    """Shipments with their crop."""
    return shipments(spark, sf_dir).join(crops(spark, sf_dir).drop("p_brand"), "part")


def _mean_price():
    return sem.exact_sum("l_extendedprice", 2) / F.count(F.lit(1))


def seasonal(rows: DataFrame) -> DataFrame:
    """irrig, yield_kgha, Acres by site, crop, Year and return flag."""
    return rows.groupBy("site", "crop", "Year", F.col("l_returnflag").alias("simulation")).agg(
        F.avg("l_quantity").alias("irrig"), _mean_price().alias("yield_kgha"),
        F.count(F.lit(1)).cast("double").alias("Acres"))


IMPACT_KEYS = ["Year", "crop", "site"]


def baseline_of(season: DataFrame) -> DataFrame:
    base = season.where(F.col("simulation") == BASE).select(
        *IMPACT_KEYS, F.col("irrig").alias("irrig_optimal_mm"),
        F.col("yield_kgha").alias("WM_yield_optimal_kgha"), "Acres")
    return base.withColumn("total_WM_yield_optimal_kg",
                           F.col("WM_yield_optimal_kgha") * units.hectares("Acres"))


SIDES = {"supply": "irrig", "base_supply": "irrig_optimal_mm", "output": "yield_kgha",
         "base_output": "WM_yield_optimal_kgha", "base_total": "total_WM_yield_optimal_kg"}


def own_total():
    return F.col("yield_kgha") * units.hectares("Acres")


def compare(scenario: DataFrame, baseline: DataFrame) -> DataFrame:
    """The comparison, on scenario rows that have a baseline."""
    return volumes(impact.impact_vs_baseline(scenario.drop("Acres"), baseline, IMPACT_KEYS,
                                             total=own_total(), **SIDES))


def compare_within(season: DataFrame) -> DataFrame:
    """The same where scenarios and baseline are one table with one row per flag."""
    beside = impact.beside_baseline(
        season, IMPACT_KEYS, F.col("simulation") == BASE,
        {"irrig_optimal_mm": "irrig", "WM_yield_optimal_kgha": "yield_kgha", "_acres": "Acres"})
    beside = beside.where(F.col("simulation").isin(SCENARIOS)).withColumn(
        "Acres", F.col("_acres")).drop("_acres").withColumn(
        "total_WM_yield_optimal_kg",
        F.col("WM_yield_optimal_kgha") * units.hectares("Acres"))
    return volumes(impact.compare_columns(beside, total=own_total(), **SIDES))


def volumes(out: DataFrame) -> DataFrame:
    return out.where(F.col("Acres").isNotNull()).withColumns({
        "total_WM_yield_kg": F.col("yield_kgha") * units.hectares("Acres"),
        "streamflow_aug_acrft": units.mm_to_acre_feet("streamflow_aug_mm", "Acres"),
        "streamflow_aug_cfs": units.cubic_feet_to_cfs(
            units.mm_to_cubic_feet("streamflow_aug_mm", "Acres")),
    })


def valued(spark, sf_dir, compared: DataFrame) -> DataFrame:
    """Both outcomes in sold units and money, and the revenue lost."""
    prices, unit_table = crop_prices(spark, sf_dir), crop_units(spark)
    out = impact.price_outcome(compared, prices, "total_WM_yield_kg", units=unit_table,
                               units_out="sold_unit_shut", value_out="Total_economic_return_shut")
    out = impact.price_outcome(out, prices, "total_WM_yield_optimal_kg", units=unit_table,
                               units_out="sold_unit_opt", value_out="Total_economic_return_opt")
    return out.withColumn("Revenue_loss", F.col("Total_economic_return_opt")
                          - F.col("Total_economic_return_shut"))


def flag_impact(spark, sf_dir) -> DataFrame:
    """Clamped, valued impact of flags A and R against N, from one scan."""
    compared = compare_within(seasonal(cropped(spark, sf_dir)))
    return impact.unit_costs(impact.clamp_impact(valued(spark, sf_dir, compared)))


# --- windows, semantics ----------------------------------------------------------
def scenario_window_join(spark, sf_dir):
    tagged = windows.tag_windows(shipments(spark, sf_dir), "DOY")
    return tagged.groupBy("simulation", "start_date", "Year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"),
        F.min("DOY").alias("first_day"), F.max("DOY").alias("last_day"))


def window_labels(spark, sf_dir):
    """Labels of all days; days in no window keep a NULL label."""
    days = dims.scenario_days(spark).select("DOY", "simulation").join(
        F.broadcast(dims.scenario_labels(spark)), "simulation")
    daily = shipments(spark, sf_dir).groupBy("DOY").agg(F.count(F.lit(1)).alias("n"))
    return (daily.join(F.broadcast(days), "DOY", "left")
            .groupBy("simulation_abb", "simulation_half").agg(F.sum("n").alias("n")))


def ratio_null_on_zero(spark, sf_dir):
    return (shipments(spark, sf_dir).groupBy("l_discount", "l_tax")
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("tax_per_discount", F.round(sem.ratio("l_tax", "l_discount"), 6)))


def _owing(spark, sf_dir):
    return table(spark, sf_dir, "supplier").where(F.col("s_acctbal") < 0)


def negated_membership(spark, sf_dir):
    kept = sem.not_in_table(shipments(spark, sf_dir), _owing(spark, sf_dir), {"site": "s_suppkey"})
    return kept.groupBy("l_returnflag", "Year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


def table_membership(spark, sf_dir):
    kept = sem.is_in_table(shipments(spark, sf_dir), _owing(spark, sf_dir), {"site": "s_suppkey"})
    return kept.groupBy("l_returnflag", "Year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


def complete_cases(spark, sf_dir):
    rows = shipments(spark, sf_dir).select(
        "l_returnflag", "Year", "l_quantity", sem.ratio("l_tax", "l_discount").alias("rate"))
    return (sem.complete_cases(rows).groupBy("l_returnflag", "Year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"),
        F.round(F.sum("rate"), 5).alias("rate")))


def discharge_calendar(spark, sf_dir):
    daily = table(spark, sf_dir, "orders").groupBy("o_orderdate").agg(
        F.sum("o_totalprice").alias("Discharge_cfs"))
    return rounded(k.calendar_columns(daily, "o_orderdate").drop("o_orderdate"), 2,
                   "Discharge_cfs")


# --- comparison -------------------------------------------------------------------
#: irrigation type (line status) -> net share; crop -> wet factor
NET_SHARE = {"O": 0.95, "F": 0.85}
WET_FACTOR = {"MEDIUM": 1.1, "LARGE": 1.2, "STANDARD": 1.15, "SMALL": 1.05, "PROMO": 1.25}


def grid_factors(spark, sf_dir):
    """Season rows by irrigation type: factors joined on, incomplete rows out.

    A (site, crop) with several types repeats its season rows; a crop without a
    wet factor is incomplete.
    """
    rows = cropped(spark, sf_dir)
    # One aggregate serves the season and the grid: it is written once.
    cells = stage(rows.groupBy("site", "crop", "Year", "l_linestatus").agg(
        F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n")), "cells")
    season = cells.groupBy("site", "crop", "Year").agg(
        F.sum("qty").alias("irrig"), F.sum("n").alias("n"))
    shares = dims.literal_table(spark, ["Irrigation", "ML_Fraction"], list(NET_SHARE.items()))
    wet = dims.literal_table(spark, ["crop", "WM_ML_factor"], list(WET_FACTOR.items()))
    grid = cells.groupBy("site", "crop", F.col("l_linestatus").alias("Irrigation")).agg(
        F.sum("n").cast("double").alias("Acres"))
    grid = (grid.join(F.broadcast(shares), "Irrigation", "left")
            .join(F.broadcast(wet), "crop", "left"))
    out = season.join(grid, ["site", "crop"], "left").withColumns({
        "irrig": F.col("irrig") * F.col("ML_Fraction"),
        "wet_rows": F.col("n") * F.col("WM_ML_factor"),
        "area_ha_opt": units.hectares("Acres")})
    return sem.complete_cases(out.where(F.col("irrig") > 0)).select(
        "site", "crop", "Year", "Irrigation", "irrig", "wet_rows", "Acres", "area_ha_opt")


def basin_impact(spark, sf_dir):
    """Comparison keyed without the planting date: every A/R row of a season, by
    line status, meets every N row of that season."""
    season = stage(cropped(spark, sf_dir).groupBy(
        "site", "crop", "Year", F.col("l_returnflag").alias("simulation"),
        F.col("l_linestatus").alias("planting_date")).agg(
        F.avg("l_quantity").alias("irrig"), _mean_price().alias("yield_kgha"),
        F.count(F.lit(1)).cast("double").alias("Acres")), "basin")
    out = compare(season.where(F.col("simulation").isin(SCENARIOS)), baseline_of(season))
    return out.groupBy("crop", "Year", "simulation", "planting_date").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("streamflow_aug_acrft"), 9).alias("volume"),
        F.max("WM_yield_loss").alias("largest_loss"),
        F.min("Percentage_irrig").alias("least_irrig"))


def unify_measure(spark, sf_dir):
    per_part = shipments(spark, sf_dir).groupBy("part").agg(
        F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("price"),
        F.count(F.lit(1)).alias("rows"))
    rows = impact.unify_measure(per_part.join(crops(spark, sf_dir), "part"), "crop",
                                {"grain": (GRAIN, "qty"), "hay": (HAY, "price")},
                                "measure", "kind")
    return rows.groupBy("crop", "kind").agg(
        F.sum("rows").alias("n"), F.round(F.sum("measure"), 2).alias("measure"))


def impact_vs_baseline(spark, sf_dir):
    season = stage(seasonal(cropped(spark, sf_dir)), "season")
    out = compare(season.where(F.col("simulation").isin(SCENARIOS)), baseline_of(season))
    out = out.join(sites(spark, sf_dir).drop("basin"), "site")
    return out.select(
        "region", "site", "crop", "Year", "simulation", "Acres", "streamflow_aug_mm",
        "streamflow_aug_acrft", "streamflow_aug_cfs", "WM_yield_loss", "Percentage_irrig",
        "Per_irrig_saved", "Percentage_yield", "Per_yield_reduction")


def price_outcome(spark, sf_dir):
    out = impact.price_outcome(seasonal(cropped(spark, sf_dir)).withColumn(
        "kg", F.col("yield_kgha") * units.hectares("Acres")), crop_prices(spark, sf_dir), "kg",
        units=crop_units(spark))
    return out.select("site", "crop", "Year", "simulation", "sold_unit", "economic_return")


def impact_clamps(spark, sf_dir):
    out = flag_impact(spark, sf_dir)
    return out.select("site", "crop", "Year", "simulation", "Percentage_yield",
                      "streamflow_aug_acrft", "WM_yield_loss", "Revenue_loss",
                      "Cost_acre_ft", "Cost_acre")


def per_acre_measures(spark, sf_dir):
    out = flag_impact(spark, sf_dir)
    return out.select(
        "site", "crop", "Year", "simulation",
        sem.ratio("WM_yield_loss", "Acres").alias("yield_loss_acre"),
        sem.ratio(F.col("sold_unit_opt") - F.col("sold_unit_shut"), "Acres")
        .alias("Production_loss_acre"),
        sem.ratio("Total_economic_return_shut", "Acres").alias("Economic_return_ac"),
        sem.ratio("Revenue_loss", "Acres").alias("Revenue_loss_acre"),
        sem.ratio("sold_unit_shut", "Acres").alias("Production_acre"))


def daily_supply(rows: DataFrame) -> DataFrame:
    """Daily quantity per site and crop with the group's mean day as harvest day.

    Days are summed first, so the harvest window runs over at most the days of a
    year, and its partitioning serves the window aggregate that follows.
    """
    daily = rows.groupBy("Year", "site", "crop", "DOY").agg(
        F.sum("l_quantity").alias("irrig1"), F.count(F.lit(1)).alias("n"))
    season = Window.partitionBy("Year", "site", "crop")
    mean_day = F.sum(F.col("DOY") * F.col("n")).over(season) / F.sum("n").over(season)
    return daily.withColumn("harvest_date", F.floor(mean_day).cast("int"))


def demand_of(rows: DataFrame) -> DataFrame:
    return windows.window_demand(daily_supply(rows), ["Year", "site", "crop"],
                                 day="DOY", measure="irrig1", harvest="harvest_date")


def window_demand(spark, sf_dir):
    return demand_of(cropped(spark, sf_dir))


def impact_table(spark, sf_dir):
    """Impact per window, its volume taken from the daily window demand.

    Scenario rows are the A and R shipments of a window; the baseline is the N
    season; a window without demand counts as zero volume.  Baseline, scenarios and
    demand come from one written table, so the facts meet their parts once.
    """
    rows = stage(cropped(spark, sf_dir).select(
        "site", "crop", "Year", "DOY", "l_returnflag", "l_quantity", "l_extendedprice"), "cropped")
    base = baseline_of(seasonal(rows))
    scenario = windows.tag_windows(rows.where(F.col("l_returnflag").isin(SCENARIOS)), "DOY")
    scenario = scenario.groupBy("site", "crop", "Year", "simulation").agg(
        F.avg("l_quantity").alias("irrig"), _mean_price().alias("yield_kgha"))
    out = impact.clamp_impact(valued(spark, sf_dir, compare(scenario, base)))
    out = out.join(demand_of(rows), ["Year", "site", "crop", "simulation"], "left")
    out = out.withColumn("irrigation_demand_mm",
                         F.coalesce("irrigation_demand_mm", F.lit(0.0)))
    out = impact.unit_costs(out.withColumns({
        "streamflow_aug_acrft": units.mm_to_acre_feet("irrigation_demand_mm", "Acres"),
        "streamflow_aug_cfs": units.cubic_feet_to_cfs(
            units.mm_to_cubic_feet("irrigation_demand_mm", "Acres"))}))
    return out.select(
        "site", "crop", "Year", "simulation", "Acres", "irrigation_demand_mm",
        "streamflow_aug_acrft", "streamflow_aug_cfs", "Revenue_loss", "Cost_acre_ft",
        "Cost_acre")


# --- apportioning and roll-ups -----------------------------------------------------
def fields(spark, sf_dir) -> DataFrame:
    """Parts of each (site, crop): size, size of the whole, interruptible ones out.

    The parts are written once; sizing the wholes and sharing them both read it.
    """
    # Joined on the part first: that partitioning also serves the aggregate.
    rows = shipments(spark, sf_dir).select("site", "part", "l_quantity")
    parts = stage(rows.join(crops(spark, sf_dir), "part")
                  .groupBy("site", "part", "crop", "p_brand")
                  .agg(F.sum("l_quantity").alias("Acres_PF")), "parts")
    whole = parts.groupBy("site", "crop").agg(F.sum("Acres_PF").alias("whole_size"))
    listed = table(spark, sf_dir, "part").where(F.col("p_brand") == INTERRUPTIBLE_BRAND)
    kept = sem.not_in_table(parts.drop("p_brand"), listed, {"part": "p_partkey"})
    return kept.join(whole, ["site", "crop"])


def apportion_to_parts(spark, sf_dir):
    shared = apportion.apportion_exactly(
        flag_impact(spark, sf_dir), fields(spark, sf_dir), ["site", "crop"], part=["part"],
        part_size="Acres_PF", whole_size="whole_size",
        measures={"volume_fld": ("streamflow_aug_acrft", 6), "loss_fld": ("Revenue_loss", 2)})
    return shared.groupBy("site", "crop", "part").agg(
        F.count(F.lit(1)).alias("n"), F.max("fraction_acres").alias("fraction"),
        sem.exact_sum("volume_fld", 6).alias("volume"), sem.exact_sum("loss_fld", 2).alias("loss"))


def shares_add_up(spark, sf_dir):
    """What all parts of a row get, beside what the row has: equal to the last unit."""
    parts = (shipments(spark, sf_dir).select("site", "part", "l_quantity").join(crops(spark, sf_dir), "part")
             .groupBy("site", "part", "crop").agg(F.sum("l_quantity").alias("Acres_PF")))
    parts = stage(parts, "parts")
    whole = parts.groupBy("site", "crop").agg(F.sum("Acres_PF").alias("whole_size"))
    shared = apportion.apportion_exactly(
        flag_impact(spark, sf_dir), parts.join(whole, ["site", "crop"]), ["site", "crop"], part=["part"],
        part_size="Acres_PF", whole_size="whole_size",
        measures={"volume_fld": ("streamflow_aug_acrft", 6), "loss_fld": ("Revenue_loss", 2)})
    return shared.groupBy("site", "crop", "Year", "simulation", "streamflow_aug_acrft", "Revenue_loss").agg(
        F.count(F.lit(1)).alias("parts"), sem.exact_sum("volume_fld", 6).alias("volume"),
        sem.exact_sum("loss_fld", 2).alias("loss"))


#: digits that volumes, rates, yields and money are shared in
UNIT_DIGITS = {"streamflow_aug_acrft": 6, "streamflow_aug_cfs": 6, "WM_yield_loss": 2, "Revenue_loss": 2}


def grid_impact(spark, sf_dir) -> DataFrame:
    """Impact of the uninterruptible parts, back on (site, crop, Year, flag) rows."""
    return _grid_rows(apportion.rollup_exactly(
        flag_impact(spark, sf_dir), fields(spark, sf_dir), ["site", "crop"],
        part_size="Acres_PF", whole_size="whole_size", size_out="Acres_PF",
        measures={m: (m, d) for m, d in UNIT_DIGITS.items()}))


def _grid_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "site", "crop", "Year", "simulation", "Acres", "Acres_PF", *UNIT_DIGITS,
        sem.ratio("Revenue_loss", "streamflow_aug_acrft").alias("cost_acrft"),
        sem.ratio("Revenue_loss", "Acres").alias("cost_acr"))


def field_to_grid(spark, sf_dir):
    return grid_impact(spark, sf_dir)


def field_to_grid_unequal(spark, sf_dir):
    """Parts that share wholes of their own: the quantity of their line status in the cell."""
    rows = cropped(spark, sf_dir)
    parts = rows.groupBy("site", "crop", "l_linestatus", "part").agg(F.sum("l_quantity").alias("Acres_PF"))
    whole = parts.groupBy("site", "crop", "l_linestatus").agg(F.sum("Acres_PF").alias("whole_size"))
    listed = table(spark, sf_dir, "part").where(F.col("p_brand") == INTERRUPTIBLE_BRAND)
    kept = sem.not_in_table(parts, listed, {"part": "p_partkey"})
    return _grid_rows(apportion.rollup_exactly(
        flag_impact(spark, sf_dir), kept.join(whole, ["site", "crop", "l_linestatus"]), ["site", "crop"],
        part_size="Acres_PF", whole_size="whole_size", size_out="Acres_PF", apart=["l_linestatus"],
        measures={m: (m, d) for m, d in UNIT_DIGITS.items()}))


def field_rights(spark, sf_dir):
    """Fields joined to their grid row and their right, incomplete ones and interruptible rights out.

    A field is a part of a site and line status; its right is named by its least tax, and has no
    name where that is zero.
    """
    rows = cropped(spark, sf_dir)
    key = ["site", "crop", "l_linestatus"]
    grids = rows.groupBy(*key).agg(F.count(F.lit(1)).cast("double").alias("Acres")).where("Acres > 4")
    owned = rows.groupBy(*key, "part")
    parts = owned.agg(F.sum("l_quantity").alias("Acres_PF")).join(grids, key, "left")
    number = F.round(F.min("l_tax") * 100).cast("int")
    rights = owned.agg(F.when(number > 0, F.concat(F.lit("WR"), number.cast("string"))).alias("WRDocID"))
    listed = table(spark, sf_dir, "region").select(
        F.concat(F.lit("WR"), F.col("r_regionkey").cast("string")).alias("WR_Doc_ID"))
    fields = sem.complete_cases(parts.join(rights, [*key, "part"]))
    fields = fields.withColumn("fraction_acres", sem.ratio("Acres_PF", "Acres"))
    return sem.not_in_table(fields, listed, {"WRDocID": "WR_Doc_ID"})


def daily_demand(spark, sf_dir):
    """Days joined to the baseline's harvest date, once per line status it was planted under."""
    rows = cropped(spark, sf_dir)
    base = rows.where(F.col("l_returnflag") == BASE).groupBy(
        "Year", "site", "crop", F.col("l_linestatus").alias("Irrigation")).agg(
        F.floor(F.avg("DOY")).cast("int").alias("harvest_date"))
    daily = rows.groupBy("Year", "site", "crop", "DOY").agg(F.sum("l_quantity").alias("irrig1"))
    return windows.window_demand(daily.join(base, ["Year", "site", "crop"]), ["Year", "site", "crop", "Irrigation"],
                                 day="DOY", measure="irrig1", harvest="harvest_date")


SITE_DIGITS = {"Streamflow_aug_vol_acft": 6, "streamflow_aug_cfs": 6, "T_Revenue_loss": 2}


def site_totals(spark, sf_dir) -> DataFrame:
    return apportion.rollup_grid(
        grid_impact(spark, sf_dir), ["site", "Year", "simulation"],
        {"T_Acres": "Acres", "Streamflow_aug_vol_acft": "streamflow_aug_acrft",
         "streamflow_aug_cfs": "streamflow_aug_cfs", "T_Revenue_loss": "Revenue_loss"},
        {"cost_per_acft_v": ("T_Revenue_loss", "Streamflow_aug_vol_acft")}, digits=SITE_DIGITS)


def grid_rollup(spark, sf_dir):
    return site_totals(spark, sf_dir).join(sites(spark, sf_dir).drop("basin"), "site")


def gauge_rollup(spark, sf_dir):
    return apportion.rollup_stations(
        site_totals(spark, sf_dir), bridge(spark, sf_dir), ["Year", "simulation"],
        {"Streamflow_aug_vol_acft": "Streamflow_aug_vol_acft",
         "streamflow_aug_cfs": "streamflow_aug_cfs"}, digits=SITE_DIGITS)


# --- supply curves -------------------------------------------------------------------
#: tells the lines apart; order and number alone do not
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def running_totals_nulls(spark, sf_dir):
    """Running and group totals of a value that is missing where there is no discount."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_linestatus", F.month("l_shipdate").alias("Month"), *LINE,
        F.when(F.col("l_discount") > 0.05, F.col("l_quantity")).alias("qty"))
    out = running_totals(rows, ["l_linestatus", "Month"], LINE, {"run": "qty"}, totals={"total": "run"})
    return out.select("l_linestatus", "Month", *LINE, "run", "total")


def curve_points(spark, sf_dir) -> DataFrame:
    """Volume, loss and area per site, Year and window: summed before any join."""
    tagged = windows.tag_windows(shipments(spark, sf_dir), "DOY")
    return tagged.groupBy("site", "Year", "simulation").agg(
        F.sum("l_quantity").alias("streamflow_aug_acrft"),
        sem.exact_sum(F.col("l_extendedprice") * F.col("l_discount"), 4).alias("Revenue_loss"),
        F.count(F.lit(1)).cast("double").alias("Acres")
    ).withColumn("cost_acrft", sem.ratio("Revenue_loss", "streamflow_aug_acrft"))


def region_curve(spark, sf_dir) -> DataFrame:
    points = curve_points(spark, sf_dir).join(sites(spark, sf_dir).drop("basin"), "site")
    return curve.supply_curve(points, ["region", "Year", "simulation"], cost="cost_acrft",
                              volume="streamflow_aug_acrft", tie=["site"])


def station_curve(spark, sf_dir, **kept) -> DataFrame:
    """Curves of the nested stations; ``kept`` picks whole curves by their keys,
    which is done before they are built."""
    points = curve_points(spark, sf_dir).join(bridge(spark, sf_dir), "site")
    points = curve.curve_slice(points, **kept)
    return curve.supply_curve(points, SUPPLY_KEYS, cost="cost_acrft",
                              volume="streamflow_aug_acrft", tie=["site"], size="Acres")


def supply_curve(spark, sf_dir):
    return region_curve(spark, sf_dir).select(
        "region", "Year", "simulation", "site", "Acres", "streamflow_aug_acrft", "cost_acrft",
        "cum_streamflow")


def nested_supply_curves(spark, sf_dir):
    return station_curve(spark, sf_dir).select(
        *SUPPLY_KEYS, "site", "cost_acrft", "cum_streamflow", "cum_size")


def curve_slice(spark, sf_dir):
    out = station_curve(spark, sf_dir, Year=1998, simulation=fv.EXAMPLE_SCENARIOS,
                        station=["ASIA", "NATION_7"])
    return out.select(*SUPPLY_KEYS, "site", "cost_acrft", "cum_streamflow")


def barter_price(spark, sf_dir):
    out = curve.barter_price(region_curve(spark, sf_dir), ["region", "Year", "simulation"],
                             price=fv.BARTER_PRICE_PER_ACFT, target=fv.BARTER_TARGET_ACFT,
                             cutoff=fv.BARTER_CUTOFF_ACFT)
    return rounded(out, 6, "price_per_acre")


# --- flow and rules ---------------------------------------------------------------------
def nation_days(spark, sf_dir) -> DataFrame:
    """Daily quantity per nation.

    A site ships at most a few items a day, so summing per site and day first
    would shuffle the fact table for nothing; nation and day collapse map-side.
    """
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("site"), "l_shipdate", "l_quantity")
    return (rows.join(sites(spark, sf_dir), "site")
            .groupBy("region", "basin", "l_shipdate").agg(F.sum("l_quantity").alias("q")))


def region_days(spark, sf_dir) -> DataFrame:
    """Daily quantity per (region station, Year, Month, DOY)."""
    daily = nation_days(spark, sf_dir).groupBy("basin", "l_shipdate").agg(
        F.sum("q").alias("Discharge_cfs"))
    return k.calendar_columns(daily, "l_shipdate").withColumnRenamed("basin", "station")


def station_days(spark, sf_dir) -> DataFrame:
    """Daily quantity of every nested station, from one scan."""
    nested = nation_days(spark, sf_dir).select(
        F.explode(F.array("region", "basin")).alias("station"), "l_shipdate", "q")
    daily = nested.groupBy("station", "l_shipdate").agg(F.sum("q").alias("Discharge_cfs"))
    return k.calendar_columns(daily, "l_shipdate").drop("l_shipdate")


def wide_rules(spark, sf_dir) -> DataFrame:
    """Month x region: mean daily quantity as rule text, closed in July and August."""
    monthly = region_days(spark, sf_dir).groupBy("Month").pivot("station", STATION_REGIONS).agg(
        F.avg("Discharge_cfs"))

    def text(c):
        whole = F.round(F.col(c) * 100).cast("long")
        number = F.concat(F.floor(whole / 1000).cast("string"), F.lit(","),
                          F.lpad((whole % 1000).cast("string"), 3, "0"))
        return F.when(F.col("Month").isin(7, 8), F.concat(number, F.lit(" (Closure)"))
                      ).otherwise(number).alias(c)
    return monthly.select("Month", *[text(c) for c in STATION_REGIONS])


def calendar(spark) -> DataFrame:
    """Month and DOY of a common year."""
    return spark.range(1, 366).select(F.col("id").cast("int").alias("DOY")).withColumn(
        "Month", F.month(F.date_add(F.lit("2001-01-01").cast("date"), F.col("DOY") - 1)))


def rules_unpivot(spark, sf_dir):
    return flow.unpivot_rules(wide_rules(spark, sf_dir), ["Month"])


def rule_text_parse(spark, sf_dir):
    return flow.parse_rules(rules_unpivot(spark, sf_dir))


def rules_to_days(spark, sf_dir):
    names = table(spark, sf_dir, "region").select(
        F.col("r_name").alias("MIFR_NAME"), F.col("r_regionkey").alias("SITENO"))
    out = flow.threshold_rules([wide_rules(spark, sf_dir)], ["Month"], calendar(spark), names)
    return out.select("MIFR_SITE_NAME", "SITENO", "Month", "DOY", "MIFR_rules", "Condition")


def verdicts(spark, sf_dir) -> DataFrame:
    """Verdict per station and day within the windows.

    The daily table is written once: the monthly rule, the augmentation and the
    flow itself are all taken from it.
    """
    days = stage(station_days(spark, sf_dir), "days")
    rules = days.groupBy("station", "Month").agg(
        F.avg("Discharge_cfs").alias("MIFR_rules"))
    daily_rules = flow.rules_to_days(rules, calendar(spark), ["Month"]).drop("Month")
    inside = windows.tag_windows(days, "DOY").drop("start_date", "stop_date", "Month", "Day")
    extra = inside.groupBy("station", "Year", "simulation").agg(
        (F.sum("Discharge_cfs") * AUG_SHARE).alias("streamflow_aug_cfs"))
    # Last join on the run keys: its partitioning serves all windows downstream.
    joined = inside.join(daily_rules, ["station", "DOY"]).join(extra, SUPPLY_KEYS)
    return flow.deficit_days(joined)


def deficit_verdicts(spark, sf_dir):
    return verdicts(spark, sf_dir)


def _need():
    return F.col("Aug_Need") == "Yes_Need"


def any_need_groups(spark, sf_dir):
    kept = flow.keep_groups_with(verdicts(spark, sf_dir), SUPPLY_KEYS,
                                 F.col("Can_meet_MIFR") == "YES")
    return kept.groupBy(*SUPPLY_KEYS).agg(F.count(F.lit(1)).alias("n_days"))


def need_runs(spark, sf_dir) -> DataFrame:
    kept = flow.keep_groups_with(verdicts(spark, sf_dir), SUPPLY_KEYS, _need())
    return flow.consecutive_runs(kept, SUPPLY_KEYS, "DOY", where=_need(), unique=True)


def consecutive_runs(spark, sf_dir):
    return need_runs(spark, sf_dir).select(*SUPPLY_KEYS, "DOY", "MIFR_Dff")


def required_pulse(spark, sf_dir):
    return flow.required_pulse(need_runs(spark, sf_dir), SUPPLY_KEYS, "DOY", "MIFR_Dff")


def aug_ratio(spark, sf_dir):
    out = flow.augmentation_ratio(need_runs(spark, sf_dir), SUPPLY_KEYS, "DOY", "MIFR_Dff",
                                  "streamflow_aug_cfs")
    return out.select(*SUPPLY_KEYS, "DOY", "MaxOfTwo", "RelativeRatioOfAug",
                      "RelativeRatioOfAug_adj", "Req_aug_acft", "Aug_avail_acft")


# --- cost of the pulse ------------------------------------------------------------------
def priced_need(spark, sf_dir, runs: DataFrame) -> DataFrame:
    need = flow.required_pulse(runs, SUPPLY_KEYS, "DOY", "MIFR_Dff")
    return curve.curve_lookup(need, station_curve(spark, sf_dir), SUPPLY_KEYS,
                              amount="Req_aug_Acft", cost="cost_acrft")


def curve_lookup(spark, sf_dir):
    # the runs feed two joins
    return priced_need(spark, sf_dir, stage(need_runs(spark, sf_dir), "runs"))


def curve_lookup_regions(spark, sf_dir):
    """Curves per nation, looked up by region: a station with several curves, one step of one of them."""
    points = curve_points(spark, sf_dir).join(sites(spark, sf_dir).withColumnRenamed("basin", "station"), "site")
    curves = curve.supply_curve(points, ["station", "region", "Year", "simulation"], cost="cost_acrft",
                                volume="streamflow_aug_acrft", tie=["site"])
    need = flow.required_pulse(stage(need_runs(spark, sf_dir), "runs"), SUPPLY_KEYS, "DOY", "MIFR_Dff")
    return curve.curve_lookup(need, curves, SUPPLY_KEYS, amount="Req_aug_Acft", cost="cost_acrft",
                              order=["region", "cost_acrft", "cum_streamflow"])


def curve_lookup_many(spark, sf_dir):
    """Every run day's own deficit priced on the station's curve: many needs per key."""
    days = need_runs(spark, sf_dir).select(*SUPPLY_KEYS, units.cfs_to_acre_feet("MIFR_Dff").alias("deficit"))
    return curve.curve_lookup(days, station_curve(spark, sf_dir), SUPPLY_KEYS, amount="deficit",
                              cost="cost_acrft", largest=False)


def need_days_with_pulse(spark, sf_dir):
    """Every run day with its group's required pulse."""
    out = flow.with_required_pulse(need_runs(spark, sf_dir), SUPPLY_KEYS, "DOY", "MIFR_Dff")
    return out.select(*SUPPLY_KEYS, "DOY", "MIFR_Dff", "Req_aug", "Req_aug_Acft", "Fiftyp_aug")


def met_runs(spark, sf_dir) -> DataFrame:
    """Run days whose need can be met two days in a row, with the priced need."""
    runs = stage(need_runs(spark, sf_dir), "runs")
    priced = priced_need(spark, sf_dir, runs)
    met = flow.consecutive_runs(runs, SUPPLY_KEYS, "DOY", unique=True,
                                where=F.col("Can_meet_MIFR") == "YES")
    return met.join(priced, SUPPLY_KEYS)


def mean_cost_matrix(spark, sf_dir):
    tags = ["Aug_Need", "Can_meet_MIFR"]
    return report.mean_cost_matrix(met_runs(spark, sf_dir), [*SUPPLY_KEYS, *tags],
                                   ["station", "simulation", *tags])


def met_year_counts(spark, sf_dir):
    return report.met_year_counts(met_runs(spark, sf_dir), ["station", "simulation"], "Year")


# --- reports ----------------------------------------------------------------------------
def crop_acres(spark, sf_dir) -> DataFrame:
    """Mean area per site over the years, summed per station and display group."""
    season = seasonal(cropped(spark, sf_dir)).where(F.col("simulation") == SCENARIOS[0])
    group = F.create_map(*[F.lit(x) for pair in GROUPS.items() for x in pair])
    per_site = apportion.two_level_mean_sum(season.withColumn("group1", group[F.col("crop")]),
                                            ["site", "group1", "crop"], ["site", "group1"], "Acres", "Acres")
    return (per_site.join(bridge(spark, sf_dir), "site")
            .groupBy("station", "group1").agg(F.sum("Acres").alias("Acres")))


def crop_mix_shares(spark, sf_dir):
    out = report.share_of_total(crop_acres(spark, sf_dir), ["station"], "Acres")
    out = out.withColumn("group_thousand_ac", F.col("Acres") / 1000)
    return rounded(out, 6, "Acres", "Total_ac", "group_thousand_ac")


def crop_mix_wide(spark, sf_dir):
    out = report.to_matrix(crop_acres(spark, sf_dir), ["station"], "group1", "Acres",
                           fv.CROP_GROUP_ORDER)
    return rounded(out, 6, *fv.CROP_GROUP_ORDER)


def _trimmed_impact(spark, sf_dir):
    return flag_impact(spark, sf_dir).where(
        F.col("Per_yield_reduction").between(*fv.REDUCTION_RANGE))


def median_by_group(spark, sf_dir):
    measures = ["Cost_acre", "Per_irrig_saved", "Per_yield_reduction", "streamflow_aug_mm"]
    return rounded(report.medians(_trimmed_impact(spark, sf_dir), ["crop", "simulation"],
                                  measures), 6, *measures)


def box_summary(spark, sf_dir):
    rows = shipments(spark, sf_dir)
    out = report.box_summary(rows, ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return rounded(out, 4, "lower", "middle", "upper")


def impact_boxes(spark, sf_dir):
    out = report.box_summary(flag_impact(spark, sf_dir), ["crop", "simulation"],
                             "Per_yield_reduction", limits=fv.REDUCTION_RANGE)
    return rounded(out, 6, "lower", "middle", "upper", "ymin", "ymax")


def cost_per_acre_boxes(spark, sf_dir):
    rows = flag_impact(spark, sf_dir).where(F.col("Cost_acre") <= fv.MAX_COST_PER_ACRE)
    out = report.box_summary(rows, ["crop"], "Cost_acre", limits=(0, fv.MAX_COST_PER_ACRE))
    return rounded(out, 6, "lower", "middle", "upper", "ymin", "ymax")


def percent_summary(spark, sf_dir):
    out = report.percent_summary(need_runs(spark, sf_dir), SUPPLY_KEYS, "Percentage_aug")
    return rounded(out, 8, "Percen_med", "Percen_mn")


def percent_bins(spark, sf_dir):
    rows = need_runs(spark, sf_dir).select(
        report.bin_percent("Percentage_aug").alias("closed_bin"),
        report.bin_percent("Percentage_aug", closed=False).alias("open_bin"))
    return rows.groupBy("closed_bin", "open_bin").agg(F.count(F.lit(1)).alias("n"))


def years_need_matrix(spark, sf_dir):
    return report.years_matrix(verdicts(spark, sf_dir), "station", "simulation", "Year",
                               F.col("Can_meet_MIFR_50") == "YES", labels=HALVES)


def years_needing(spark, sf_dir):
    return report.years_needing(verdicts(spark, sf_dir), "station", "simulation", "Year", _need())


# --- groups of any size -------------------------------------------------------------------
def _cheap_orders(spark, sf_dir) -> DataFrame:
    """Orders below a price by status: three groups with all rows between them."""
    deficit = (RUN_PRICE - F.col("o_totalprice")).alias("deficit")
    return table(spark, sf_dir, "orders").where(F.col("o_totalprice") < RUN_PRICE).select(
        "o_orderstatus", "o_orderkey", deficit)


RUN_PRICE, KEEP_PRICE = 400000, 495000


def order_runs(spark, sf_dir):
    """Runs of consecutive orders of a status, with the pulse of the status."""
    keys = ["o_orderstatus"]
    runs = long_runs.consecutive_runs(long_runs.cut_days(_cheap_orders(spark, sf_dir), keys, "o_orderkey"), keys,
                                      "o_orderkey", deficit="deficit")
    return long_runs.with_required_pulse(runs, keys).select(
        "o_orderstatus", "o_orderkey", "deficit", "Req_aug", "Req_aug_Acft", "Fiftyp_aug")


def order_pulse(spark, sf_dir):
    keys = ["o_orderstatus"]
    runs = long_runs.consecutive_runs(long_runs.cut_days(_cheap_orders(spark, sf_dir), keys, "o_orderkey"), keys,
                                      "o_orderkey", deficit="deficit")
    return long_runs.required_pulse(runs, keys)


def any_order_groups(spark, sf_dir):
    """Orders of the customers with a dear one, from slices."""
    cut = long_runs.cut_days(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"),
                             ["o_custkey"], "o_orderkey")
    kept = long_runs.keep_groups_with(cut, ["o_custkey"], F.col("o_totalprice") > KEEP_PRICE)
    return kept.select("o_custkey", "o_orderkey", "o_totalprice")


def event_windows(spark, sf_dir):
    """A user's events in the hours after each of their errors: overlapping windows of any length."""
    hours = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3.6e9)
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", hours.alias("at"))
    after = events.where(F.col("event_type") == "error").select(
        F.col("event_id").alias("error_id"), "user_id", F.col("at").alias("start"),
        (F.col("at") + F.col("value") * 20).alias("stop"))
    tagged = intervals.tag_intervals(events, after, point="at", start="start", stop="stop", on=["user_id"])
    return tagged.groupBy("error_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"),
        sem.exact_sum("value", 2).alias("value"))


# --- categories in several orders -----------------------------------------------------------
STUDY_CROPS = [*fv.GRAIN_CROPS, *fv.HAY_CROPS]


def crop_labels(spark, sf_dir):
    """Parts as study crops, with their kinds, groups and display names in order."""
    names = dims.literal_table(spark, ["i", "crop"], list(enumerate(STUDY_CROPS)))
    parts = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % len(STUDY_CROPS)).cast("int").alias("i")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("size"))
    return (parts.join(F.broadcast(names), "i").join(F.broadcast(dims.crop_groups(spark)), "crop")
            .join(F.broadcast(dims.crop_display(spark)), "crop").drop("i"))


STATION_ORDERS = {"code_place": fv.STATION_CODE_ORDER, "ratio_place": fv.STATION_RATIO_ORDER}


def station_orders(spark, sf_dir):
    """Quantity by station, and the station's position when sorted by each of the three orders."""
    n = len(fv.STATIONS)
    names = dims.literal_table(spark, ["i", "long_name"], [(i, s[0]) for i, s in enumerate(fv.STATIONS)])
    nations = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("site"), (F.col("s_nationkey") % n).cast("int").alias("i"))
    qty = (table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("site"), "l_quantity").join(nations, "site")
           .groupBy("i").agg(F.sum("l_quantity").alias("qty")).join(F.broadcast(names), "i")
           .join(F.broadcast(dims.stations(spark).select(F.col("station_name").alias("long_name"), "station", "station_code", "SITENO", "name_rank")), "long_name"))
    shown = dims.ranked(qty.withColumn("label", F.coalesce("station_code", "station")), "label", STATION_ORDERS)
    by = lambda c: F.row_number().over(Window.orderBy(F.asc_nulls_last(c)))  # noqa: E731  a dozen rows
    return shown.select("station", "label", "SITENO", "qty", "name_rank", "code_place", "ratio_place",
                        by("name_rank").alias("nth_by_name"), by("code_place").alias("nth_by_code"),
                        by("ratio_place").alias("nth_by_ratio"))


def crop_mix_rest(spark, sf_dir):
    """The crop mix by two named groups, and all others in a column of their own."""
    out = report.to_matrix(crop_acres(spark, sf_dir), ["station"], "group1", "Acres", fv.CROP_GROUP_ORDER[:2], rest="Other")
    return rounded(out, 6, *fv.CROP_GROUP_ORDER[:2], "Other")


# --- set operations, keys, files ------------------------------------------------------------
def placeholder_union(spark, sf_dir):
    daily = shipments(spark, sf_dir).groupBy("DOY", "l_returnflag").agg(
        F.sum("l_quantity").alias("qty"))
    counted = windows.tag_windows(daily, "DOY").groupBy("simulation", "l_returnflag").agg(
        F.sum("qty").alias("qty"))
    empty = table(spark, sf_dir, "region").select(F.lit("Scenario02").alias("simulation"),
                                                  F.col("r_name").alias("l_returnflag"))
    return report.with_placeholders(counted, empty)


def union_distinct(spark, sf_dir):
    rows = shipments(spark, sf_dir).select("site", "Year", "l_returnflag")
    extra = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("site"), F.lit(1998).alias("Year"),
        F.lit(BASE).alias("l_returnflag"))
    return (rows.unionByName(extra).distinct().groupBy("Year", "l_returnflag")
            .agg(F.count(F.lit(1)).alias("sites")))


def _order_dates(spark, sf_dir):
    """Two spellings of the order date, by priority; the rest has no date."""
    d = F.col("o_orderdate")
    dashed = F.date_format(d, "yyyy-MM-dd")
    slashed = F.concat_ws("/", F.month(d), F.dayofmonth(d), F.year(d))
    text = (F.when(F.col("o_orderpriority").startswith("1"), dashed)
            .when(F.col("o_orderpriority").startswith("2"), slashed)
            .when(F.col("o_orderpriority").startswith("3"), dashed))
    return table(spark, sf_dir, "orders").select("o_custkey", text.alias("PriorityDate"))


def water_right_merge(spark, sf_dir):
    """Dashed dates rewritten and merged with the others; equal rows pair up."""
    rows = _order_dates(spark, sf_dir)
    dashed = rows.where(F.col("PriorityDate").contains("-")).withColumn(
        "PriorityDate", k.slashed_date("PriorityDate"))
    others = rows.where(~F.coalesce(F.col("PriorityDate").contains("-"), F.lit(False)))
    merged = sem.null_safe_merge(dashed, others)
    return merged.groupBy("PriorityDate").agg(F.count(F.lit(1)).alias("rights"))


def site_key_build(spark, sf_dir):
    """Cell names split and rebuilt as grid ids; coordinates with five decimals."""
    s = table(spark, sf_dir, "supplier")
    lat, long = F.col("s_suppkey") / 16, -F.col("s_nationkey") / 16
    cell = F.concat(k.five_decimals(lat), F.lit("_"), k.five_decimals(long))
    return s.select("s_suppkey", cell.alias("cell"), k.grid_site_from_cell(cell).alias("site"),
                    k.composite_key("s_nationkey", "s_suppkey").alias("site_key"),
                    k.merge_regions(F.col("s_name"), {"Supplier": "Site"}).alias("renamed"))


def station_bridge(spark, sf_dir):
    """Cells to sites, tied to stations, and the stations kept, without repeats."""
    s = table(spark, sf_dir, "supplier")
    cell = F.concat(k.five_decimals(F.col("s_suppkey") / 16), F.lit("_-"),
                    k.five_decimals(F.col("s_nationkey") / 16))
    cells = s.select("s_nationkey", k.grid_site_from_cell(cell).alias("site"))
    outlets = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("station"),
        "n_regionkey")
    links = cells.join(outlets, "s_nationkey", "left")
    coastal = table(spark, sf_dir, "region").where(
        sem.in_values("r_name", ["ASIA", "EUROPE", "AFRICA"]))
    kept = sem.is_in_table(links, coastal, {"n_regionkey": "r_regionkey"})
    return kept.select("station", "site").distinct()


def harvest_timing(spark, sf_dir):
    """Windows whose harvest comes after the target day."""
    daily = windows.tag_windows(daily_supply(cropped(spark, sf_dir)), "DOY").withColumn(
        "target_harvest_date", F.col("start_date") + fv.HARVEST_GRACE_DAYS)
    late = daily.where(F.col("harvest_date") > F.col("target_harvest_date"))
    return late.groupBy("simulation", "crop").agg(
        F.count(F.lit(1)).alias("n"), F.sum("irrig1").alias("qty"),
        F.min("harvest_date").alias("first_harvest"))


def read_scenarios(spark, sf_dir):
    """Seasonal rows written as one result file folder per flag, then read back."""
    root = f"{shared_dir(spark)}/scenario-files-{uuid.uuid4().hex}"
    season = stage(seasonal(cropped(spark, sf_dir)), "season")
    for flag in (BASE, *SCENARIOS):
        (season.where(F.col("simulation") == flag).select(
            F.concat(F.col("Year").cast("string"), F.lit("-09-30(273)")).alias("YYYY-MM-DD(DOY)"),
            "crop", F.lit("1998120").alias("planting_date"),
            F.lit("1998273").alias("harvest_date"), F.col("yield_kgha").alias("yield"),
            (F.col("yield_kgha") * 2).alias("used_biomass"), "irrig",
            F.lit("WallaWalla").alias("region"), "site")
         .write.csv(f"{root}/{flag}/result.dat", header=True))
    got = readers.read_scenarios(spark, root)
    return got.groupBy("simulation", "crop", "Year").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("irrig"), 6).alias("irrig"),
        F.round(F.sum("used_biomass"), 4).alias("used_biomass"),
        F.min(k.day_of_season("harvest_date")).alias("harvest_day"))


#: every registered query, in the order of the inventory
QUERIES = [
    scenario_window_join, window_labels, ratio_null_on_zero, negated_membership,
    table_membership, complete_cases, discharge_calendar, grid_factors, basin_impact,
    unify_measure, impact_vs_baseline,
    price_outcome, impact_clamps, per_acre_measures, window_demand, impact_table,
    apportion_to_parts, shares_add_up, field_to_grid, field_to_grid_unequal, field_rights, daily_demand, grid_rollup,
    gauge_rollup, running_totals_nulls, supply_curve,
    nested_supply_curves, curve_slice, barter_price, rules_unpivot, rule_text_parse,
    rules_to_days, deficit_verdicts, any_need_groups, consecutive_runs, required_pulse,
    aug_ratio, need_days_with_pulse, curve_lookup, curve_lookup_regions, curve_lookup_many, mean_cost_matrix, met_year_counts, crop_mix_shares,
    crop_mix_wide, median_by_group, box_summary, impact_boxes, cost_per_acre_boxes,
    percent_summary, percent_bins, years_need_matrix, years_needing, placeholder_union,
    union_distinct, order_runs, order_pulse, any_order_groups, event_windows, crop_labels, station_orders, crop_mix_rest,
    water_right_merge, site_key_build, station_bridge, harvest_timing, read_scenarios,
]


def tuned(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(tune(spark), sf_dir)
    run.__doc__ = query.__doc__
    run.__name__ = query.__name__
    return run


def registered():
    from . import testfiles  # builds on this module

    return {q.__name__: tuned(q) for q in [*QUERIES, *testfiles.QUERIES]}
