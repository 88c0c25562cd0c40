"""Queries that write the shipped tables as input files of the study, and read these.

Every function writes whole tables, by Spark, to the shared folder, in the layout the readers know: folders by
scenario, ragged cell files, headers with blank and repeated names, station numbers spoiled by a spreadsheet.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import fixed_values as fv
from ..functions import keys as k
from ..functions import semantics as sem
from ..operators import flow
from ..operators.running import stage
from ..session import shared_dir
from ..sources import readers, sinks, tables
from . import study
from . import testdata as td

#: part types as crops of the study; the last is none
CROPS = {"MEDIUM": "Corn_grain", "LARGE": "Onion", "STANDARD": "Spring_wheat", "SMALL": "Alfalfa_Hay",
         "PROMO": "Timothy", "ECONOMY": "Kelp"}
SHARES = {"Drip": 0.95, "Pivot": 0.85}
MOISTURE = {c: 1.0 + i / 8 for i, c in enumerate(CROPS.values())}
DAILY_YEARS = (1995, 1996)
#: flags as scenarios of the single basin
BASIN_SCENARIOS = {"A": "Scenario05", "R": "Scenario08"}
BASIN_YEAR = 1995
#: volume of the curve that the barter is spread over
BASIN_CUTOFF = 400
#: the region whose number the gauge file spoils, and the numbers of the others
SPOILED_REGION = "AFRICA"
RIGHTS_LEFT_OUT = ["B3", "B7"]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _csv(df: DataFrame, path: str, **options) -> None:
    df.write.csv(path, header=True, **options)


def _lines(df: DataFrame, line, header: str, path: str) -> None:
    """Lines as they are, under a header, whatever separators they hold."""
    _csv(df.select(line.alias(header)), path, sep="\u0001")


def _crop(c="crop"):
    return F.create_map(*[F.lit(x) for pair in CROPS.items() for x in pair])[F.col(c)]


# --- daily files ---------------------------------------------------------------------
def _daily(spark, sf_dir) -> DataFrame:
    rows = td.cropped(spark, sf_dir).groupBy("site", "crop", "Year", "DOY", F.col("l_returnflag").alias("simulation")).agg(
        F.sum("l_quantity").alias("irrig"))
    places = td.sites(spark, sf_dir).select("site", F.col("basin").alias("region"))
    return rows.join(places, "site").withColumn("crop", _crop())


def _daily_grids(spark, sf_dir) -> DataFrame:
    """A grid for every site and crop, with factors by the site's irrigation type."""
    kind = F.when(F.col("site") % 2 == 0, "Drip").otherwise("Pivot")
    crops = F.explode(F.array(*map(F.lit, CROPS.values())))
    grids = td.sites(spark, sf_dir).select("site", F.col("basin").alias("region"), kind.alias("Irrigation"), crops.alias("crop"))
    shares = dims.literal_table(spark, ["Irrigation", "ML_Fraction"], list(SHARES.items()))
    wet = dims.literal_table(spark, ["crop", "WM_ML_factor"], list(MOISTURE.items()))
    return grids.join(F.broadcast(shares), "Irrigation").join(F.broadcast(wet), "crop")


def _events(events: DataFrame) -> DataFrame:
    return events.groupBy("simulation", "crop", "Year", "Irrigation").agg(
        F.count(F.lit(1)).alias("n"), sem.exact_sum("irrig1", 2).alias("irrig1"))


def daily_files(spark, sf_dir):
    """Events of two scenarios, from a folder of daily text files for each."""
    root = _folder(spark, "daily-files")
    rows = stage(_daily(spark, sf_dir), "daily")
    for flag in (td.BASE, *td.SCENARIOS):
        _csv(rows.where(F.col("simulation") == flag).select(
            "Year", F.col("DOY").alias("DOY "), F.col("irrig").alias("Irrigation cum(timestep)"), "region", "crop", "site"),
            f"{root}/{flag}/daily_result.dat", ignoreTrailingWhiteSpace=False)
    return _events(readers.read_daily_scenarios(spark, root, _daily_grids(spark, sf_dir), simulations=td.SCENARIOS))


def daily_tree(spark, sf_dir):
    """The same from a Parquet tree, of two years."""
    root = _folder(spark, "daily-tree")
    sinks.write_partitioned(_daily(spark, sf_dir), root)
    return _events(readers.read_daily_tree(spark, root, _daily_grids(spark, sf_dir), simulations=td.SCENARIOS, years=DAILY_YEARS))


# --- ragged cells ----------------------------------------------------------------------
def _cell_files(spark, sf_dir) -> str:
    """Two versions of a cell file, by code and by number, with short, long and blank-ended rows; outlets for both."""
    root = _folder(spark, "cells")
    s = td.table(spark, sf_dir, "supplier")
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    cell = F.concat_ws("_", F.format_string("%.5f", key / 16), F.format_string("%.5f", -nation / 16))
    rest = F.when(key % 7 == 0, "").when(key % 11 == 0, F.concat(F.lit(","), cell, F.lit(",shifted"))).when(
        key % 13 == 0, F.concat(F.lit(","), cell, F.lit(",,"))).otherwise(F.concat(F.lit(","), cell))
    _lines(s.where(nation < 12), F.concat(F.lit("C"), nation.cast("string"), rest), "StationCode,Grid", f"{root}/v1")
    _lines(s.where(nation >= 12), F.concat(F.lit("N"), nation.cast("string"), rest), "SITENO,Grid", f"{root}/v2")
    n = td.table(spark, sf_dir, "nation")
    number = F.col("n_nationkey").cast("string")
    _csv(n.select(F.concat(F.lit("N"), number).alias("SITENO"), F.col("n_name").alias("SITENAME"), F.lit(1.5).alias("LONGDD"),
                  F.lit(2.5).alias("LATDD"), F.lit(3.5).alias("VIC lat"), F.lit(4.5).alias("VIC long"),
                  F.concat(F.lit("C"), number).alias("StationCode"), F.lower("n_name").alias("SITENAME1"),
                  F.lit("x").alias("outlet")), f"{root}/outlets")
    return root


def cell_files(spark, sf_dir):
    """Stations and their cells from both versions; short rows have no cell, long ones are left out."""
    root = _cell_files(spark, sf_dir)
    first = readers.read_station_cells(spark, f"{root}/v1", f"{root}/outlets")
    return first.unionByName(readers.read_station_cells(spark, f"{root}/v2", f"{root}/outlets"))


def long_cell_rows(spark, sf_dir):
    """The rows kept apart, counted by station code and by what stood beyond the columns."""
    found = readers.read_ragged_table(spark, f"{_cell_files(spark, sf_dir)}/v1", tables.CONTRIBUTING_CELL)
    return found.long.groupBy("StationCode", "beyond").agg(F.count(F.lit(1)).alias("n"), F.min("cell").alias("first_cell"))


# --- single basin --------------------------------------------------------------------------
def single_basin(spark, sf_dir):
    """Result files, grids under a mangled header, factors and prices, through to the barter price."""
    root = _folder(spark, "basin")
    rows = td.cropped(spark, sf_dir).withColumn("crop", _crop())
    season = stage(td.seasonal(rows), "season")
    columns = [F.concat(F.col("Year").cast("string"), F.lit("-09-30(273)")).alias("YYYY-MM-DD(DOY)"), "crop",
               F.lit("1998120").alias("planting_date"),
               F.concat(F.col("Year").cast("string"), F.when(F.col("crop") == "Onion", "170").otherwise("250")).alias("harvest_date"),
               F.col("yield_kgha").alias("yield"), (F.col("yield_kgha") * 2).alias("used_biomass"), "irrig",
               F.lit(fv.BASIN_REGION).alias("region"), "site"]
    _csv(season.where(F.col("simulation") == td.BASE).select(*columns), f"{root}/{study.LAYOUT['basin_baseline']}")
    for flag, name in BASIN_SCENARIOS.items():
        _csv(season.where(F.col("simulation") == flag).select(*columns),
             f"{root}/{study.LAYOUT['basin_scenarios']}/{name}/result.dat")
    grids = rows.groupBy("site", "crop").agg(F.count(F.lit(1)).alias("n"))
    site = F.col("site").cast("string")
    _lines(grids, F.concat_ws(",", "crop", site, F.lit("Pivot"), F.lit("H"), site, F.col("n").cast("string"), F.lit("50"),
                              F.lit("45.1"), F.lit("-121.2"), F.concat(F.lit("D"), site), F.lit("-1"), F.lit("-2")),
           "Crop_Name,site,Irrigation,HUC10_NAME,Grid_Number,Acres,CropAcres,lat,long,WR_DOC_ID (Dummy),,Acres",
           f"{root}/{study.LAYOUT['basin_grids']}")
    _csv(dims.literal_table(spark, ["Irrigation", "Efficiency", "ML_Fraction"], [("Pivot", 0.8, SHARES["Pivot"])]),
         f"{root}/{study.LAYOUT['efficiency']}")
    _csv(dims.literal_table(spark, ["crop", "WM_ML_factor"], list(MOISTURE.items())), f"{root}/{study.LAYOUT['moisture']}")
    prices = td.crop_prices(spark, sf_dir).select(
        _crop().alias("crop"), F.col("mean_Price").alias("Mean_price_2020_2023"), F.lit(1.5).alias("Mean_Price_of_all_time_1979_2023"))
    _csv(prices, f"{root}/{study.LAYOUT['prices']}")
    return study.load_basin(spark, root).barter(year=BASIN_YEAR, cutoff=BASIN_CUTOFF)


# --- rights, gauges, rules ------------------------------------------------------------------
def rights_files(spark, sf_dir):
    """Fields met by their rights; listed basins and interruptible rights out, unknown basins stay."""
    root = _folder(spark, "rights")
    part = td.table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    crop = _crop("p_type")
    lat, long = F.format_string("%.5f", 40 + key % 100 / 16), F.format_string("%.5f", -118 - key % 50 / 16)
    date = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("19"), F.lpad((key % 90 + 10).cast("string"), 2, "0"), F.lit("-05-01"))).when(
        F.col("p_size") % 3 == 1, F.concat(F.lit("5/1/19"), F.lpad((key % 90 + 10).cast("string"), 2, "0")))
    basin = F.when(key % 17 > 0, F.concat(F.lit("B"), (key % 9).cast("string")))
    right = F.concat(F.lit("WR"), (key % 50).cast("string"))
    _csv(part.select(key.alias("OBJECTID_1"), crop.alias("Crop_Name"), date.alias("PriorityDa"), right.alias("WRDocID"),
                     F.col("p_retailprice").alias("FieldAcres"), lat.alias("Lat"), long.alias("Long"), F.lit(1.0).alias("IntersectA"),
                     lat.alias("join_lat"), long.alias("join_lon"), basin.alias("WRIA_NM")), f"{root}/rights")
    # Lat and lat are two columns
    _lines(part, F.concat_ws(",", key.cast("string"), crop, F.col("p_size").cast("string"), lat, long, F.lit("30"),
                             F.coalesce(basin, F.lit("")), F.lit("G"), F.lit("R"), F.lit("-1.5"), F.lit("2.5"),
                             F.concat(F.lit("s"), key.cast("string"))),
           "FID_WSDA,Crop_Name,Acres,lat,long,WRIA_ID1,WRIA,Grid_Number,region,Long,Lat,site", f"{root}/fields")
    _csv(td.table(spark, sf_dir, "nation").select(F.concat(F.lit("WR"), F.col("n_nationkey").cast("string")).alias("WR_Doc_ID")),
         f"{root}/interruptible")
    rights = readers.read_water_rights(spark, f"{root}/rights")
    fields = readers.read_fields(spark, f"{root}/fields").where(sem.not_in_values("WRIA", RIGHTS_LEFT_OUT))
    met = fields.join(rights.select("FID_WSDA", "crop", "lat", "long", "PriorityDate", "WRDocID", F.col("site").alias("grid")),
                      ["FID_WSDA", "crop", "lat", "long"])
    met = sem.not_in_table(met, readers.read_table(spark, f"{root}/interruptible", tables.INTERRUPTIBLE), {"WRDocID": "WR_Doc_ID"})
    return met.select(F.col("FID_WSDA").cast("long").alias("part"), "crop", "Acres_PF", "WRIA", k.slashed_date("PriorityDate").alias("PriorityDate"),
                      "WRDocID", "lat", "long", "grid", "field_lat")


def gauge_files(spark, sf_dir):
    """Flow, rule and augmentation of every gauge and day, all met by repaired station numbers."""
    root = _folder(spark, "gauges")
    region = td.table(spark, sf_dir, "region").select(
        "r_name", F.when(F.col("r_name") == SPOILED_REGION, fv.SPOILED_STATION_ID[1]).otherwise(
            F.concat(F.lit("1244"), F.col("r_regionkey").cast("string"))).alias("number"))
    spoiled = F.when(F.col("number") == fv.SPOILED_STATION_ID[1], fv.SPOILED_STATION_ID[0]).otherwise(F.col("number"))
    _csv(region.select(spoiled.alias("SITENO"), F.lower("r_name").alias("SITENAME"), F.lit(1).alias("LONGDD"), F.lit(2).alias("LATDD"),
                       F.lit("u").alias("SITEURL"), F.lit(3).alias("join_lat"), F.lit(4).alias("join_lon")), f"{root}/gauges")
    _csv(region.select(F.col("r_name").alias("MIFR_NAME"), spoiled.alias("SITENO")), f"{root}/rule_gauges")
    # a blank name at the end of the header, and a dotted site
    wide = td.wide_rules(spark, sf_dir)
    _csv(wide.withColumnRenamed("MIDDLE EAST", "MIDDLE.EAST"), f"{root}/rules")
    _csv(td.calendar(spark), f"{root}/calendar")
    days = stage(td.region_days(spark, sf_dir).join(region, F.col("station") == F.col("r_name")), "flows")
    _csv(days.select(F.col("number").alias("site_no"), "Year", "Month", "Day", "DOY", "Discharge_cfs"), f"{root}/discharge")

    names = readers.read_rule_gauges(spark, f"{root}/rule_gauges").withColumn(
        "MIFR_NAME", F.replace("MIFR_NAME", F.lit(" "), F.lit(".")))
    rules = flow.threshold_rules([readers.read_wide_rules(spark, f"{root}/rules")], ["Month"],
                                 readers.read_calendar(spark, f"{root}/calendar"), names)
    flows = readers.read_discharge(spark, f"{root}/discharge")
    gauges = readers.read_gauges(spark, f"{root}/gauges").select("SITENO", "SITENAME")
    met = flows.join(rules.select("SITENO", "DOY", "MIFR_rules", "Condition"), ["SITENO", "DOY"]).join(gauges, "SITENO")
    # augmentation comes by name of the gauge
    extra = days.where(F.col("DOY").between(*fv.RULE_DAYS)).groupBy(F.lower("station").alias("SITENAME"), "Year").agg(
        (F.sum("Discharge_cfs") * td.AUG_SHARE).alias("streamflow_aug_cfs"))
    out = flow.deficit_days(met.join(extra, ["SITENAME", "Year"]))
    return out.select("SITENO", "SITENAME", "Year", "DOY", "Discharge_cfs", "MIFR_rules", "Condition", "streamflow_aug_cfs",
                      "Aug_Need", "Can_meet_MIFR")


# --- published results -----------------------------------------------------------------------
def published_calendar(spark, sf_dir):
    """A result published, published again, and read through its manifest."""
    root = _folder(spark, "published")
    result = td.discharge_calendar(spark, sf_dir)
    sinks.publish(result.where(F.col("Month") < 7), root, "draft")
    sinks.publish(result, root, "final")
    sinks.publish(result, root, "final")
    return readers.read_published(spark, root)


QUERIES = [daily_files, daily_tree, cell_files, long_cell_rows, single_basin, rights_files, gauge_files, published_calendar]
