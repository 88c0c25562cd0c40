"""File readers.  Every reader is lazy apart from looking at one header line.

Columns are matched by name, read as text and converted with ``try_cast``: blanks,
``NA`` and unparsable numbers become NULL, ragged rows are padded with NULL.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import fixed_values as fv
from ..functions import keys as k
from ..functions.semantics import complete_cases, in_values, number
from ..operators import impact
from . import sinks
from . import tables as t

SEPARATORS = [",", "\t", "|", ";", " "]


def _folded(name: str) -> str:
    return re.sub(r"[^0-9A-Za-z_]", ".", name).strip(".")


def _header(spark: SparkSession, path: str, sep: str | None) -> tuple[list[str], str]:
    """Names in the first line of the first file, and the separator."""
    line = spark.read.text(path).first()[0].lstrip("﻿")
    sep = sep or max(SEPARATORS, key=re.sub(r'"[^"]*"', "", line).count)
    return next(csv.reader([line], delimiter=sep)), sep


def repaired_names(header: Sequence[str]) -> list[str]:
    """Names that tell all columns of a header apart: blank ones are called after their position (``V3``),
    repeats get ``.1``, ``.2``; the first of a repeated name keeps it."""
    out: list[str] = []
    for i, name in enumerate(map(str.strip, header), start=1):
        name, n = name or f"V{i}", 0
        while (made := f"{name}.{n}" if n else name) in out:
            n += 1
        out.append(made)
    return out


def _column_finder(header: Sequence[str], columns: Sequence[str]) -> dict[str, str]:
    """Our column by repaired name, by folded name, and by position (``#1`` is the first)."""
    names = repaired_names(header)
    found = {f"#{i}": c for i, c in enumerate(columns, start=1)}
    for name, c in zip(names, columns):
        found.setdefault(_folded(name), c)
    return found


def read_text_table(spark: SparkSession, path: str, sep: str | None = None
                    ) -> tuple[DataFrame, list[str]]:
    """All columns as text, and their names in the file.

    Where the header names are usable as they are, Spark checks the header of
    every file against them, so files of a different layout fail instead of
    shifting columns.  Headers with blank names, or with names that differ in
    case only, are read by position.
    """
    header, sep = _header(spark, path, sep)
    usable = all(header) and len({h.lower() for h in header}) == len(header)
    names = header if usable else [f"c{i}" for i in range(len(header))]
    schema = StructType([StructField(n, StringType()) for n in names])
    df = spark.read.csv(path, schema=schema, sep=sep, header=True, quote='"', escape='"',
                        enforceSchema=not usable, mode="PERMISSIVE")
    return df, header


def _value(name: str, kind: str) -> Column:
    text = F.nullif(F.nullif(F.trim(F.col(f"`{name}`")), F.lit("")), F.lit("NA"))
    if kind == "string":
        return text
    value = number(text)
    value = F.when(~F.isnan(value), value)
    return value if kind == "double" else value.try_cast(kind)


def read_table(spark: SparkSession, path: str, columns: Mapping[str, tuple[str, str]], *,
               sep: str | None = None, extra: Sequence[Column] = ()) -> DataFrame:
    """Typed, renamed projection of a delimited file (see ``tables``)."""
    df, header = read_text_table(spark, path, sep)
    return df.select(*_picked(_column_finder(header, df.columns), columns, path), *extra)


def _picked(found: Mapping[str, str], columns: Mapping[str, tuple[str, str]], path: str) -> list[Column]:
    picked = []
    for out, (name, kind) in columns.items():
        optional, name = name.startswith("?"), name.lstrip("?")
        column = found.get(name if name.startswith("#") else _folded(name))
        if column is not None:
            picked.append(_value(column, kind).alias(out))
        elif optional:
            picked.append(F.lit(None).cast(kind).alias(out))
        else:
            raise ValueError(f"{path}: no column {name!r}")
    return picked


class Ragged(NamedTuple):
    """rows   rows of the table; those short of columns are padded with NULL
    long   rows with text beyond the last column: the columns, ``beyond`` (what follows) and ``file``
    """

    rows: DataFrame
    long: DataFrame


def read_ragged_table(spark: SparkSession, path: str, columns: Mapping[str, tuple[str, str]], *,
                      sep: str | None = None) -> Ragged:
    """A delimited file whose rows need not have as many cells as the header.

    Short rows are filled.  A row with text in a cell beyond the header has shifted somewhere: it is
    kept apart rather than read wrongly.  Blank cells at the end do no harm.
    """
    header, sep = _header(spark, path, sep)
    names = [f"c{i}" for i in range(len(header))]
    schema = StructType([StructField(n, StringType()) for n in [*names, "_beyond"]])
    # all columns are parsed, or the rows' lengths would not be known; the header may differ between files
    df = spark.read.option("columnPruning", False).csv(
        path, schema=schema, sep=sep, header=True, quote='"', escape='"', enforceSchema=True, mode="PERMISSIVE")
    picked = _picked(_column_finder(header, names), columns, path)
    beyond = F.trim(F.coalesce("_beyond", F.lit("")))
    return Ragged(df.where(beyond == "").select(*picked),
                  df.where(beyond != "").select(*picked, beyond.alias("beyond"), F.col("_metadata.file_path").alias("file")))


def folder_name(file: str) -> Column:
    """Name of the folder that holds ``file``, from the path of the row's file.

    Evaluated for every row, so plain cuts instead of a pattern; only a name with
    escaped characters is decoded.
    """
    name = F.substring_index(
        F.substring_index(F.col("_metadata.file_path"), f"/{file}", 1), "/", -1)
    escaped = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    return F.when(name.contains("%"), escaped).otherwise(name)


# --- simulation output ------------------------------------------------------------
def _season(df: DataFrame) -> DataFrame:
    return df.withColumn("Year", k.year_of_dated_label("dated")).drop("dated")


def read_scenarios(spark: SparkSession, root: str, file: str = "result.dat",
                   sep: str | None = None) -> DataFrame:
    """Seasonal rows of all scenario folders under ``root``, as one scan.

    The folder name becomes ``simulation``.
    """
    return _season(read_table(spark, f"{root.rstrip('/')}/*/{file}", t.SEASONAL, sep=sep,
                              extra=[folder_name(file).alias("simulation")]))


def read_baseline(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    return _season(read_table(spark, path, t.SEASONAL, sep=sep,
                              extra=[F.lit(fv.BASELINE).alias("simulation")]))


def read_yields(spark: SparkSession, root: str, **options) -> DataFrame:
    """Scenario rows with the common yield column; crops of no group drop."""
    return impact.unify_yield(read_scenarios(spark, root, **options))


def daily_events(daily: DataFrame, grids: DataFrame, *, crops: Sequence[str] | None = None,
                 days: tuple[int, int] = fv.IRRIGATION_DAYS) -> DataFrame:
    """Irrigation events of the study crops in season, with the net amount.

    Filters come before the join to the grid factors.
    """
    # plain membership, which a scan can test; a NULL crop is no member either way
    kept = daily.where(F.col("crop").isin(list(crops or fv.GRAIN_CROPS + fv.HAY_CROPS))
                       & F.col("DOY").between(*days) & (F.col("irrig") > 0))
    factors = grids.select("crop", "site", "region", "Irrigation", "ML_Fraction", "WM_ML_factor")
    return (complete_cases(kept).join(factors, ["crop", "site", "region"], "left")
            .withColumn("irrig1", F.col("irrig") * F.col("ML_Fraction")))


def read_daily_scenarios(spark: SparkSession, root: str, grids: DataFrame,
                         file: str = "daily_result.dat", sep: str | None = None,
                         simulations: Sequence[str] | None = None) -> DataFrame:
    """Daily events of the scenario folders under ``root``; of ``simulations``, only their folders are opened."""
    folders = "*" if simulations is None else "{" + ",".join(simulations) + "}"
    rows = read_table(spark, f"{root.rstrip('/')}/{folders}/{file}", t.DAILY, sep=sep,
                      extra=[folder_name(file).alias("simulation")])
    return daily_events(rows, grids)


def read_daily_tree(spark: SparkSession, root: str, grids: DataFrame, *, simulations: Sequence[str] | None = None,
                    years: tuple[int, int] | None = None, crops: Sequence[str] | None = None) -> DataFrame:
    """Daily events of a Parquet tree by simulation and year (``sinks.write_partitioned``).

    Folders of other simulations and years are never listed for reading; crop, day and amount are tested in
    the scan; the grid's factors come after.
    """
    rows = spark.read.parquet(root).select(*t.DAILY, "simulation")
    if simulations is not None:
        rows = rows.where(F.col("simulation").isin(list(simulations)))
    if years is not None:
        rows = rows.where(F.col("Year").between(*years))
    return daily_events(rows, grids, crops=crops)


def read_daily_baseline(spark: SparkSession, path: str, grids: DataFrame,
                        sep: str | None = None) -> DataFrame:
    rows = read_table(spark, path, t.DAILY, sep=sep,
                      extra=[F.lit(fv.BASELINE).alias("simulation")])
    return daily_events(rows, grids)


# --- dimensions ---------------------------------------------------------------------
def read_windows(spark: SparkSession, path: str, prefix: str = "Scenario") -> DataFrame:
    return read_table(spark, path, t.SCENARIO_WINDOW).where(
        F.col("simulation").startswith(prefix))


def read_crop_grids(spark: SparkSession, path: str, efficiency: DataFrame, moisture: DataFrame,
                    regions: Sequence[str] | None = fv.STUDY_REGIONS) -> DataFrame:
    """Crop grids with irrigation and moisture factors; coordinates as text keys."""
    return with_factors(read_table(spark, path, t.CROP_GRID), efficiency, moisture, regions)


def read_basin_grids(spark: SparkSession, path: str, efficiency: DataFrame,
                     moisture: DataFrame, region: str = fv.BASIN_REGION) -> DataFrame:
    grids = read_table(spark, path, t.CROP_GRID_BASIN).withColumn("region", F.lit(region))
    return with_factors(grids, efficiency, moisture, None)


def with_factors(grids: DataFrame, efficiency: DataFrame, moisture: DataFrame,
                 regions: Sequence[str] | None) -> DataFrame:
    if regions is not None:
        grids = grids.where(in_values("region", regions))
    return (grids.join(efficiency.select("Irrigation", "Efficiency", "ML_Fraction"),
                       "Irrigation", "left")
            .join(moisture.select("crop", "WM_ML_factor"), "crop", "left")
            .withColumns({c: k.five_decimals(c) for c in ("lat", "long")}))


def read_water_rights(spark: SparkSession, path: str) -> DataFrame:
    """Rights with their grid id built from the coordinates as spelled in the file."""
    rights = read_table(spark, path, t.WATER_RIGHT)
    return rights.withColumn("site", k.grid_site("lat", "long")).withColumns(
        {c: k.five_decimals(c) for c in ("lat", "long")})


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, t.FIELD_GRID).withColumns(
        {c: k.five_decimals(c) for c in ("lat", "long")})


def read_station_cells(spark: SparkSession, cells_path: str, outlets_path: str,
                       stations: Sequence[str] | None = None) -> DataFrame:
    """station, SITENO, site: the cells contributing to each station.

    Cells carry the station's code or its number, whichever the file has.  Cell files are ragged:
    rows short of cells are filled, rows with more text than columns are left out (see :func:`read_ragged_table`).
    """
    outlets = read_table(spark, outlets_path, t.STATION_OUTLET).select(
        "SITENO", "StationCode", "station")
    cells = read_ragged_table(spark, cells_path, t.CONTRIBUTING_CELL).rows
    header, _ = _header(spark, cells_path, None)
    shared = [c for c in ("StationCode", "SITENO") if c in header]
    cells = cells.select("cell", *shared).withColumn("site", k.grid_site_from_cell("cell"))
    out = cells.join(outlets, shared, "left").select("station", "SITENO", "site")
    if stations is not None:
        out = out.where(in_values("station", stations))
    return out.distinct()


def read_gauges(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, t.GAUGE).withColumn("SITENO", k.repaired_station_id("SITENO"))


def read_rule_gauges(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, t.RULE_GAUGE).withColumn(
        "SITENO", k.repaired_station_id("SITENO"))


def read_wide_rules(spark: SparkSession, path: str) -> DataFrame:
    """Month, Start_date, End_date, then one text column per rule site.

    A rule site keeps its name as a dotted identifier, the way the rule-gauge map
    spells it.
    """
    df, header = read_text_table(spark, path)
    return df.select(*[_value(c, "string").alias(re.sub(r"[^0-9A-Za-z_.]", ".", h))
                       for h, c in zip(header, df.columns) if h])


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Calendar columns as text apart from the integer ``DOY``."""
    df, header = read_text_table(spark, path)
    return df.select(*[_value(c, "int" if h == "DOY" else "string").alias(h)
                       for h, c in zip(header, df.columns) if h])


def read_discharge(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, t.DISCHARGE).withColumn(
        "SITENO", k.repaired_station_id("SITENO"))


def discharge_from_daily_values(raw: DataFrame, *, site: str = "site_no", date: str = "Date",
                                value: str = "X_00060_00003") -> DataFrame:
    """Downloaded daily values to the discharge layout; station numbers stay text."""
    dated = raw.withColumn("_date", F.col(date).try_cast("date"))
    return k.calendar_columns(dated, "_date").select(
        k.repaired_station_id(site).alias("SITENO"), "Year", "Month", "Day", "DOY",
        F.col(value).try_cast("double").alias("Discharge_cfs"))


def columns_between(df: DataFrame, first: int, last: int) -> DataFrame:
    """Columns by position, counted from 1, both ends included."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns[first - 1:last]])


def matching_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of the files a pattern matches (for the few wide rule tables)."""
    files = spark.read.text(pattern).select(F.col("_metadata.file_path").alias("p")).distinct()
    return sorted(r.p for r in files.collect())


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The last version of a table that ``sinks.publish`` has made visible."""
    entry = sinks.last_entry(spark, path)
    if entry is None:
        raise ValueError(f"{path}: nothing published")
    return spark.read.schema(StructType.fromJson(entry["schema"])).parquet(f"{path.rstrip('/')}/{entry['data']}")
