"""Literal dimensions.  All are bounded by the code itself, so joins to them may
be broadcast unconditionally; every other join leaves the choice to Spark's own
size check (``autoBroadcastJoinThreshold`` and AQE run-time sizes)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixed_values as fv


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    return repr(value)


def literal_table(spark: SparkSession, columns: Sequence[str], rows: Sequence[Sequence]) -> DataFrame:
    """Inline table: stays in the plan as a local relation of known size."""
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(f"`{c}`" for c in columns)
    return spark.sql(f"SELECT * FROM VALUES {body} AS dim({names})")


def scenario_windows(spark: SparkSession) -> DataFrame:
    """simulation, start_date, stop_date, simulation_abb, simulation_half."""
    return literal_table(
        spark, ["simulation", "start_date", "stop_date", "simulation_abb", "simulation_half"],
        fv.SCENARIO_WINDOWS)


def scenario_days(spark: SparkSession, day: str = "DOY") -> DataFrame:
    """One row per (window, day of year): turns the range join into an equi join."""
    rows = [(d, name, start, stop)
            for name, start, stop, *_ in fv.SCENARIO_WINDOWS for d in range(start, stop + 1)]
    return literal_table(spark, [day, "simulation", "start_date", "stop_date"], rows)


def scenario_labels(spark: SparkSession) -> DataFrame:
    """simulation, simulation_abb, simulation_half, simulation_rank."""
    rows = [(w[0], w[3], w[4], i) for i, w in enumerate(fv.SCENARIO_WINDOWS, start=1)]
    return literal_table(
        spark, ["simulation", "simulation_abb", "simulation_half", "simulation_rank"], rows)


def selling_units(spark: SparkSession) -> DataFrame:
    """crop, unit_name, units_per_kg."""
    rows = [(c, "bushel", 1 / fv.KG_PER_BUSHEL) for c in fv.BUSHEL_CROPS]
    rows += [(c, "ton", fv.TON_PER_KG) for c in fv.TON_CROPS]
    rows += [(c, "cwt", fv.CWT_PER_KG) for c in fv.CWT_CROPS]
    return literal_table(spark, ["crop", "unit_name", "units_per_kg"], rows)


def crop_groups(spark: SparkSession) -> DataFrame:
    """crop, crop_kind (annual or hay), crop_group (display), group_rank."""
    rows = []
    for crop in fv.GRAIN_CROPS:
        group = "Corn and onion" if crop in fv.CORN_AND_ONION else "Grain crops"
        rows.append((crop, "Annual_crop", group))
    rows += [(crop, "Hay_crop", "Hay crops") for crop in fv.HAY_CROPS]
    rank = {g: i for i, g in enumerate(fv.CROP_GROUP_ORDER, start=1)}
    return literal_table(spark, ["crop", "crop_kind", "crop_group", "group_rank"],
                         [(*r, rank[r[2]]) for r in rows])


def crop_display(spark: SparkSession) -> DataFrame:
    """crop, crop_name (display), crop_rank."""
    rank = {c: i for i, c in enumerate(fv.CROP_DISPLAY_ORDER, start=1)}
    rows = [(c, fv.CROP_DISPLAY_NAMES.get(c, c)) for c in fv.GRAIN_CROPS + fv.HAY_CROPS]
    return literal_table(spark, ["crop", "crop_name", "crop_rank"],
                         [(c, name, rank[name]) for c, name in rows])


def category(spark: SparkSession, column: str, orders: dict[str, Sequence[str]]) -> DataFrame:
    """An ordered category with several orders: every label, and its place in each order (NULL: not in it)."""
    places = {name: {label: i for i, label in enumerate(order, start=1)} for name, order in orders.items()}
    labels = list(dict.fromkeys(label for order in orders.values() for label in order))
    return literal_table(spark, [column, *places], [(x, *[p.get(x) for p in places.values()]) for x in labels])


def ranked(df: DataFrame, column: str, orders: dict[str, Sequence[str]]) -> DataFrame:
    """Add the places of ``column`` in each order; other labels have none, and sort behind with ``asc_nulls_last``."""
    return df.join(F.broadcast(category(df.sparkSession, column, orders)), column, "left")


def stations(spark: SparkSession) -> DataFrame:
    """station_name (long), station, station_code, SITENO, and the station's place in each order.

    ``station_code`` is NULL where a station has no code.  ``station_rank`` and ``ratio_rank`` are display
    positions of the code, or of the short name where there is none; ``name_rank`` is that of the short name.
    """
    place = lambda order: {c: i for i, c in enumerate(order, start=1)}
    rank, name_rank, ratio_rank = map(place, (fv.STATION_CODE_ORDER, fv.STATION_NAME_ORDER, fv.STATION_RATIO_ORDER))
    rows = [(name, short, code, number, rank[code or short], name_rank[short], ratio_rank[code or short])
            for name, short, code, number in fv.STATIONS]
    return literal_table(spark, ["station_name", "station", "station_code", "SITENO", "station_rank", "name_rank",
                                 "ratio_rank"], rows)
