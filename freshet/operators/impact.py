"""Scenario against baseline: unify, compare, clamp, value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import fixed_values as fv
from ..functions.semantics import col, first_match, floor_to_zero, in_values, percent, ratio
from ..functions.units import clamp_above


def unify_measure(df: DataFrame, category: str,
                  groups: Mapping[str, tuple[Sequence[str], Column | str]], out: str,
                  group_out: str | None = None) -> DataFrame:
    """One output column from per-group source columns.

    ``groups`` maps a group name to (categories, source).  Rows in no group drop.
    """
    inside = {name: in_values(category, members) for name, (members, _) in groups.items()}
    label = first_match((inside[name], F.lit(name)) for name in groups)
    value = first_match((inside[name], col(source)) for name, (_, source) in groups.items())
    df = df.withColumn("_group", label).where(F.col("_group").isNotNull()).withColumn(out, value)
    return df.withColumnRenamed("_group", group_out) if group_out else df.drop("_group")


def unify_yield(df: DataFrame) -> DataFrame:
    """Grain crops report ``yield``, hay crops ``used_biomass``."""
    return unify_measure(df, "crop", {"grain": (fv.GRAIN_CROPS, "yield"),
                                      "hay": (fv.HAY_CROPS, "used_biomass")}, "yield_kgha")


def sold_units(df: DataFrame, kilograms: Column | str, out: str, *, category: str = "crop",
               units: DataFrame | None = None, factor: str = "units_per_kg") -> DataFrame:
    """Kilograms in the unit the category is sold in; 0 for a category without one.

    ``units`` has one row per category.  The fixed crop table is broadcast; a
    caller's table only if Spark finds it small enough.
    """
    if units is None:
        table = F.broadcast(dims.selling_units(df.sparkSession).select(
            F.col("crop").alias("_category"), F.col("units_per_kg").alias("_factor")))
    else:
        table = units.select(F.col(category).alias("_category"), F.col(factor).alias("_factor"))
    joined = df.join(table, F.col(category) == F.col("_category"), "left")
    return joined.withColumn(out, F.when(F.col("_factor").isNull(), F.lit(0.0))
                             .otherwise(col(kilograms) * F.col("_factor"))
                             ).drop("_category", "_factor")


def price_outcome(df: DataFrame, prices: DataFrame, quantity: Column | str, *,
                  category: str = "crop", price: str = "mean_Price",
                  units: DataFrame | None = None, factor: str = "units_per_kg",
                  units_out: str = "sold_unit", value_out: str = "economic_return") -> DataFrame:
    """Sold units and their value at the category's price."""
    df = sold_units(df, quantity, units_out, category=category, units=units, factor=factor)
    if price not in df.columns:
        df = df.join(prices, category, "left")
    return df.withColumn(value_out, F.col(units_out) * F.col(price))


def impact_vs_baseline(scenario: DataFrame, baseline: DataFrame, keys: Sequence[str], *,
                       supply: str, base_supply: str, output: str, base_output: str,
                       total: Column | str, base_total: Column | str, floor: float = 1.0,
                       saved_out: str = "streamflow_aug_mm", loss_out: str = "WM_yield_loss"
                       ) -> DataFrame:
    """Compare each scenario row with its baseline row (left join on ``keys``).

    Adds the supply saved and the output lost, both 0 under ``floor``, and the
    percentages of the baseline used, saved, kept and lost.  ``total`` and
    ``base_total`` are the area totals the loss is taken on.  Percentages are
    NULL for a zero baseline.
    """
    return compare_columns(
        scenario.join(baseline, list(keys), "left"), supply=supply, base_supply=base_supply,
        output=output, base_output=base_output, total=total, base_total=base_total, floor=floor,
        saved_out=saved_out, loss_out=loss_out)


def beside_baseline(rows: DataFrame, keys: Sequence[str], is_baseline: Column,
                    columns: Mapping[str, Column | str]) -> DataFrame:
    """Put the baseline's values on every row of its key, for one table of both.

    Equal to joining the baseline rows on ``keys``, but with a single shuffle and the
    table computed once.  A group holds one row per scenario; a second baseline
    row would have to multiply the others, so it fails.
    """
    group = Window.partitionBy(*keys)
    row = F.max(F.when(is_baseline, F.struct(*[col(c).alias(out) for out, c in columns.items()]))).over(group)
    several = F.count(F.when(is_baseline, 1)).over(group) > 1
    beside = rows.withColumn("_base", F.when(several, F.raise_error(F.lit(
        f"more than one baseline row for a key of {', '.join(keys)}"))).otherwise(row))
    return beside.withColumns({out: F.col("_base")[out] for out in columns}).drop("_base")


def compare_columns(df: DataFrame, *, supply: str, base_supply: str, output: str,
                    base_output: str, total: Column | str, base_total: Column | str,
                    floor: float = 1.0, saved_out: str = "streamflow_aug_mm",
                    loss_out: str = "WM_yield_loss") -> DataFrame:
    """The comparison of :func:`impact_vs_baseline` on rows that carry both sides."""
    return df.withColumns({
        saved_out: floor_to_zero(F.col(base_supply) - F.col(supply), floor),
        loss_out: floor_to_zero(col(base_total) - col(total), floor),
        "Percentage_irrig": percent(supply, base_supply),
        "Percentage_yield": percent(output, base_output),
    }).withColumns({
        "Per_irrig_saved": 100 - F.col("Percentage_irrig"),
        "Per_yield_reduction": 100 - F.col("Percentage_yield"),
    })


def clamp_impact(df: DataFrame, *, percent_output: str = "Percentage_yield",
                 volume: str = "streamflow_aug_acrft", loss: str = "WM_yield_loss",
                 value_loss: str = "Revenue_loss", smallest_volume: float = 0.01,
                 smallest_value: float = 1.0) -> DataFrame:
    """Remove artefacts of small numbers: gains count as no loss, dust as zero."""
    return df.withColumns({
        percent_output: clamp_above(percent_output, 100.0),
        volume: floor_to_zero(volume, smallest_volume),
        loss: floor_to_zero(loss, 0.0),
        value_loss: floor_to_zero(value_loss, smallest_value),
    })


def unit_costs(df: DataFrame, *, value_loss: str = "Revenue_loss",
               volume: str = "streamflow_aug_acrft", area: str = "Acres",
               per_volume: str = "Cost_acre_ft", per_area: str = "Cost_acre") -> DataFrame:
    return df.withColumns({per_volume: ratio(value_loss, volume),
                           per_area: ratio(value_loss, area)})
