"""The whole study on its own input files.

:class:`Study` takes the input tables and offers every result as a property.
Nothing runs until a result is used, apart from the tables that several results
share, which are written once to the shared folder.  :func:`load` reads the
inputs from a folder, :func:`write_results` writes every result.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims, units
from ..functions import fixed_values as fv
from ..functions import keys as k
from ..functions import semantics as sem
from ..operators import apportion, curve, flow, impact, report, windows
from ..operators.running import stage
from ..sources import readers, sinks, tables

#: input name -> path under the data folder; override with ``load(layout=...)``
LAYOUT = {
    "baseline": "seasonal/optimal/result.dat",
    "scenarios": "seasonal/scenarios",
    "daily": "daily/optimal/daily_result.dat",
    "window_demand": "window_demand.csv",
    "windows": "scenario_windows.csv",
    "grids": "crop_grids.csv",
    "efficiency": "irrigation_efficiency.csv",
    "moisture": "moisture.csv",
    "prices": "prices.csv",
    "water_rights": "water_rights.csv",
    "fields": "field_grids.csv",
    "interruptible": "interruptible.csv",
    "outlets_first": "station_outlets_v1.csv",
    "cells_first": "station_cells_v1.csv",
    "outlets_second": "station_outlets_v2.csv",
    "cells_second": "station_cells_v2.csv",
    "gauges": "gauges.csv",
    "rule_gauges": "rule_gauges.csv",
    "calendar": "calendar.csv",
    "rules": "rules/*.csv",
    "discharge": "discharge.csv",
    "basin_grids": "basin/crop_grids.csv",
    "basin_baseline": "basin/optimal/result.dat",
    "basin_scenarios": "basin/scenarios",
}

GRID_KEYS = ["crop", "site", "region", "Irrigation"]
COMPARED_KEYS = ["Year", *GRID_KEYS, "planting_date"]
CELL_KEYS = ["crop", "region", "site", "lat", "long", "Grid_Number"]
FLOW_KEYS = ["SITENAME", "Year", "simulation"]


# --- stages shared by the study and the single basin --------------------------------
def with_grid_factors(rows: DataFrame, grids: DataFrame, *, positive: bool, complete: bool
                      ) -> DataFrame:
    """Net irrigation and wet yield; one row per irrigation type of the grid."""
    factors = grids.select("crop", "site", "region", "Irrigation", "ML_Fraction", "WM_ML_factor")
    rows = rows.join(factors, ["crop", "site", "region"], "left").withColumns({
        "irrig": F.col("irrig") * F.col("ML_Fraction"),
        "WM_yield_kgha": F.col("yield_kgha") * F.col("WM_ML_factor")})
    if positive:
        rows = rows.where(F.col("irrig") > 0)
    return sem.complete_cases(rows) if complete else rows


def baseline_values(baseline: DataFrame, grids: DataFrame, prices: DataFrame,
                    grid_columns: list[str], *, distinct: bool) -> DataFrame:
    """Area, sold units and return of the baseline, for the priced crops."""
    acreage = grids.select(*GRID_KEYS, *grid_columns)
    rows = baseline.select(
        *GRID_KEYS, "Year", "planting_date", "harvest_date", "yield_kgha", "WM_yield_kgha",
        "irrig", "simulation", "ML_Fraction", "WM_ML_factor",
        F.col("irrig").alias("irrig_optimal_mm"),
        F.col("WM_yield_kgha").alias("WM_yield_optimal_kgha"))
    rows = rows.join(acreage, GRID_KEYS, "left")
    rows = rows.withColumn("area_ha_opt", units.hectares("Acres")).withColumns({
        "total_WM_yield_optimal_kg": F.col("WM_yield_kgha") * F.col("area_ha_opt"),
        "total_irrig_mm_opt": F.col("irrig") * F.col("area_ha_opt"),
        "harvest_date": k.day_of_season("harvest_date")})
    rows = sem.complete_cases(rows).where(sem.not_in_values("crop", fv.UNPRICED_CROPS))
    rows = impact.price_outcome(rows, prices, "total_WM_yield_optimal_kg",
                                units_out="sold_unit_opt", value_out="Total_economic_return_opt")
    return rows.distinct() if distinct else rows


def compared(rows: DataFrame, baseline: DataFrame, prices: DataFrame, keys: list[str],
             grid_columns: list[str]) -> DataFrame:
    """Every scenario and baseline row against the baseline, valued.

    Rows with a missing input drop, as do rows whose percentages would be 0/0;
    a percentage over a zero baseline is NULL but its row stays.
    """
    reference = baseline.select(
        *keys, *grid_columns, "irrig_optimal_mm", "WM_yield_optimal_kgha",
        "total_WM_yield_optimal_kg", "sold_unit_opt", "Total_economic_return_opt")
    own = rows.select(*keys, *[c for c in (
        "planting_date", "harvest_date", "yield", "used_biomass", "yield_kgha", "WM_yield_kgha",
        "irrig", "simulation", "Irrigation", "ML_Fraction") if c not in keys])
    # A row without a baseline has missing values and is dropped below.
    out = impact.impact_vs_baseline(
        own, reference, keys, supply="irrig", base_supply="irrig_optimal_mm",
        output="WM_yield_kgha", base_output="WM_yield_optimal_kgha",
        total=F.col("WM_yield_kgha") * units.hectares("Acres"),
        base_total="total_WM_yield_optimal_kg")
    out = out.withColumns({
        "area_ft2": units.square_feet("Acres"),
        "streamflow_aug_ft": units.mm_to_feet("streamflow_aug_mm"),
        "streamflow_aug_acrft": units.mm_to_acre_feet("streamflow_aug_mm", "Acres"),
        "streamflow_aug_cfs": units.cubic_feet_to_cfs(
            units.mm_to_cubic_feet("streamflow_aug_mm", "Acres")),
        "total_WM_yield_kg": F.col("WM_yield_kgha") * units.hectares("Acres")})
    out = impact.price_outcome(out, prices, "total_WM_yield_kg", units_out="sold_unit_shut",
                               value_out="Total_economic_return_shut")
    out = out.withColumn("Revenue_loss", F.col("Total_economic_return_opt")
                         - F.col("Total_economic_return_shut"))
    percents = {"Percentage_irrig", "Per_irrig_saved", "Percentage_yield", "Per_yield_reduction"}
    out = sem.complete_cases(out, [c for c in out.columns if c not in percents])
    for part, whole in (("irrig", "irrig_optimal_mm"),
                        ("WM_yield_kgha", "WM_yield_optimal_kgha")):
        out = out.where((F.col(part) != 0) | (F.col(whole) != 0))
    return out


# --- the study -------------------------------------------------------------------------
@dataclass(frozen=True)
class Inputs:
    """Input tables as the readers return them."""

    baseline: DataFrame
    scenarios: DataFrame
    window_demand: DataFrame
    grids: DataFrame
    prices: DataFrame
    water_rights: DataFrame
    fields: DataFrame
    interruptible: DataFrame
    bridge: DataFrame
    gauges: DataFrame
    rules: DataFrame
    discharge: DataFrame


class Study:
    def __init__(self, inputs: Inputs) -> None:
        self.inputs = inputs
        self.spark = inputs.baseline.sparkSession

    # --- impact -------------------------------------------------------------------
    @cached_property
    def baseline(self) -> DataFrame:
        rows = impact.unify_yield(self.inputs.baseline)
        return stage(with_grid_factors(rows, self.inputs.grids, positive=True, complete=True),
                     "baseline")

    @cached_property
    def baseline_returns(self) -> DataFrame:
        return stage(baseline_values(
            self.baseline, self.inputs.grids, self.inputs.prices,
            ["Grid_Number", "Acres", "CropArea", "lat", "long", "WR_DOC_ID"], distinct=True),
            "baseline_returns")

    @property
    def scenario_rows(self) -> DataFrame:
        """Scenario and baseline rows without repeats.

        Partitioned by the comparison keys first: the distinct and the comparison
        then share that one shuffle.  Rows of an unknown (crop, site, region, Year)
        need no filter of their own, the comparison drops them.
        """
        rows = with_grid_factors(impact.unify_yield(self.inputs.scenarios), self.inputs.grids,
                                 positive=True, complete=False)
        return rows.unionByName(self.baseline).repartition(*COMPARED_KEYS).distinct()

    @cached_property
    def impact(self) -> DataFrame:
        """Impact per crop, site, year and scenario, volumes from the daily demand.

        ``streamflow_aug_mm`` and ``_ft`` stay seasonal; ``_acrft`` and ``_cfs`` come
        from the window demand.
        """
        rows = compared(self.scenario_rows, self.baseline_returns, self.inputs.prices,
                        COMPARED_KEYS, ["Grid_Number", "Acres", "lat", "long"])
        rows = impact.clamp_impact(rows).join(
            self.inputs.window_demand, ["Year", "site", "crop", "region", "simulation"], "left")
        rows = rows.withColumns({
            "harvest_date1": k.day_of_season("harvest_date"),
            "irrigation_demand_mm": F.coalesce("irrigation_demand_mm", F.lit(0.0)),
            "Crop_site_region": k.composite_key("crop", "site", "region")})
        rows = rows.withColumns({
            "streamflow_aug_acrft": units.mm_to_acre_feet("irrigation_demand_mm", "Acres"),
            "streamflow_aug_ft3": units.mm_to_cubic_feet("irrigation_demand_mm", "Acres"),
        }).withColumn("streamflow_aug_cfs", units.cubic_feet_to_cfs("streamflow_aug_ft3"))
        return stage(impact.unit_costs(rows), "impact")

    @cached_property
    def panel_rows(self) -> DataFrame:
        """Scenario rows of the shown crops at the stations' sites, per-acre measures."""
        rows = sem.is_in_table(self.impact, self.inputs.bridge, {"site": "site"})
        rows = rows.where(F.col("simulation") != fv.BASELINE)
        rows = (rows.join(F.broadcast(dims.crop_display(self.spark)), "crop", "left")
                .join(F.broadcast(dims.scenario_labels(self.spark)), "simulation", "left"))
        rows = rows.where(sem.not_in_values("crop_name", fv.HIDDEN_CROPS)
                          & sem.in_values("crop_name", fv.PANEL_CROPS))
        sold_lost = F.col("sold_unit_opt") - F.col("sold_unit_shut")
        return rows.withColumns({
            "yield_loss_acre": sem.ratio("WM_yield_loss", "Acres"),
            "Production_loss_acre": sem.ratio(sold_lost, "Acres"),
            "Economic_return_ac": sem.ratio("Total_economic_return_shut", "Acres"),
            "Revenue_loss_acre": sem.ratio("Revenue_loss", "Acres"),
            "Production_acre": sem.ratio("sold_unit_shut", "Acres")})

    def _trimmed(self, by: str) -> DataFrame:
        if by == "Cost_acre":
            return self.panel_rows.where(F.col("Cost_acre") <= fv.MAX_COST_PER_ACRE)
        return self.panel_rows.where(F.col("Per_yield_reduction").between(*fv.REDUCTION_RANGE))

    def panel_medians(self, by: str = "Per_yield_reduction") -> DataFrame:
        return report.medians(self._trimmed(by), ["crop_name", "simulation_abb"],
                              ["Cost_acre", "Per_irrig_saved", "Per_yield_reduction",
                               "streamflow_aug_mm"])

    def panel_boxes(self, measure: str) -> DataFrame:
        limits = {"streamflow_aug_mm": (0, 250), "Per_yield_reduction": fv.REDUCTION_RANGE,
                  "Cost_acre": (0, fv.MAX_COST_PER_ACRE)}[measure]
        return report.box_summary(self._trimmed(measure), ["crop_name", "simulation_abb"],
                                  measure, limits=limits)

    # --- water rights and grids ----------------------------------------------------
    @cached_property
    def water_rights(self) -> DataFrame:
        """Rights with one date format."""
        rights = self.inputs.water_rights
        dashed = F.coalesce(F.col("PriorityDate").contains("-"), F.lit(False))
        return sem.null_safe_merge(
            rights.where(dashed).withColumn("PriorityDate", k.slashed_date("PriorityDate")),
            rights.where(~dashed))

    @cached_property
    def field_rights(self) -> DataFrame:
        """Uninterruptible fields with their grid's acreage and their share of it."""
        rights = self.water_rights
        grids = self.inputs.grids.select(*GRID_KEYS, "lat", "long", "Grid_Number", "Acres")
        fields = self.inputs.fields.withColumnsRenamed(
            {"field_lat": "own_lat", "field_long": "own_long"})
        fields = fields.join(grids, ["crop", "lat", "long", "Grid_Number", "region", "site"],
                             "left")
        fields = sem.is_in_table(fields, rights, {"WRIA": "WRIA"})
        fields = fields.join(rights, ["FID_WSDA", "crop", "lat", "long", "site", "WRIA"])
        fields = sem.complete_cases(fields).withColumn(
            "fraction_acres", sem.ratio("Acres_PF", "Acres"))
        return sem.not_in_table(fields, self.inputs.interruptible, {"WRDocID": "WR_Doc_ID"})

    @property
    def field_impact(self) -> DataFrame:
        """Impact of each uninterruptible field."""
        parts = self.field_rights.select(
            *GRID_KEYS, "lat", "long", "FID_WSDA", "Acres_PF", F.col("Acres").alias("grid_acres"),
            "PriorityDate", "WRDocID", "field_lat", "field_long")
        out = apportion.apportion_to_parts(
            self.impact, parts, [*GRID_KEYS, "lat", "long"], part_size="Acres_PF",
            whole_size="grid_acres", measures={
                "streamflow_aug_mm_fld": "streamflow_aug_mm",
                "streamflow_aug_ft_fld": "streamflow_aug_ft",
                "streamflow_aug_acft_fld": "streamflow_aug_acrft",
                "streamflow_aug_cfs_fld": "streamflow_aug_cfs",
                "yield_gain_field": "total_WM_yield_kg", "yield_loss_fld": "WM_yield_loss",
                "Revenue_loss_fld": "Revenue_loss",
                "economic_return_fld": "Total_economic_return_shut",
                "Per_yield_reduction_fld": "Per_yield_reduction"})
        return out.withColumns({
            "cost_acft_fld": sem.ratio("Revenue_loss_fld", "streamflow_aug_acft_fld"),
            "cost_acre_fld": sem.ratio("Revenue_loss_fld", "Acres_PF")})

    @cached_property
    def non_interruptible(self) -> DataFrame:
        """Impact of the uninterruptible fields, back on grid rows."""
        measures = {"streamflow_aug_mm": "streamflow_aug_mm",
                    "streamflow_aug_ft": "streamflow_aug_ft",
                    "streamflow_aug_acrft": "streamflow_aug_acrft",
                    "streamflow_aug_cfs": "streamflow_aug_cfs",
                    "Total_Yield": "total_WM_yield_kg", "WM_yield_loss": "WM_yield_loss",
                    "Revenue_loss": "Revenue_loss",
                    "Total_economic_return_shut": "Total_economic_return_shut"}
        keys = [*GRID_KEYS, "lat", "long"]
        parts = self.field_rights.select(*keys, "Acres_PF", F.col("Acres").alias("grid_acres"))
        rows = apportion.rollup_parts(
            self.impact.where(F.col("simulation") != fv.BASELINE), parts, keys,
            part_size="Acres_PF", whole_size="grid_acres", measures=measures,
            size_out="Acres_PF", count_out="fields")
        # The mean grid acreage counts every field once.
        rows = rows.withColumn("_weighted", F.col("Acres") * F.col("fields"))
        out = apportion.rollup_grid(
            rows, [*CELL_KEYS, "Year", "simulation", "harvest_date1", "target_harvest_date"],
            {"Acres_PF": "Acres_PF", "_weighted": "_weighted", "_fields": "fields",
             **{m: m for m in measures}},
            {"Acres": ("_weighted", "_fields")})
        out = out.drop("_weighted", "_fields").withColumns({
            "cost_acrft": sem.ratio("Revenue_loss", "streamflow_aug_acrft"),
            "cost_acr": sem.ratio("Revenue_loss", "Acres")})
        return stage(out, "non_interruptible")

    @property
    def grid_totals(self) -> DataFrame:
        return apportion.rollup_grid(
            self.non_interruptible,
            ["region", "site", "lat", "long", "Grid_Number", "Year", "simulation"],
            {"T_Acres": "Acres", "Streamflow_aug_vol_acft": "streamflow_aug_acrft",
             "streamflow_aug_cfs": "streamflow_aug_cfs", "WM_Yield_loss": "WM_yield_loss",
             "T_Revenue_loss": "Revenue_loss"},
            {"cost_per_acft_v": ("T_Revenue_loss", "Streamflow_aug_vol_acft")})

    # --- supply curves -----------------------------------------------------------------
    @cached_property
    def curve_stations(self) -> DataFrame:
        """station, site of the stations that have a code, hence a curve."""
        coded = [short for _, short, code, _ in fv.STATIONS if code]
        return self.inputs.bridge.where(sem.in_values("station", coded)).select(
            F.col("station").alias("SITENAME"), "site").distinct()

    @cached_property
    def supply_curves(self) -> DataFrame:
        """Cost-ordered cumulative augmentation of every station."""
        points = self.non_interruptible.select(
            *CELL_KEYS, "Year", "simulation", "Acres", "streamflow_aug_mm", "streamflow_aug_ft",
            "streamflow_aug_acrft", "Revenue_loss", "cost_acrft", "cost_acr", "Total_Yield",
            "WM_yield_loss", "target_harvest_date", "harvest_date1")
        points = points.withColumn("region", k.merge_regions("region"))
        points = points.join(self.curve_stations, "site")
        return stage(curve.supply_curve(
            points, ["SITENAME", "simulation", "region", "Year"], cost="cost_acrft",
            volume="streamflow_aug_acrft",
            tie=["crop", "site", "lat", "long", "Grid_Number", "harvest_date1",
                 "target_harvest_date"]), "curves")

    def example_curves(self) -> DataFrame:
        return curve.curve_slice(self.supply_curves, SITENAME=fv.EXAMPLE_STATIONS,
                                 Year=fv.EXAMPLE_YEAR, simulation=fv.EXAMPLE_SCENARIOS)

    @property
    def crop_mix(self) -> DataFrame:
        """Acres and share per station and crop group."""
        first = fv.SCENARIO_WINDOWS[0][0]
        per_site = (self.non_interruptible.where(F.col("simulation") == first)
                    .groupBy("region", "crop", "site").agg(F.avg("Acres").alias("_mean")))
        groups = F.broadcast(dims.crop_groups(self.spark))
        acres = (per_site.join(groups, "crop")
                 .groupBy("site", "crop_group", "group_rank")
                 .agg(sem.sum_or_zero("_mean").alias("Acres"))
                 .join(self.curve_stations, "site")
                 .groupBy("SITENAME", "crop_group", "group_rank")
                 .agg(F.sum("Acres").alias("Acres")))
        return report.share_of_total(acres, ["SITENAME"], "Acres").withColumn(
            "group_thousand_ac", F.col("Acres") / 1000)

    @property
    def crop_mix_wide(self) -> DataFrame:
        return report.to_matrix(self.crop_mix, ["SITENAME"], "crop_group", "Acres",
                                fv.CROP_GROUP_ORDER)

    # --- flow ------------------------------------------------------------------------------
    @property
    def station_augmentation(self) -> DataFrame:
        """Augmentation per station, region, year and scenario with its gauge number."""
        sums = apportion.rollup_stations(
            self.grid_totals, self.curve_stations, ["region", "Year", "simulation"],
            {"Streamflow_aug_vol_acft": "Streamflow_aug_vol_acft",
             "streamflow_aug_cfs": "streamflow_aug_cfs"}, station="SITENAME")
        numbers = dims.stations(self.spark).select(F.col("station").alias("SITENAME"), "SITENO")
        return sums.join(F.broadcast(numbers), "SITENAME")

    @cached_property
    def verdicts(self) -> DataFrame:
        """Daily flow against the minimum-flow rule, with and without augmentation."""
        first, last = fv.FLOW_DAYS
        days = windows.tag_windows(
            self.inputs.discharge.where(F.col("DOY").between(first, last))
            .select("SITENO", "Year", "DOY", "Discharge_cfs"), "DOY")
        rules = self.inputs.rules.select("SITENO", "DOY", "MIFR_rules")
        gauges = self.inputs.gauges.select("SITENO").distinct()
        # A station's flow gains what all its regions save, so that it has one row per day.
        augmentation = self.station_augmentation.groupBy("SITENAME", "SITENO", "Year", "simulation").agg(
            F.sum("streamflow_aug_cfs").alias("streamflow_aug_cfs"))
        rows = (days.drop("start_date", "stop_date").join(rules, ["SITENO", "DOY"])
                .join(gauges, "SITENO", "left_semi")
                .join(augmentation, ["SITENO", "Year", "simulation"])
                .distinct())
        ranks = dims.stations(self.spark).select(
            F.col("station").alias("SITENAME"), "station_code", "station_rank")
        return stage(flow.deficit_days(rows).join(F.broadcast(ranks), "SITENAME"), "verdicts")

    @cached_property
    def need_runs(self) -> DataFrame:
        """Days in need with a neighbouring day in need, and the required pulse."""
        need = F.col("Aug_Need") == "Yes_Need"
        kept = flow.keep_groups_with(self.verdicts, FLOW_KEYS, need)
        runs = flow.consecutive_runs(kept, FLOW_KEYS, "DOY", where=need)
        return stage(flow.with_required_pulse(runs, FLOW_KEYS, "DOY", "MIFR_Dff"), "runs")

    @cached_property
    def augmentation_ratios(self) -> DataFrame:
        """Available over needed augmentation on the decisive day, with labels."""
        rows = flow.augmentation_ratio(self.need_runs.drop("Req_aug", "Req_aug_Acft",
                                                           "Fiftyp_aug"),
                                       FLOW_KEYS, "DOY", "MIFR_Dff", "streamflow_aug_cfs")
        return rows.join(F.broadcast(dims.scenario_labels(self.spark)), "simulation", "left")

    def ratio_boxes(self, measure: str = "RelativeRatioOfAug_adj") -> DataFrame:
        limits = (0, 1) if measure == "RelativeRatioOfAug_adj" else None
        return report.box_summary(self.augmentation_ratios, ["station_code", "simulation_half"],
                                  measure, limits=limits)

    @property
    def percent_met(self) -> DataFrame:
        """Percent of the need met per station, year and scenario, with bins."""
        rows = self.augmentation_ratios.where(
            sem.not_in_values("SITENAME", ["Monitor", "Peshastin"]))
        return report.percent_summary(
            rows, ["SITENAME", "station_code", "Year", "simulation", "simulation_half"],
            "Percentage_aug")

    @property
    def years_needing(self) -> DataFrame:
        """Percent of years needing augmentation: station code x half month."""
        rows = self.verdicts.where(F.col("station_code").isNotNull())
        return report.years_matrix(rows, "station_code", "simulation", "Year",
                                   F.col("Aug_Need") == "Yes_Need",
                                   labels={w[0]: w[4] for w in fv.SCENARIO_WINDOWS})

    # --- cost ------------------------------------------------------------------------------
    @cached_property
    def priced_needs(self) -> DataFrame:
        """Cost of the required pulse per station, year and scenario."""
        late = self.supply_curves.where(F.col("harvest_date1") > F.col("target_harvest_date"))
        # Cumulative volumes stay those of the full curve of each region.
        return stage(curve.curve_lookup(self.need_runs, late, FLOW_KEYS, amount="Req_aug_Acft", cost="cost_acrft",
                                        order=["region", "cost_acrft", "cum_streamflow"]), "priced")

    @property
    def priced_days(self) -> DataFrame:
        """Run days of the stations that have a curve, with their group's cost."""
        stations = self.supply_curves.where(
            F.col("harvest_date1") > F.col("target_harvest_date")).select("SITENAME").distinct()
        return (self.need_runs.join(stations, "SITENAME", "left_semi")
                .join(self.priced_needs, FLOW_KEYS))

    @cached_property
    def met_runs(self) -> DataFrame:
        """Priced days whose need can be met on two days in a row."""
        return stage(flow.consecutive_runs(self.priced_days, FLOW_KEYS, "DOY", unique=True,
                                           where=F.col("Can_meet_MIFR") == "YES"), "met")

    @property
    def mean_costs(self) -> DataFrame:
        """Mean cost per station and scenario, placeholders for empty axis cells."""
        tags = ["Aug_Need", "Can_meet_MIFR"]
        costs = report.mean_cost_matrix(self.met_runs, [*FLOW_KEYS, "station_code", *tags],
                                        ["SITENAME", "station_code", "simulation", *tags])
        labels = dims.scenario_labels(self.spark).select("simulation", "simulation_half")
        costs = costs.join(F.broadcast(labels), "simulation", "left")
        return report.with_placeholders(costs, dims.literal_table(
            self.spark, ["station_code", "simulation_half"], fv.COST_MATRIX_PLACEHOLDERS))

    @property
    def met_years(self) -> DataFrame:
        return report.met_year_counts(self.met_runs, ["SITENAME", "simulation"], "Year")


def window_demand(daily: DataFrame, baseline: DataFrame, scenario_windows: DataFrame
                  ) -> DataFrame:
    """Demand per window from the daily events of the baseline run.

    ``daily`` comes from ``readers.daily_events``; ``baseline`` supplies the harvest
    date of each (Year, region, crop, site).
    """
    harvest = baseline.select("Year", "region", "crop", "site",
                              k.day_of_season("harvest_date").alias("harvest_date"))
    keys = ["Year", "site", "crop", "region"]
    events = daily.drop("simulation").where(sem.not_in_values("region", fv.OTHER_REGIONS))
    return windows.window_demand(events.join(harvest, keys, "left"), keys, day="DOY",
                                 measure="irrig1", harvest="harvest_date",
                                 windows=scenario_windows)


# --- single basin -----------------------------------------------------------------------
@dataclass(frozen=True)
class BasinInputs:
    baseline: DataFrame
    scenarios: DataFrame
    grids: DataFrame
    prices: DataFrame


class Basin:
    """The single basin: no field apportioning, and a barter price from the curve."""

    def __init__(self, inputs: BasinInputs) -> None:
        self.inputs = inputs

    @cached_property
    def baseline(self) -> DataFrame:
        return stage(with_grid_factors(impact.unify_yield(self.inputs.baseline),
                                       self.inputs.grids, positive=False, complete=False),
                     "basin_baseline")

    @cached_property
    def baseline_returns(self) -> DataFrame:
        return stage(baseline_values(
            self.baseline, self.inputs.grids, self.inputs.prices,
            ["Grid_Number", "Acres", "CropArea", "HUC10_NAME", "lat", "long", "WR_DOC_ID"],
            distinct=False), "basin_returns")

    @cached_property
    def impact(self) -> DataFrame:
        rows = with_grid_factors(impact.unify_yield(self.inputs.scenarios), self.inputs.grids,
                                 positive=False, complete=True)
        rows = compared(rows.unionByName(self.baseline), self.baseline_returns, self.inputs.prices,
                        ["Year", "region", "crop", "site"],
                        ["Grid_Number", "Acres", "HUC10_NAME", "lat", "long"])
        rows = impact.unit_costs(impact.clamp_impact(rows), per_volume="cost_acrft",
                                 per_area="cost_acr")
        rows = rows.where((F.col("simulation") != fv.BASELINE)
                          & sem.not_in_values("crop", fv.UNPRICED_CROPS))
        return rows.withColumn("Crop_site_region", k.composite_key("crop", "site", "region"))

    @cached_property
    def supply_curve(self) -> DataFrame:
        """Curve of the rows harvested after the cut-off day."""
        points = self.impact.select(
            "region", "Year", "crop", "planting_date", k.day_of_season("harvest_date")
            .alias("harvest_date"), "site", "lat", "long", "simulation", "Irrigation", "Acres",
            "Grid_Number", "streamflow_aug_acrft", "streamflow_aug_cfs", "Percentage_irrig",
            "Per_irrig_saved", "Percentage_yield", "Per_yield_reduction", "Revenue_loss",
            "cost_acrft", "cost_acr").where(F.col("harvest_date") > fv.BASIN_HARVEST_CUTOFF)
        return stage(curve.supply_curve(
            points, ["simulation", "region", "Year"], cost="cost_acrft",
            volume="streamflow_aug_acrft",
            tie=["crop", "site", "Irrigation", "planting_date", "harvest_date", "Grid_Number",
                 "Acres", "streamflow_aug_acrft"]), "basin_curve")

    def barter(self, year: int = fv.EXAMPLE_YEAR, price: float = fv.BARTER_PRICE_PER_ACFT,
               target: float = fv.BARTER_TARGET_ACFT,
               cutoff: float = fv.BARTER_CUTOFF_ACFT) -> DataFrame:
        """Price per acre that the barter volume pays, and the target point's cost."""
        return curve.barter_price(curve.curve_slice(self.supply_curve, Year=year), ["Year"],
                                  price=price, target=target, cutoff=cutoff)


# --- files ---------------------------------------------------------------------------------
def load(spark: SparkSession, data: str, layout: Mapping[str, str] | None = None, *,
         daily: bool = False) -> Study:
    """Read the study's inputs from ``data``; ``layout`` overrides file paths.

    daily   take the window demand from the daily file rather than from a ready table
    """
    path = {n: f"{data.rstrip('/')}/{p}" for n, p in {**LAYOUT, **(layout or {})}.items()}
    efficiency = readers.read_table(spark, path["efficiency"], tables.IRRIGATION_EFFICIENCY)
    moisture = readers.read_table(spark, path["moisture"], tables.MOISTURE)
    bridges = [readers.read_station_cells(spark, path["cells_first"], path["outlets_first"],
                                          fv.FIRST_CELL_FILE_STATIONS),
               readers.read_station_cells(spark, path["cells_second"], path["outlets_second"],
                                          fv.SECOND_CELL_FILE_STATIONS)]
    rules = flow.threshold_rules(
        [readers.read_wide_rules(spark, p) for p in readers.matching_files(spark, path["rules"])],
        tables.RULE_IDS, readers.read_calendar(spark, path["calendar"]),
        readers.read_rule_gauges(spark, path["rule_gauges"]))
    inputs = Inputs(
        baseline=readers.read_baseline(spark, path["baseline"]),
        scenarios=readers.read_scenarios(spark, path["scenarios"]),
        window_demand=None if daily else readers.read_table(spark, path["window_demand"], tables.WINDOW_DEMAND),
        grids=readers.read_crop_grids(spark, path["grids"], efficiency, moisture),
        prices=readers.read_table(spark, path["prices"], tables.PRICE),
        water_rights=readers.read_water_rights(spark, path["water_rights"]),
        fields=readers.read_fields(spark, path["fields"]),
        interruptible=readers.read_table(spark, path["interruptible"], tables.INTERRUPTIBLE),
        bridge=reduce(DataFrame.unionByName, bridges),
        gauges=readers.read_gauges(spark, path["gauges"]),
        rules=rules,
        discharge=readers.read_discharge(spark, path["discharge"]))
    if daily:
        events = readers.read_daily_baseline(spark, path["daily"], inputs.grids)
        demand = window_demand(events, Study(inputs).baseline, readers.read_windows(spark, path["windows"]))
        inputs = replace(inputs, window_demand=stage(demand, "demand"))
    return Study(inputs)


def load_basin(spark: SparkSession, data: str, layout: Mapping[str, str] | None = None) -> Basin:
    path = {n: f"{data.rstrip('/')}/{p}" for n, p in {**LAYOUT, **(layout or {})}.items()}
    efficiency = readers.read_table(spark, path["efficiency"], tables.IRRIGATION_EFFICIENCY)
    moisture = readers.read_table(spark, path["moisture"], tables.MOISTURE)
    return Basin(BasinInputs(
        baseline=readers.read_baseline(spark, path["basin_baseline"]),
        scenarios=readers.read_scenarios(spark, path["basin_scenarios"]),
        grids=readers.read_basin_grids(spark, path["basin_grids"], efficiency, moisture),
        prices=readers.read_table(spark, path["prices"], tables.PRICE)))


def load_window_demand(spark: SparkSession, data: str,
                       layout: Mapping[str, str] | None = None) -> DataFrame:
    """Window demand from the daily file, for inputs that include one."""
    return load(spark, data, layout, daily=True).inputs.window_demand


def write_results(study: Study, out: str, basin: Basin | None = None) -> None:
    """Every result as Parquet; the years matrix as CSV as well."""
    results = {
        "window_demand": study.inputs.window_demand,
        "station_bridge": study.inputs.bridge,
        "impact": study.impact,
        "panel_medians": study.panel_medians(),
        "panel_cost_medians": study.panel_medians("Cost_acre"),
        **{f"boxes_{m}": study.panel_boxes(m)
           for m in ("streamflow_aug_mm", "Per_yield_reduction", "Cost_acre")},
        "non_interruptible": study.non_interruptible,
        "grid_totals": study.grid_totals,
        "supply_curves": study.supply_curves,
        "example_curves": study.example_curves(),
        "crop_mix": study.crop_mix,
        "crop_mix_wide": study.crop_mix_wide,
        "verdicts": study.verdicts,
        "need_runs": study.need_runs,
        "augmentation_ratios": study.augmentation_ratios,
        **{f"boxes_{m}": study.ratio_boxes(m)
           for m in ("RelativeRatioOfAug_adj", "streamflow_aug_cfs", "MaxOfTwo")},
        "percent_met": study.percent_met,
        "priced_days": study.priced_days,
        "mean_costs": study.mean_costs,
        "met_years": study.met_years,
    }
    if basin is not None:
        results |= {"basin_impact": basin.impact, "basin_supply_curve": basin.supply_curve, "basin_barter": basin.barter()}
    for name, df in results.items():
        renamed = df.toDF(*[c.replace(" ", "_") for c in df.columns])
        renamed.write.mode("overwrite").parquet(f"{out.rstrip('/')}/{name}")
    sinks.write_csv(study.years_needing, f"{out.rstrip('/')}/count_years", one_file=True)
