"""The whole study on generated files, against an independent pandas model."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from study_files import SITES, YEARS, site_id, write_study

from freshet.functions import fixed_values as fv
from freshet.plans import study as plans
from freshet.plans.study import LAYOUT

CODED = {"TR_Dayton": "32E050", "WR_Detour_Rd": "32A100", "Malott": "12447200"}
CELLS = {"TR_Dayton": [0], "WR_Detour_Rd": [0, 1, 2], "Malott": [3, 4, 5]}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return write_study(tmp_path_factory.mktemp("study"))


@pytest.fixture(scope="module")
def study(spark, root):
    return plans.load(spark, str(root))


@pytest.fixture(scope="module")
def model(root):
    """The same results with eager pandas steps."""
    read = lambda name, **kw: pd.read_csv(root / LAYOUT[name], **kw)
    grids = (read("grids", dtype={"lat": str, "long": str}).merge(read("efficiency"))
             .merge(read("moisture")))
    grids = grids[grids.region.isin(["WallaWalla", "Okanogan", "Methow"])]
    prices = read("prices").rename(columns={"Mean_price_2020_2023": "price"})

    def season(path, name):
        df = pd.read_csv(path, sep="\t", dtype={"planting_date": str, "harvest_date": str})
        df["Year"] = df["YYYY-MM-DD(DOY)"].str.split("-").str[0].astype(int)
        df = df[df.crop.isin(fv.GRAIN_CROPS + fv.HAY_CROPS)].copy()
        df["y"] = np.where(df.crop.isin(fv.GRAIN_CROPS), df["yield"], df.used_biomass)
        df["simulation"] = name
        df = df.merge(grids[["crop", "site", "region", "Irrigation", "ML_Fraction",
                             "WM_ML_factor"]], how="left")
        df["irrig"] *= df.ML_Fraction
        df["wet"] = df.y * df.WM_ML_factor
        return df[df.irrig > 0]

    base = season(root / LAYOUT["baseline"], "optimal").dropna()

    def units(crop, kg):
        return np.select([crop.isin(fv.BUSHEL_CROPS), crop.isin(fv.TON_CROPS),
                          crop.isin(fv.CWT_CROPS)], [kg / 25.40, kg * 0.001, kg * 0.019], 0.0)

    value = base.merge(grids[["crop", "site", "region", "Irrigation", "Grid_Number", "Acres",
                              "lat", "long"]])
    value = value[~value.crop.isin(["Alfalfa_Seed", "Rye"])].merge(prices[["crop", "price"]])
    value["total0"] = value.wet * value.Acres * 0.405
    value["ret0"] = units(value.crop, value.total0) * value.price
    value = value.rename(columns={"irrig": "irrig0", "wet": "wet0"})
    rows = pd.concat([base] + [season(root / LAYOUT["scenarios"] / n / "result.dat", n)
                               for n, *_ in fv.SCENARIO_WINDOWS])
    keys = ["Year", "crop", "planting_date", "region", "site", "Irrigation"]
    t = rows.merge(value[[*keys, "Grid_Number", "Acres", "lat", "long", "irrig0", "wet0",
                          "total0", "ret0", "price"]], on=keys).dropna()
    t["mm"] = (t.irrig0 - t.irrig).where(lambda s: s >= 1, 0)
    t["total"] = t.wet * t.Acres * 0.405
    t["loss"] = (t.total0 - t.total).where(lambda s: s >= 1, 0)
    t["rev"] = (t.ret0 - units(t.crop, t.total) * t.price).where(lambda s: s >= 1, 0)
    t["red"] = 100 - t.wet / t.wet0 * 100
    t = t.merge(read("window_demand"), how="left")
    t["demand"] = t.irrigation_demand_mm.fillna(0)
    t["acft"] = t.demand * 0.00328084 * t.Acres
    t["cfs"] = t.acft * 43560 / (86400 * 15)
    t["harvest"] = t.harvest_date.str[4:].astype(int)

    fields = read("fields", dtype={"lat": str, "long": str}).rename(
        columns={"Crop_Name": "crop", "Acres": "part"})
    rights = read("water_rights", dtype={"join_lat": str, "join_lon": str}).rename(
        columns={"OBJECTID_1": "FID_WSDA"})
    rights = rights[rights.PriorityDa.notna()]
    rights = rights[~rights.WRDocID.isin(read("interruptible").WR_Doc_ID)]
    fields = fields.merge(rights[["FID_WSDA", "WRDocID"]])
    f = t[t.simulation != "optimal"].merge(
        fields[["crop", "site", "region", "part"]], on=["crop", "site", "region"])
    f["share"] = f.part / f.Acres
    for c in ("acft", "cfs", "rev", "loss"):
        f[c] *= f.share
    cell = ["crop", "region", "site", "Grid_Number", "Year", "simulation", "harvest",
            "target_harvest_date"]
    grid = f.groupby(cell, dropna=False).agg(
        part=("part", "sum"), Acres=("Acres", "mean"), acft=("acft", "sum"), cfs=("cfs", "sum"),
        rev=("rev", "sum"), loss=("loss", "sum")).reset_index()
    grid["cost"] = (grid.rev / grid.acft.replace(0, np.nan))

    curves, flows = [], []
    for name, cells in CELLS.items():
        own = grid[grid.site.isin([site_id(*SITES[i]) for i in cells])]
        flows.append(own.groupby(["Year", "simulation"], as_index=False).cfs.sum()
                     .assign(SITENAME=name))
        c = own.dropna(subset=["cost", "target_harvest_date"]).sort_values(
            ["cost", "crop", "site"])
        c = c.assign(SITENAME=name, cum=c.groupby(["simulation", "region", "Year"]).acft.cumsum())
        curves.append(c)
    curves, flows = pd.concat(curves), pd.concat(flows)

    q = read("discharge", dtype={"site_no": str})
    q["site_no"] = q.site_no.replace("3.20E+51", "32E050")
    days = {d: n for n, a, b, *_ in fv.SCENARIO_WINDOWS for d in range(a, b + 1)}
    q = q[q.DOY.isin(days)].assign(simulation=lambda d: d.DOY.map(days))
    q["SITENAME"] = q.site_no.map({v: k for k, v in CODED.items()})
    calendar = read("calendar")
    rules = []
    for file, columns in (("walla", {"N.F.Touchet": "TR_Dayton", "Detour": "WR_Detour_Rd"}),
                          ("okanogan", {"Malott": "Malott"})):
        wide = pd.read_csv(root / f"rules/{file}.csv", dtype=str)
        long = wide.melt(["Month", "Start_date", "End_date"], list(columns))
        long["SITENAME"] = long.variable.map(columns)
        long["rule"] = long.value.str.replace(r" \(.*\)", "", regex=True).str.replace(
            ",", "").astype(float)
        rules.append(long.merge(calendar.astype({"Start_date": str, "End_date": str})))
    v = q.merge(pd.concat(rules)[["SITENAME", "DOY", "rule"]]).merge(
        flows, on=["SITENAME", "Year", "simulation"])
    v["gap"] = v.rule - v.Discharge_cfs
    v["need"] = v.gap > 0
    v["can"] = v.need & (v.cfs + v.Discharge_cfs > v.rule)

    def runs(df):
        out = []
        for _, g in df.groupby(["SITENAME", "Year", "simulation"]):
            have = set(g.DOY)
            out.append(g[[d - 1 in have or d + 1 in have for d in g.DOY]])
        return pd.concat(out)

    need = runs(v[v.need])
    priced = []
    for (s, y, w), g in need.groupby(["SITENAME", "Year", "simulation"]):
        gap = dict(zip(g.DOY, g.gap))
        pairs = [(gap[d] + gap[d - 1], max(gap[d], gap[d - 1])) for d in gap if d - 1 in gap]
        pulse = max(m for total, m in pairs if total == min(p[0] for p in pairs))
        want = pulse * 86400 * 15 / 43560
        c = curves[(curves.SITENAME == s) & (curves.Year == y) & (curves.simulation == w)
                   & (curves.harvest > curves.target_harvest_date)].sort_values(["cost", "cum"])
        cost = volume = 0.0
        if len(c):
            reach = c[c.cum >= want]
            cost = reach.cost.iloc[0] if len(reach) else c.cost.iloc[-1]
            volume = reach.cum.iloc[0] if len(reach) else want
        acres = c[(c.cost <= cost) & (c.cum <= volume)].Acres.sum()
        priced.append((s, y, w, pulse, cost, volume, acres, cost * want))
    priced = pd.DataFrame(priced, columns=["SITENAME", "Year", "simulation", "pulse", "cost",
                                           "volume", "acres", "total"])
    met = runs(need[need.can]).merge(priced)
    return SimpleNamespace(impact=t, grid=grid, curves=curves, flows=flows, verdicts=v, need=need,
                           priced=priced, met=met)


def same(spark_df, model_df, keys, columns):
    """Equal rows by key, columns given as {ours: model}."""
    a = spark_df.select(*keys, *columns).toPandas()
    b = model_df[[*keys, *columns.values()]].rename(columns={m: o for o, m in columns.items()})
    assert len(a) == len(b) > 0
    assert not a.duplicated(keys).any() and not b.duplicated(keys).any()
    both = a.merge(b, on=keys, suffixes=("", "_model"))
    assert len(both) == len(a)
    for c in columns:
        x, y = both[c], both[f"{c}_model"]
        if x.dtype == object or x.dtype == bool:
            assert (x == y).all(), c
        else:
            np.testing.assert_allclose(x.astype(float), y.astype(float), rtol=1e-9, atol=1e-9,
                                       err_msg=c)


def test_impact(study, model):
    same(study.impact, model.impact, ["Year", "crop", "site", "Irrigation", "simulation"],
         {"streamflow_aug_mm": "mm", "WM_yield_loss": "loss", "Revenue_loss": "rev",
          "streamflow_aug_acrft": "acft", "streamflow_aug_cfs": "cfs", "harvest_date1": "harvest",
          "irrigation_demand_mm": "demand", "Per_yield_reduction": "red"})


def test_non_interruptible(study, model):
    same(study.non_interruptible, model.grid, ["Year", "crop", "site", "simulation"],
         {"Acres_PF": "part", "Acres": "Acres", "streamflow_aug_acrft": "acft",
          "streamflow_aug_cfs": "cfs", "Revenue_loss": "rev", "WM_yield_loss": "loss",
          "cost_acrft": "cost"})


def test_field_impact_sums_to_grid(study):
    fields = study.field_impact.toPandas()
    fields = fields[fields.simulation != "optimal"]
    grid = study.non_interruptible.toPandas()
    assert fields.Revenue_loss_fld.sum() == pytest.approx(grid.Revenue_loss.sum())
    assert fields.streamflow_aug_acft_fld.sum() == pytest.approx(grid.streamflow_aug_acrft.sum())


def test_supply_curves(study, model):
    same(study.supply_curves, model.curves, ["SITENAME", "Year", "simulation", "crop", "site"],
         {"cost_acrft": "cost", "cum_streamflow": "cum"})


def test_example_curves(study):
    got = study.example_curves().toPandas()
    assert set(got.Year) == {2015} and set(got.SITENAME) == {"Malott"}
    assert set(got.simulation) <= set(fv.EXAMPLE_SCENARIOS)


def test_crop_mix(study, model):
    got = study.crop_mix.toPandas()
    assert set(got.SITENAME) == set(CELLS)
    for _, g in got.groupby("SITENAME"):
        assert g.Percentage.sum() == pytest.approx(100, abs=0.2)
    first = model.grid[model.grid.simulation == "Scenario01"]
    first = first[first.site.isin([site_id(*SITES[i]) for i in CELLS["Malott"]])]
    want = first.groupby(["crop", "site"]).Acres.mean().sum()
    assert got[got.SITENAME == "Malott"].Acres.sum() == pytest.approx(want)
    wide = study.crop_mix_wide.toPandas().set_index("SITENAME")
    assert list(wide.columns) == fv.CROP_GROUP_ORDER
    assert wide.loc["Malott"].sum() == pytest.approx(want)


def test_station_augmentation(study, model):
    same(study.station_augmentation, model.flows, ["SITENAME", "Year", "simulation"],
         {"streamflow_aug_cfs": "cfs"})


def test_verdicts(study, model):
    v = model.verdicts.assign(can=np.where(model.verdicts.can, "YES", "NO"),
                              need=np.where(model.verdicts.need, "Yes_Need", "Not_Need"))
    same(study.verdicts, v, ["SITENAME", "Year", "DOY"],
         {"MIFR_rules": "rule", "streamflow_aug_cfs": "cfs", "Can_meet_MIFR": "can",
          "Aug_Need": "need", "MIFR_Dff": "gap", "simulation": "simulation"})
    assert set(v.can) == {"YES", "NO"}


def test_runs_and_pulse(study, model):
    same(study.need_runs, model.need.merge(model.priced), ["SITENAME", "Year", "DOY"],
         {"MIFR_Dff": "gap", "Req_aug": "pulse"})


def test_priced_needs(study, model):
    same(study.priced_needs, model.priced, ["SITENAME", "Year", "simulation"],
         {"MC_Cost": "cost", "nearest_cum_stream": "volume", "Contributing_acres": "acres",
          "Total_Cost": "total"})
    assert {r.meets_need for r in study.priced_needs.collect()} >= {"YES", "NO"}


def test_met_runs_and_costs(study, model):
    same(study.met_runs, model.met, ["SITENAME", "Year", "DOY"], {"Total_Cost": "total"})
    costs = study.mean_costs.toPandas()
    blank = costs[costs.Total_Cost.isna()]
    assert sorted(blank.station_code) == ["OKATO", "TWITW"]
    yearly = model.met.groupby(["SITENAME", "simulation", "Year"]).total.mean()
    want = yearly.groupby(["SITENAME", "simulation"]).mean().round()
    got = costs.dropna(subset=["Total_Cost"]).set_index(["SITENAME", "simulation"]).Total_Cost
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_names=False)
    years = study.met_years.toPandas().set_index(["SITENAME", "simulation"]).met_years
    want = model.met.groupby(["SITENAME", "simulation"]).Year.nunique()
    pd.testing.assert_series_equal(years.sort_index(), want.sort_index(), check_names=False,
                                   check_dtype=False)


def test_ratios_and_percent(study):
    ratios = study.augmentation_ratios.toPandas()
    assert len(ratios) and ratios.RelativeRatioOfAug_adj.max() <= 1
    assert ratios.simulation_half.notna().all() and ratios.station_code.notna().all()
    met = study.percent_met.toPandas()
    assert set(met.Percent_max_1) <= {"[0, 25]", "(25, 50]", "(50, 75]", "(75, 100)", "100", "0"}
    assert (met.Percen_min <= met.Percen_med).all() and (met.Percen_med <= met.Percen_max).all()


def test_years_needing(study, model):
    got = study.years_needing.toPandas().set_index("station_code")
    assert list(got.columns) == [w[4] for w in fv.SCENARIO_WINDOWS]
    need = model.verdicts[model.verdicts.need & (model.verdicts.SITENAME == "Malott")]
    want = (need.groupby("simulation").Year.nunique() / len(YEARS) * 100).round(1)
    for name, *_, label in fv.SCENARIO_WINDOWS:
        assert got.loc["OKAMA", label] == want.get(name)


def test_panels(study):
    rows = study.panel_rows.toPandas()
    assert set(rows.crop_name) == {"Alfalfa Hay", "Corn Grain", "Spring Wheat", "Onion"}
    assert set(rows.simulation_abb) == {w[3] for w in fv.SCENARIO_WINDOWS}
    medians = study.panel_medians().toPandas().set_index(["crop_name", "simulation_abb"])
    kept = rows[rows.Per_yield_reduction.between(0, 40)]
    want = kept.groupby(["crop_name", "simulation_abb"]).streamflow_aug_mm.median()
    pd.testing.assert_series_equal(medians.streamflow_aug_mm.sort_index(), want.sort_index(),
                                   check_names=False)
    for measure in ("streamflow_aug_mm", "Per_yield_reduction", "Cost_acre"):
        boxes = study.panel_boxes(measure).toPandas()
        assert len(boxes) and (boxes.lower <= boxes.upper).all()


def test_window_demand_from_daily_file(spark, root, study):
    got = plans.load_window_demand(spark, str(root)).toPandas()
    daily = pd.read_csv(root / LAYOUT["daily"], sep="\t").rename(
        columns={"DOY ": "DOY", "Irrigation cum(timestep)": "mm"})
    base = study.baseline.toPandas()
    base["harvest"] = base.harvest_date.str[4:].astype(int)
    daily = daily[(daily.mm > 0) & daily.DOY.between(55, 241) & (daily.crop != "Kelp")]
    grids = study.inputs.grids.toPandas()
    daily = daily.merge(grids[["crop", "site", "region", "ML_Fraction"]])
    daily = daily.merge(base[["Year", "region", "crop", "site", "harvest"]])
    total = {}
    for r in daily.itertuples():
        for name, start, stop, *_ in fv.SCENARIO_WINDOWS:
            if start <= r.DOY <= stop:
                key = (r.Year, r.site, r.crop, name)
                kept = 0 if start <= r.harvest <= start + 5 else r.mm * r.ML_Fraction
                total[key] = total.get(key, 0) + kept
    have = {(r.Year, r.site, r.crop, r.simulation): r.irrigation_demand_mm
            for r in got.itertuples()}
    assert set(have) == set(total)
    assert all(have[key] == pytest.approx(total[key]) for key in total)


def test_basin(spark, root):
    basin = plans.load_basin(spark, str(root))
    got = basin.supply_curve.orderBy("Year", "cost_acrft").toPandas()
    assert set(got.crop) == {"Corn_grain", "Alfalfa_Hay"}   # onion is harvested on day 170
    saved = {"Corn_grain": (400 * 0.95 * 0.1, 40.5), "Alfalfa_Hay": (400 * 0.85 * 0.2, 70.0)}
    for r in got.itertuples():
        mm, acres = saved[r.crop]
        assert r.streamflow_aug_acrft == pytest.approx(mm * 0.00328084 * acres)
    for _, g in got.groupby("Year"):
        assert g.cum_streamflow.tolist() == pytest.approx(g.streamflow_aug_acrft.cumsum())
    barter = basin.barter(cutoff=1e6).first()
    assert barter.acres == pytest.approx(110.5)
    assert barter.price_per_acre == pytest.approx(17.87 * 115.74 / 110.5)
    assert barter.target_cost == pytest.approx(got[got.Year == 2015].cost_acrft.max())


def test_write_results(spark, root, study, tmp_path):
    plans.write_results(study, str(tmp_path), plans.load_basin(spark, str(root)))
    table = spark.read.csv(f"{tmp_path}/count_years", header=True)
    assert table.columns[0] == "station_code" and table.count() == 3
    assert spark.read.parquet(f"{tmp_path}/supply_curves").count() == study.supply_curves.count()


def test_distinct_and_comparison_share_a_shuffle(spark, study):
    """The scenario side is shuffled once for its distinct and its comparison."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = study.baseline_returns.select(*plans.COMPARED_KEYS, "Acres")
        joined = study.scenario_rows.join(base, plans.COMPARED_KEYS, "left")
        text = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    top = text[:text.index("Union")]
    assert top.count("Exchange") == 1 and "REPARTITION_BY_COL" in top


def test_demand_from_the_daily_file(spark, root):
    """The command line's --daily: the same table as computed on its own."""
    study = plans.load(spark, str(root), daily=True)
    assert study.inputs.window_demand.count() > 0
    ready = plans.load(spark, str(root)).inputs.window_demand
    assert set(ready.columns) <= set(study.inputs.window_demand.columns)
