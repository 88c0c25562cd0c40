"""Properties that hold whatever the data, on the smallest test tables."""

import pandas as pd
import pytest

from freshet.plans import testdata

SF_DIR = "/root/testdata/sf0.001"
QUERIES = testdata.registered()


def frame(spark, name) -> pd.DataFrame:
    return QUERIES[name](spark, SF_DIR).toPandas()


def test_curves_only_grow_and_end_at_the_group_sum(spark):
    curve = frame(spark, "supply_curve").sort_values(["cost_acrft", "site"])
    for _, g in curve.groupby(["region", "Year", "simulation"]):
        assert g.cost_acrft.is_monotonic_increasing and g.cum_streamflow.is_monotonic_increasing
        assert g.cum_streamflow.iloc[-1] == pytest.approx(g.streamflow_aug_acrft.sum())


def test_a_met_need_is_reached_by_its_step(spark):
    priced = frame(spark, "curve_lookup")
    met, missed = priced[priced.meets_need == "YES"], priced[priced.meets_need == "NO"]
    assert len(met) and len(missed)
    assert (met.nearest_cum_stream >= met.need).all()
    assert (missed.nearest_cum_stream == missed.need).all()
    assert (priced.Total_Cost - priced.MC_Cost * priced.need).abs().max() < 1e-6


def test_required_day_is_in_its_run(spark):
    runs = frame(spark, "consecutive_runs")
    pulse = frame(spark, "required_pulse")
    both = runs.merge(pulse, on=["station", "Year", "simulation"])
    hit = both[both.MIFR_Dff == both.Req_aug].groupby(["station", "Year", "simulation"]).size()
    assert len(hit) == len(pulse)


def test_every_run_day_has_a_neighbour(spark):
    runs = frame(spark, "consecutive_runs")
    for _, g in runs.groupby(["station", "Year", "simulation"]):
        days = set(g.DOY)
        assert len(days) == len(g)
        assert all(d - 1 in days or d + 1 in days for d in days)


def test_shares_add_up(spark):
    shares = frame(spark, "crop_mix_shares").groupby("station").Percentage.sum()
    assert ((shares - 100).abs() <= 0.15).all()


def test_parts_do_not_exceed_their_whole(spark):
    parts = frame(spark, "apportion_to_parts")
    assert (parts.groupby(["site", "crop"]).fraction.sum() <= 1 + 1e-9).all()
    assert parts.groupby(["site", "crop"]).fraction.sum().min() < 1  # interruptible parts left out


def test_boxes_are_ordered(spark):
    for name in ("box_summary", "impact_boxes", "cost_per_acre_boxes"):
        b = frame(spark, name)
        ordered = b[["ymin", "lower", "middle", "upper", "ymax"]]
        assert (ordered.diff(axis=1).iloc[:, 1:] >= -1e-6).all().all()


def test_nested_stations_add_up(spark):
    """A region's station gets exactly what its nations' stations get together."""
    flow = frame(spark, "gauge_rollup")
    nations = flow[flow.station.str.startswith("NATION")].groupby(["Year", "simulation"])
    regions = flow[~flow.station.str.startswith("NATION")].groupby(["Year", "simulation"])
    pd.testing.assert_series_equal(nations.Streamflow_aug_vol_acft.sum(),
                                   regions.Streamflow_aug_vol_acft.sum(), atol=1e-3)
