"""Worked cases and seeded random checks against plain-Python models."""

import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from freshet.operators import apportion, curve, flow, impact, report, running
from freshet.functions import units


@contextmanager
def slicing(spark, slices):
    """Cut ordered groups into so many range slices."""
    spark.conf.set("spark.sql.shuffle.partitions", str(slices))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# --- impact -----------------------------------------------------------------------
def compared(spark, scenario, baseline, price=5.0):
    s = spark.createDataFrame([("Corn_grain", *scenario)], "crop string, irrig double, y double")
    b = spark.createDataFrame([("Corn_grain", *baseline)],
                              "crop string, irrig0 double, y0 double, Acres double")
    b = b.withColumn("total0", F.col("y0") * units.hectares("Acres"))
    out = impact.impact_vs_baseline(
        s, b, ["crop"], supply="irrig", base_supply="irrig0", output="y", base_output="y0",
        total=F.col("y") * units.hectares("Acres"), base_total="total0")
    out = out.withColumns({
        "streamflow_aug_acrft": units.mm_to_acre_feet("streamflow_aug_mm", "Acres"),
        "ft3": units.mm_to_cubic_feet("streamflow_aug_mm", "Acres"),
        "total": F.col("y") * units.hectares("Acres")})
    out = out.withColumn("cfs", units.cubic_feet_to_cfs("ft3"))
    prices = spark.createDataFrame([("Corn_grain", price)], "crop string, mean_Price double")
    out = impact.price_outcome(out, prices, "total", units_out="u1", value_out="v1")
    out = impact.price_outcome(out, prices, "total0", units_out="u0", value_out="v0")
    return out.withColumn("Revenue_loss", F.col("v0") - F.col("v1"))


def test_impact_case(spark):
    r = compared(spark, (80.0, 9000.0), (100.0, 10000.0, 10.0)).first()
    assert r.streamflow_aug_mm == 20
    assert r.streamflow_aug_acrft == pytest.approx(0.656168)
    assert r.ft3 == pytest.approx(28582.678, abs=1e-3)
    assert r.cfs == pytest.approx(0.0220545, abs=1e-7)
    assert r.WM_yield_loss == pytest.approx(4050)
    assert (r.Percentage_irrig, r.Per_irrig_saved) == (pytest.approx(80), pytest.approx(20))
    assert (r.Percentage_yield, r.Per_yield_reduction) == (pytest.approx(90), pytest.approx(10))
    assert r.u0 == pytest.approx(1594.4882, abs=1e-4)
    assert r.u1 == pytest.approx(1435.0394, abs=1e-4)
    assert r.Revenue_loss == pytest.approx(797.2441, abs=1e-4)


def test_baseline_beside_equals_join(spark):
    rng = random.Random(2)
    rows = [(k, s, float(rng.randint(1, 9))) for k in range(30) for s in ("N", "A", "R")
            if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "k int, s string, x double")
    base = df.where("s = 'N'").select("k", F.col("x").alias("x0"))
    want = sorted(map(tuple, df.join(base, ["k"], "left").select("k", "s", "x", "x0").collect()),
                  key=str)
    got = impact.beside_baseline(df, ["k"], F.col("s") == "N", {"x0": "x"})
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_a_second_baseline_row_fails(spark):
    df = spark.createDataFrame([(1, "N", 1.0, 9.0), (1, "N", 5.0, 2.0), (1, "A", 0.0, 0.0)],
                               "k int, s string, x double, y double")
    with pytest.raises(Exception, match="more than one baseline row"):
        impact.beside_baseline(df, ["k"], F.col("s") == "N", {"x0": "x", "y0": "y"}).collect()


def test_small_differences_vanish(spark):
    r = impact.clamp_impact(
        compared(spark, (99.1, 10100.0), (100.0, 10000.0, 10.0))).first()
    assert (r.streamflow_aug_mm, r.WM_yield_loss, r.Revenue_loss) == (0, 0, 0)
    assert r.Percentage_yield == 100
    near = spark.createDataFrame([(50.0, 0.009, -3.0, 0.8), (100.5, 0.01, 0.2, 1.0),
                                  (None, None, None, None)],
                                 "Percentage_yield double, streamflow_aug_acrft double, "
                                 "WM_yield_loss double, Revenue_loss double")
    assert [tuple(r) for r in impact.clamp_impact(near).collect()] == [
        (50.0, 0.0, 0.0, 0.0), (100.0, 0.01, 0.2, 1.0), (None, None, None, None)]


# --- runs and pulse -------------------------------------------------------------------
def test_consecutive_case(spark):
    df = spark.createDataFrame([("a", d) for d in (150, 151, 153, 155, 156, 157)],
                               "g string, d int")
    got = sorted(r.d for r in flow.consecutive_runs(df, ["g"], "d").collect())
    assert got == [150, 151, 155, 156, 157]


def test_repeated_days_count_once_and_different_ones_fail(spark):
    schema = "g string, d int, x double"
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 1, 5.0), ("a", 2, 1.0), ("a", 4, 1.0)], schema)
    assert sorted(rows_of(flow.consecutive_runs(df, ["g"], "d"), "d", "x")) == [(1, 5.0), (2, 1.0)]
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 1, 7.0), ("a", 2, 1.0)], schema)
    with pytest.raises(Exception, match="two different rows"):
        flow.consecutive_runs(df, ["g"], "d").collect()


def test_required_pulse_case(spark):
    days = [(150, 10.0), (151, 4.0), (155, 3.0), (156, 8.0), (157, 6.0)]
    df = spark.createDataFrame([("a", d, x) for d, x in days], "g string, d int, x double")
    r = flow.required_pulse(df, ["g"], "d", "x").first()
    assert r.Req_aug == 8
    assert r.Req_aug_Acft == pytest.approx(238.0165, abs=1e-4)
    assert r.Fiftyp_aug == pytest.approx(119.0083, abs=1e-4)
    tied = spark.createDataFrame([("a", d, x) for d, x in
                                  [(150, 10.0), (151, 4.0), (155, 8.0), (156, 6.0)]],
                                 "g string, d int, x double")
    assert flow.required_pulse(tied, ["g"], "d", "x").first().Req_aug == 10


def random_days(rng):
    out = []
    for g in range(40):
        for d in range(1, 16):
            if rng.random() < 0.6:
                out.append((g, d, float(rng.randint(1, 9)), float(rng.randint(0, 6))))
    return out


def model_runs(rows):
    by = {}
    for g, d, x, a in rows:
        by.setdefault(g, {})[d] = (x, a)
    return {g: sorted(d for d in days if d - 1 in days or d + 1 in days)
            for g, days in by.items()}, by


def test_runs_pulse_and_ratio_match_model(spark):
    rows = random_days(random.Random(3))
    df = spark.createDataFrame(rows, "g int, d int, x double, a double")
    runs = flow.consecutive_runs(df, ["g"], "d", unique=True).cache()
    want, by = model_runs(rows)
    got = {}
    for r in runs.collect():
        got.setdefault(r.g, []).append(r.d)
    assert {g: sorted(d) for g, d in got.items()} == {g: d for g, d in want.items() if d}

    pulse, decisive = {}, set()
    for g, days in want.items():
        pairs = [(by[g][p][0] + by[g][d][0], max(by[g][p][0], by[g][d][0]), d)
                 for p, d in zip(days, days[1:]) if d - p == 1]
        if pairs:
            least = min(s for s, _, _ in pairs)
            pulse[g] = max(m for s, m, _ in pairs if s == least)
            decisive |= {(g, d) for s, m, d in pairs if s == least and m == pulse[g]}
    out = flow.required_pulse(runs, ["g"], "d", "x")
    assert {r.g: r.Req_aug for r in out.collect()} == pulse
    tagged = flow.with_required_pulse(runs, ["g"], "d", "x")
    assert {r.g: r.Req_aug for r in tagged.collect()} == pulse
    assert tagged.count() == runs.count()
    ratios = flow.augmentation_ratio(runs, ["g"], "d", "x", "a").collect()
    assert {(r.g, r.d) for r in ratios} == decisive
    assert all(r.RelativeRatioOfAug_adj == min(1, r.a / r.x) for r in ratios)


def test_verdict_case(spark):
    cases = [(80.0, 20.0), (80.0, 21.0), (80.0, 5.0), (100.0, 5.0), (70.0, 6.0), (80.0, 50.0),
             (40.0, 11.0), (None, 5.0)]
    df = spark.createDataFrame([(i, q, 100.0, a) for i, (q, a) in enumerate(cases)],
                               "i int, Discharge_cfs double, MIFR_rules double, "
                               "streamflow_aug_cfs double")
    r = {x.i: x for x in flow.deficit_days(df).collect()}
    assert (r[0].Can_meet_MIFR, r[0].Percentage_aug) == ("NO", 100)
    assert (r[1].Can_meet_MIFR, r[1].Percentage_aug) == ("YES", 100)
    assert (r[2].Can_meet_MIFR, r[2].Percentage_aug) == ("NO", 25)
    assert (r[3].Aug_Need, r[3].MIFR_Dff1, r[3].Aug_2_mt_MIFR) == ("Not_Need", 0, 0)
    assert (r[4].Can_meet_MIFR_75, r[5].Can_meet_MIFR_75) == ("YES", "NO")
    assert (r[6].Can_meet_MIFR_50, r[6].Can_meet_MIFR_75) == ("YES", "NO")
    assert r[0].per_aug_not_meet_MIFR == 100 and r[1].per_aug_not_meet_MIFR == 0
    assert (r[7].Can_meet_MIFR, r[7].Aug_Need, r[7].MIFR_Dff1) == (None, None, None)


def test_any_need_keeps_whole_groups(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, False), ("b", 2, None)],
                               "g string, d int, f boolean")
    got = sorted(rows_of(flow.keep_groups_with(df, ["g"], F.col("f")), "g", "d"))
    assert got == [("a", 1), ("a", 2)]


# --- curves -----------------------------------------------------------------------------
POINTS = [(1.0, 5.0, 2.0), (2.0, 10.0, 3.0), (2.0, 1.0, 4.0), (9.0, 4.0, 1.0)]


def small_curve(spark):
    df = spark.createDataFrame([("a", i, c, v, s) for i, (c, v, s) in enumerate(POINTS)],
                               "g string, i int, c double, v double, s double")
    return curve.supply_curve(df, ["g"], cost="c", volume="v", tie=["i"], size="s")


def test_curve_case(spark):
    assert [r.cum_streamflow for r in small_curve(spark).orderBy("i").collect()] == [5, 15, 16, 20]


def test_curve_leaves_out_missing_and_infinite(spark):
    df = spark.createDataFrame(
        [("a", 1, 1.0, 2.0), ("a", 2, float("inf"), 3.0), ("a", 3, None, 4.0),
         ("a", 4, 0.5, None), ("a", 5, float("nan"), 1.0)], "g string, i int, c double, v double")
    out = curve.supply_curve(df, ["g"], cost="c", volume="v", tie=["i"])
    assert rows_of(out, "i", "cum_streamflow") == [(1, 2.0)]


@pytest.mark.parametrize("need, want", [
    (12.0, (2, 15, "YES", 2, 15, 5, 24, 4.8)), (25.0, (9, 25, "NO", 2, 15, 10, 225, 22.5)),
    (50.0, (9, 50, "NO", 1, 5, 10, 450, 45)), (3.0, (1, 5, "YES", 1, 5, 2, 3, 1.5))])
def test_lookup_case(spark, need, want):
    df = spark.createDataFrame([("a", need), ("empty", need)], "g string, n double")
    out = {r.g: r for r in curve.curve_lookup(df, small_curve(spark), ["g"], amount="n",
                                              cost="c", size="s").collect()}
    r = out["a"]
    assert (r.MC_Cost, r.nearest_cum_stream, r.meets_need, r.MC_Cost_50, r.nearest_cum_stream_50,
            r.Contributing_acres, r.Total_Cost, r.Cost_acre) == want[:7] + (
                pytest.approx(want[7]),)
    e = out["empty"]
    assert (e.MC_Cost, e.nearest_cum_stream, e.meets_need, e.Contributing_acres, e.Total_Cost,
            e.Cost_acre) == (0, 0, None, 0, 0, None)


def model_lookup(points, need):
    """Straight reading of the look-up rules over an ordered list of steps."""
    cum, steps = 0.0, []
    for c, v, s in points:
        cum += v
        steps.append((c, cum, s))
    if not steps:
        return (0, 0, 0, 0, 0)
    at = [i for i, (_, q, _) in enumerate(steps) if q >= need]
    if at:
        cost, vol = steps[at[0]][:2]
    else:
        cost, vol = steps[max(i for i, (_, q, _) in enumerate(steps) if q <= need)][0], need
    at = [i for i, (_, q, _) in enumerate(steps) if q >= need / 2]
    half = steps[at[0]] if at else steps[0]
    size = sum(s for c, q, s in steps if c <= cost and q <= vol)
    return (cost, vol, half[0], half[1], size)


@pytest.mark.parametrize("slices", [1, 13])
def test_lookup_matches_model(spark, slices):
    rng = random.Random(11)
    points, needs = {}, {}
    for g in range(80):
        n = rng.choice([0, 1, 2, 5, 12])
        # zero volumes make ties in both cost and cumulative volume
        points[g] = sorted(((float(rng.randint(0, 4)), i, float(rng.randint(0, 3)),
                             float(rng.randint(1, 9))) for i in range(n)))
        needs[g] = float(rng.randint(1, 16))
    df = spark.createDataFrame([(g, i, c, v, s) for g, ps in points.items() for c, i, v, s in ps],
                               "g int, i int, c double, v double, s double")
    with slicing(spark, slices):
        c = curve.supply_curve(df, ["g"], cost="c", volume="v", tie=["i"], size="s")
    need = spark.createDataFrame([(g, n) for g, n in needs.items()], "g int, n double")
    out = curve.curve_lookup(need, c, ["g"], amount="n", cost="c", size="s")
    got = {r.g: (r.MC_Cost, r.nearest_cum_stream, r.MC_Cost_50, r.nearest_cum_stream_50,
                 r.Contributing_acres) for r in out.collect()}
    assert got == {g: model_lookup([(c, v, s) for c, _, v, s in ps], needs[g])
                   for g, ps in points.items()}


def test_lookup_takes_one_row_of_a_station_with_two_curves(spark):
    steps = [("R1", 1.0, 5.0, 1.0), ("R1", 9.0, 30.0, 2.0), ("R2", 2.0, 4.0, 4.0), ("R2", 3.0, 40.0, 8.0)]
    c = spark.createDataFrame([("a", *r) for r in steps], "g string, r string, c double, v double, s double")
    need = spark.createDataFrame([("a", 25.0)], "g string, n double")
    got = curve.curve_lookup(need, c, ["g"], amount="n", cost="c", cum="v", size="s", order=["r", "c", "v"]).first()
    assert (got.MC_Cost, got.nearest_cum_stream, got.MC_Cost_50, got.nearest_cum_stream_50) == (9, 30, 9, 30)
    assert got.Contributing_acres == 1 + 2 + 4  # neither dearer nor beyond 30


@pytest.mark.parametrize("slices", [1, 2, 5])
def test_running_totals_of_missing_values(spark, slices):
    rows = [("a", 1, None), ("a", 2, 3), ("a", 3, None), ("a", 4, 1), ("b", 1, None), (None, 1, None), (None, 2, 4)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    with slicing(spark, slices):
        out = running.running_totals(df, ["k"], ["i"], {"run": "v"}, totals={"all": "run"})
        got = {(r.k, r.i): (r.run, r["all"]) for r in out.collect()}
    assert got == {("a", 1): (None, 4), ("a", 2): (3, 4), ("a", 3): (3, 4), ("a", 4): (4, 4),
                   ("b", 1): (None, None), (None, 1): (None, 4), (None, 2): (4, 4)}


def test_barter(spark):
    out = curve.barter_price(small_curve(spark), ["g"], price=2.0, target=10.0, cutoff=15.0,
                             size="s", cost="c").first()
    assert (out.acres, out.target_cost, out.price_per_acre) == (5.0, 1.0, 4.0)


# --- running totals under skew ------------------------------------------------------------
def skewed(spark, n=6000):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        key = None if i % 3 == 0 else rng.choice(["a", "b", "c", "hot", "hot", "hot"])
        rows.append((key, float(rng.choice([0, 0, 0, 1, 2, 3])), i, rng.randint(1, 9)))
    return rows, spark.createDataFrame(rows, "k string, c double, i int, v int").repartition(7)


def test_sliced_totals_equal_plain_totals(spark):
    rows, df = skewed(spark)
    args = (df, ["k"], ["c", "i"], {"run": "v", "pos": F.lit(1)})
    with slicing(spark, 1):
        plain = running.running_totals(*args, totals={"all": "run"})
    with slicing(spark, 23):
        sliced = running.running_totals(*args, totals={"all": "run"})
    want, totals = {}, {}
    for k, c, i, v in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        run, pos = totals.get(k, (0, 0))
        totals[k] = (run + v, pos + 1)
        want[i] = totals[k]
    for out in (plain, sliced):
        got = out.collect()
        assert len(got) == len(rows)
        assert {r.i: (r.run, r.pos) for r in got} == want
        assert all(r.all == totals[r.k][0] for r in got)
    assert set(sliced.columns) == set(plain.columns)


def test_slices_are_balanced(spark):
    _, df = skewed(spark)
    cut = df.repartitionByRange(12, "k", "c", "i")
    sizes = [r["count"] for r in cut.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 3 * 6000 / 12


@pytest.mark.parametrize("slices", [1, 13])
def test_quantiles_match_builtin(spark, slices):
    rng = random.Random(9)
    rows = [(rng.choice("abb"), rng.choice([None, float("nan"), round(rng.gauss(0, 5), 1)])
             if rng.random() < 0.1 else round(rng.gauss(0, 5), 1)) for _ in range(900)]
    df = spark.createDataFrame(rows, "k string, x double")
    clean = df.where("x IS NOT NULL AND NOT isnan(x)")
    want = clean.groupBy("k").agg(F.percentile("x", F.array(F.lit(.25), F.lit(.5), F.lit(.75)))
                                  .alias("q")).collect()
    with slicing(spark, slices):
        got = running.exact_quantiles(df, ["k"], "x", {"a": .25, "b": .5, "c": .75})
    got = {r.k: (r.a, r.b, r.c) for r in got.collect()}
    assert got == {r.k: pytest.approx(tuple(r.q)) for r in want}


@pytest.mark.parametrize("slices", [1, 13])
def test_box_summary(spark, slices):
    data = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 30.0, 45.0]
    df = spark.createDataFrame([("a", x) for x in data], "k string, x double")
    with slicing(spark, slices):
        r = report.box_summary(df, ["k"], "x", limits=(0, 40)).first()
    assert (r.lower, r.middle, r.upper) == (3.0, 5.0, 7.0)
    assert (r.ymin, r.ymax, r.n, r.outliers) == (1.0, 8.0, 9, 1)


def test_medians_of_several_measures(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, None), ("a", 2.0, 7.0),
                                ("b", None, None)], "k string, x double, y double")
    got = {r.k: (r.x, r.y) for r in report.medians(df, ["k"], ["x", "y"]).collect()}
    assert got == {"a": (2.0, 6.0)}


# --- apportioning ---------------------------------------------------------------------------
def test_parts_of_a_covered_whole_sum_to_it(spark):
    whole = spark.createDataFrame([("a", 1998, 60.0), ("a", 1999, None), ("b", 1998, 10.0)],
                                  "k string, y int, m double")
    parts = spark.createDataFrame([("a", "p", 1.0, 4.0), ("a", "q", 3.0, 4.0),
                                   ("b", "r", 2.0, 4.0)],
                                  "k string, p string, size double, all double")
    long = apportion.apportion_to_parts(whole, parts, ["k"], part_size="size", whole_size="all",
                                        measures={"mp": "m"})
    assert sorted(rows_of(long.where("y = 1998"), "p", "mp")) == [
        ("p", 15.0), ("q", 45.0), ("r", 5.0)]
    rolled = apportion.rollup_parts(whole, parts, ["k"], part_size="size", whole_size="all",
                                    measures={"m": "m"}, size_out="area", count_out="n")
    assert sorted(rows_of(rolled, "k", "y", "m", "area", "n")) == [
        ("a", 1998, 60.0, 4.0, 2), ("a", 1999, 0.0, 4.0, 2), ("b", 1998, 5.0, 2.0, 1)]


def test_parts_of_unequal_wholes(spark):
    whole = spark.createDataFrame([("a", 100.0)], "k string, m double")
    parts = spark.createDataFrame([("a", 5.0, 10.0), ("a", 5.0, 50.0)], "k string, size double, all double")
    rolled = apportion.rollup_parts(whole, parts, ["k"], part_size="size", whole_size="all", measures={"m": "m"},
                                    size_out="area")
    assert rolled.first().m == pytest.approx(60.0)


def test_nested_stations_each_get_the_site(spark):
    grid = spark.createDataFrame([("s1", 1, 5.0), ("s1", 1, 2.0), ("s2", 1, 3.0)],
                                 "site string, Year int, v double")
    bridge = spark.createDataFrame([("up", "s1"), ("down", "s1"), ("down", "s2"), ("up", "s1")],
                                   "station string, site string")
    out = apportion.rollup_stations(grid, bridge, ["Year"], {"v": "v"})
    assert sorted(rows_of(out, "station", "v")) == [("down", 10.0), ("up", 7.0)]


def test_two_level_mean(spark):
    df = spark.createDataFrame([("x", "s1", 10.0), ("x", "s1", 20.0), ("x", "s2", 5.0)],
                               "crop string, site string, Acres double")
    out = apportion.two_level_mean_sum(df, ["crop", "site"], ["crop"], "Acres", "total")
    assert rows_of(out, "crop", "total") == [("x", 20.0)]


# --- reports -----------------------------------------------------------------------------------
def test_mean_cost_rounds_half_to_even_and_thousands_follow(spark):
    df = spark.createDataFrame(
        [("s", 1, "w", 2500.0, 1.0, 0.5), ("s", 2, "w", 2501.0, 2.0, 1.5)],
        "site string, y int, w string, Total_Cost double, Cost_acre double, cost_AF double")
    r = report.mean_cost_matrix(df, ["site", "y", "w"], ["site", "w"]).first()
    assert (r.Total_Cost, r.TC1, r.Cost_acre, r.cost_AF) == (2500.0, 2.0, 2.0, 1.0)


def test_years_matrix(spark):
    rows = [("s", "Scenario01", y, y in (1996, 1998)) for y in range(1995, 2001)]
    rows += [("s", "Scenario02", 2004, None), ("t", "Scenario02", 2000, True)]
    df = spark.createDataFrame(rows, "site string, w string, y int, need boolean")
    out = report.years_matrix(df, "site", "w", "y", F.col("need"),
                              labels={"Scenario01": "May H1", "Scenario02": "May H2"})
    assert sorted(map(tuple, out.collect())) == [("s", 20.0, None), ("t", None, 100.0)]


def test_placeholders_keep_missing_columns_null(spark):
    df = spark.createDataFrame([("a", "x", 1.0)], "s string, w string, v double")
    extra = spark.createDataFrame([("b", "y")], "s string, w string")
    assert sorted(map(tuple, report.with_placeholders(df, extra).collect())) == [
        ("a", "x", 1.0), ("b", "y", None)]
