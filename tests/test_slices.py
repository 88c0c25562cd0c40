"""Windows over range slices against plain windows; runs, intervals, pivots, shares, ragged files, publishing."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from freshet.functions import dims
from freshet.functions import fixed_values as fv
from freshet.functions import semantics as sem
from freshet.operators import apportion, flow, intervals, long_runs, report, slices
from freshet.sources import readers, sinks, tables


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    left, right = (sorted(map(repr, df.select(*columns).collect())) for df in (a, b))
    assert left == right and left


@pytest.fixture(scope="module")
def days(spark):
    """One station with nearly all days, a few others, some without a name."""
    rng = random.Random(2)
    rows = [("hot", d) for d in range(3000) if rng.random() < 0.6]
    rows += [(k, d) for k in ("a", "b", None) for d in range(40) if rng.random() < 0.5]
    rows = [(k, d, float(rng.randint(1, 50)), rng.random() < 0.8) for k, d in rows]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "s string, d int, gap double, need boolean").repartition(5)


@pytest.mark.parametrize("n", [1, 2, 13, 60])
def test_neighbours_and_totals(spark, days, n):
    w = Window.partitionBy("s").orderBy("d")
    row = F.struct("d", "gap")
    want = days.withColumns({"before": F.lag(row).over(w), "after": F.lead(row).over(w),
                             "top": F.max("gap").over(Window.partitionBy("s"))})
    cut = slices.cut(days, ["s"], ["d"], n=n)
    got = slices.neighbours(slices.group_totals(cut, ["s"], {"top": (F.max, F.col("gap"))}), ["s"], ["d"], ["d", "gap"])
    same(got.drop(slices.SLICE), want)


@pytest.mark.parametrize("n", [1, 7, 40])
def test_runs_of_a_hot_station(spark, days, n):
    keys, need = ["s"], F.col("need")
    plain = flow.consecutive_runs(flow.keep_groups_with(days, keys, need), keys, "d", where=need)
    cut = long_runs.keep_groups_with(long_runs.cut_days(days, keys, "d", n=n), keys, need)
    runs = long_runs.consecutive_runs(cut, keys, "d", where=need, deficit="gap").drop(slices.SLICE)
    same(runs.drop("MovingSum", "Larger"), plain)
    same(long_runs.required_pulse(runs, keys), flow.required_pulse(plain, keys, "d", "gap"))
    full = long_runs.consecutive_runs(cut, keys, "d", where=need, deficit="gap")
    same(long_runs.with_required_pulse(full, keys).drop(slices.SLICE), flow.with_required_pulse(plain, keys, "d", "gap"))


def test_two_rows_for_a_day_fail(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 3.0)], "s string, d int, gap double")
    with pytest.raises(Exception, match="two different rows"):
        long_runs.consecutive_runs(long_runs.cut_days(df, ["s"], "d"), ["s"], "d").collect()
    twice = df.where("gap = 2").unionAll(df.where("gap = 2"))
    assert long_runs.consecutive_runs(long_runs.cut_days(twice, ["s"], "d"), ["s"], "d").count() == 0


def test_intervals_against_all_pairs(spark):
    rng = random.Random(4)
    places = [0.0, -3.5, 1e9, 0.1 + 0.2]
    points = [(i, rng.choice("ab"), rng.choice([rng.uniform(-50, 50), rng.choice(places), float(rng.randint(-5, 5))])) for i in range(300)]
    points += [(900, "a", None), (901, "a", float("nan")), (902, None, 0.0), (903, "a", float("inf")), (904, "b", 1e300)]
    spans = []
    for i in range(120):
        start = rng.choice([rng.uniform(-60, 50), rng.choice(places), float(rng.randint(-5, 5))])
        spans.append((i, rng.choice("ab"), start, start + rng.choice([0.0, 1e-9, 0.25, 1.0, 2.0, 8.0, 33.3, 1e6, -1.0])))
    spans += [(900, "a", None, 3.0), (901, "a", 0.0, float("inf")), (902, None, -1.0, 1.0)]
    p = spark.createDataFrame(points, "i int, k string, at double")
    w = spark.createDataFrame(spans, "j int, k string, start double, stop double")
    got = {(r.i, r.j) for r in intervals.tag_intervals(p, w, point="at", start="start", stop="stop", on=["k"]).collect()}
    ok = lambda x: x is not None and abs(x) < float("inf")
    want = {(i, j) for i, k, at in points for j, g, a, b in spans
            if k is not None and k == g and ok(at) and ok(a) and ok(b) and a <= at <= b}
    assert got == want and len(want) > 100
    assert intervals.tag_intervals(p, w.where("j < 0"), point="at", start="start", stop="stop").count() == 0


def test_pivot_loses_nothing(spark):
    df = spark.createDataFrame([("x", "a", 1.0), ("x", "b", 2.0), ("x", "c", 4.0), ("y", "d", 8.0), ("x", None, 16.0)],
                               "k string, g string, v double")
    got = {r.k: r.asDict() for r in report.to_matrix(df, ["k"], "g", "v", ["a", "b"], rest="others").collect()}
    assert got == {"x": {"k": "x", "a": 1.0, "b": 2.0, "others": 20.0}, "y": {"k": "y", "a": None, "b": None, "others": 8.0}}
    with pytest.raises(Exception, match="outside the list: d"):
        report.to_matrix(df.where("k = 'y'"), ["k"], "g", "v", ["a", "b"]).collect()
    assert report.to_matrix(df.where("g in ('a', 'b')"), ["k"], "g", "v", ["a", "b"]).collect()[0].asDict() == {
        "k": "x", "a": 1.0, "b": 2.0}


@pytest.mark.parametrize("n", ["1", "9"])
def test_exact_shares_add_up(spark, n):
    rng = random.Random(6)
    parts = [(k, i, float(rng.randint(0, 30))) for k in range(20) for i in range(rng.randint(1, 12))]
    df = spark.createDataFrame(parts, "k int, i int, size double")
    df = df.join(df.groupBy("k").agg(F.sum("size").alias("whole")), "k")
    whole = spark.createDataFrame([(k, y, rng.choice([rng.uniform(-9, 99), 1 / 3, 0.0])) for k in range(20) for y in range(3)],
                                  "k int, y int, m double")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        got = apportion.apportion_exactly(whole, df, ["k"], part=["i"], part_size="size", whole_size="whole",
                                          measures={"share": ("m", 4)}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    sums, sizes = {}, {}
    for r in got:
        if r.whole:
            assert abs(r.share - r.m * r["size"] / r.whole) < 1.01e-4
            sums[r.k, r.y] = sums.get((r.k, r.y), 0) + round(r.share * 10_000)
            sizes[r.k, r.y] = r.m
    assert sums and all(sums[k] == int(sizes[k] * 10_000.0 + 0.5 // 1) or abs(sums[k] - sizes[k] * 10_000) <= 0.5 for k in sums)
    rolled = {(r.k, r.y): r.total for r in apportion.rollup_exactly(
        whole, df, ["k"], part_size="size", whole_size="whole", measures={"total": ("m", 4)}, size_out="area").collect()}
    assert all(round(rolled[k] * 10_000) == sums[k] for k in sums)


def test_wholes_that_differ_fail(spark):
    parts = spark.createDataFrame([(1, 2.0, 5.0), (1, 3.0, 6.0)], "k int, size double, whole double")
    whole = spark.createDataFrame([(1, 10.0)], "k int, m double")
    with pytest.raises(Exception, match="differ in whole"):
        apportion.rollup_exactly(whole, parts, ["k"], part_size="size", whole_size="whole", measures={"m": ("m", 2)},
                                 size_out="area").collect()


def test_units(spark):
    df = spark.createDataFrame([(7, 1, 2), (-7, 1, 2), (5, 2, 0), (None, 1, 1), (2 ** 61, 2 ** 40, 2 ** 41)], "u long, s long, w long")
    assert [r[0] for r in df.select(sem.units_up_to("u", "s", "w")).collect()] == [4, -4, None, None, 2 ** 60]


def test_ragged_rows(spark, tmp_path):
    (tmp_path / "cells").write_text('Grid,StationCode,SITENO\n1_-2,C1,7\n3_-4,C2\n5_-6\n"7_-8",C4,9,shifted,more\n9_-1,C5,1,,\n\n')
    found = readers.read_ragged_table(spark, str(tmp_path / "cells"), tables.CONTRIBUTING_CELL)
    assert sorted(map(repr, (tuple(r) for r in found.rows.collect()))) == sorted(map(repr, [
        ("1_-2", "C1", "7"), ("3_-4", "C2", None), ("5_-6", None, None), ("9_-1", "C5", "1")]))
    assert [(r.cell, r.beyond) for r in found.long.collect()] == [("7_-8", "shifted")]


def test_mangled_header(spark, tmp_path):
    (tmp_path / "t").write_text("a b,,x,x,X,y (z),\n1,2,3,4,5,6,7\n")
    assert readers.repaired_names(["a b", "", "x", "x", "X", "y (z)", ""]) == ["a b", "V2", "x", "x.1", "X", "y (z)", "V7"]
    got = readers.read_table(spark, str(tmp_path / "t"), {
        "dotted": ("a.b", "int"), "blank": ("V2", "int"), "first": ("x", "int"), "second": ("x.1", "int"),
        "upper": ("X", "int"), "braces": ("y..z", "int"), "place": ("#7", "int"), "absent": ("?q", "int")}).first()
    assert tuple(got) == (1, 2, 3, 4, 5, 6, 7, None)


def test_publish_is_atomic_and_repeatable(spark, tmp_path):
    path = str(tmp_path / "result")
    with pytest.raises(ValueError, match="nothing published"):
        readers.read_published(spark, path)
    first = spark.createDataFrame([(1, "a")], "i int, s string")
    assert sinks.publish(first, path, "one")
    broken = first.withColumn("s", F.when(F.col("i") == 1, F.raise_error(F.lit("lost"))).cast("string"))
    with pytest.raises(Exception, match="lost"):
        sinks.publish(broken, path, "two")
    assert [tuple(r) for r in readers.read_published(spark, path).collect()] == [(1, "a")]
    second = spark.createDataFrame([(2, "b"), (3, None)], "i int, s string")
    assert sinks.publish(second, path, "two") and not sinks.publish(first, path, "two") and not sinks.publish(first, path, "one")
    assert sorted(map(repr, readers.read_published(spark, path).collect())) == sorted(map(repr, second.collect()))


def test_daily_tree_is_pruned(spark, tmp_path):
    rows = spark.createDataFrame([(s, y, d, 2.0, "R", c, "s1", 9.0) for s in "AB" for y in (2000, 2001) for d in (10, 100) for c in ("Onion", "Kelp")],
                                 "simulation string, Year int, DOY int, irrig double, region string, crop string, site string, unused double")
    sinks.write_partitioned(rows, str(tmp_path / "tree"))
    grids = spark.createDataFrame([("Onion", "s1", "R", "Drip", 0.5, 1.0)],
                                  "crop string, site string, region string, Irrigation string, ML_Fraction double, WM_ML_factor double")
    got = readers.read_daily_tree(spark, str(tmp_path / "tree"), grids, simulations=["A"], years=(2001, 2005)).select(
        "simulation", "Year", "DOY", "irrig1")
    assert [tuple(r) for r in got.collect()] == [("A", 2001, 100, 1.0)]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        text = got.select("*")._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [" in text and "simulation" in text.split("PartitionFilters: [")[1].split("]")[0]
    pushed = text.split("PushedFilters: [")[1]
    assert "GreaterThanOrEqual(DOY,55)" in pushed and "GreaterThan(irrig,0.0)" in pushed and "In(crop" in pushed
    assert "unused" not in text.split("ReadSchema:")[1].splitlines()[0]


def test_category_orders(spark):
    df = spark.createDataFrame([("b",), ("a",), ("z",), (None,)], "g string")
    got = {r.g: (r.up, r.down) for r in dims.ranked(df, "g", {"up": ["a", "b", "c"], "down": ["b"]}).collect()}
    assert got == {"a": (1, None), "b": (2, 1), "z": (None, None), None: (None, None)}
    ranks = dims.stations(spark).collect()
    assert all(sorted(getattr(r, c) for r in ranks) == list(range(1, len(fv.STATIONS) + 1))
               for c in ("station_rank", "name_rank", "ratio_rank"))


def test_every_slice_has_a_bucket(spark):
    hashes = [r[0] for r in spark.range(500).select(F.hash(F.col("id").cast("int"))).collect()]
    assert hashes == [slices._hash(i) for i in range(500)]
    for n in (1, 2, 7, 200):
        numbers = slices._numbers(n)
        assert list(numbers) == sorted(set(numbers)) and len({slices._hash(i) % n for i in numbers}) == n
