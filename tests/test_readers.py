"""File readers: layouts, spellings, ragged rows, sinks."""

import pytest
from pyspark.sql import functions as F

from freshet.session import shared_dir
from freshet.sources import readers, sinks, tables

SEASON = "YYYY-MM-DD(DOY)\tcrop\tplanting_date\tharvest_date\tyield\tused_biomass\tirrig\tregion\tsite"


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_scenario_folders_in_one_scan(spark, tmp_path):
    for name in ("Scenario01", "with space+plus"):
        put(tmp_path / name / "result.dat", SEASON + "\n"
            f"1998-07-24(205)\tOats\t1998090\t1998205\t10.5\tNA\t\tMethow\t{name}\n"
            "1999-07-24(205)\tRye\t1999090\n")
    got = sorted(map(tuple, readers.read_scenarios(spark, str(tmp_path)).select(
        "simulation", "Year", "crop", "yield", "used_biomass", "irrig", "site").collect()),
        key=str)
    assert got == sorted([
        ("Scenario01", 1998, "Oats", 10.5, None, None, "Scenario01"),
        ("Scenario01", 1999, "Rye", None, None, None, None),
        ("with space+plus", 1998, "Oats", 10.5, None, None, "with space+plus"),
        ("with space+plus", 1999, "Rye", None, None, None, None)], key=str)


def test_yields_drop_unknown_crops(spark, tmp_path):
    put(tmp_path / "a" / "result.dat", SEASON + "\n"
        "1998-07-24(205)\tOats\t1\t1\t10\t20\t1\tM\ts\n"
        "1998-07-24(205)\tRye\t1\t1\t10\t20\t1\tM\ts\n"
        "1998-07-24(205)\tKelp\t1\t1\t10\t20\t1\tM\ts\n")
    got = readers.read_yields(spark, str(tmp_path)).select("crop", "yield_kgha").collect()
    assert sorted(map(tuple, got)) == [("Oats", 10.0), ("Rye", 20.0)]


def test_files_of_another_layout_fail(spark, tmp_path):
    put(tmp_path / "a" / "result.dat", SEASON + "\n1998-1-1(1)\tOats\t1\t1\t1\t1\t1\tM\ts\n")
    swapped = SEASON.replace("yield\tused_biomass", "used_biomass\tyield")
    put(tmp_path / "b" / "result.dat", swapped + "\n1998-1-1(1)\tOats\t1\t1\t1\t1\t1\tM\ts\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_scenarios(spark, str(tmp_path)).select("yield", "used_biomass").collect()


def test_names_differing_in_case_and_blank_names(spark, tmp_path):
    path = put(tmp_path / "f.csv",
               '"","FID_WSDA","Crop_Name","Acres","lat","long","WRIA_ID1","WRIA","Grid_Number",'
               '"region","Long","Lat","site"\n'
               '"1",17,"Oats",2.5,46.1,-118.2,30,"W, upper","G1","Methow",-118.9,46.9,"s"\n')
    r = readers.read_fields(spark, path).first()
    assert (r.lat, r.field_lat, r.field_long) == ("46.10000", 46.9, -118.9)
    assert (r.FID_WSDA, r.WRIA, r.Acres_PF) == ("17", "W, upper", 2.5)


@pytest.mark.parametrize("name", ["WR_DOC_ID (Dummy)", "WR_DOC_ID..Dummy."])
def test_mangled_names(spark, tmp_path, name):
    path = put(tmp_path / "g.csv", "Crop_Name,site,Irrigation,HUC10_NAME,Grid_Number,Acres,"
               f"CropAcres,lat,long,{name}\nOats,s,Drip,H,1,2,3,4,5,D1\n")
    eff = spark.createDataFrame([("Drip", 0.9, 0.8)],
                                "Irrigation string, Efficiency double, ML_Fraction double")
    wet = spark.createDataFrame([("Oats", 1.1)], "crop string, WM_ML_factor double")
    r = readers.read_basin_grids(spark, path, eff, wet).first()
    assert (r.WR_DOC_ID, r.CropArea, r.region, r.lat) == ("D1", 3.0, "Fifteenmile", "4.00000")
    assert (r.ML_Fraction, r.WM_ML_factor) == (0.8, 1.1)


def test_missing_column_is_an_error(spark, tmp_path):
    path = put(tmp_path / "m.csv", "crop,other\nOats,1\n")
    with pytest.raises(ValueError, match="WM_ML_factor"):
        readers.read_table(spark, path, tables.MOISTURE)


def test_station_numbers_stay_text(spark, tmp_path):
    path = put(tmp_path / "d.csv", "x,site_no,Year,Month,Day,DOY,Discharge_cfs\n"
               "1,3.20E+51,2001,5,1,121,10.5\n2,12447200,2001,5,1,121,NA\n3,32E050,2001,5,1,121,1\n")
    got = [tuple(r) for r in readers.read_discharge(spark, path).select(
        "SITENO", "Discharge_cfs").collect()]
    assert got == [("32E050", 10.5), ("12447200", None), ("32E050", 1.0)]


def test_daily_events(spark, tmp_path):
    path = put(tmp_path / "daily.dat", "Year,DOY ,Irrigation cum(timestep),region,crop,site\n"
               "2001,54,1,M,Oats,s\n2001,55,1,M,Oats,s\n2001,241,2,M,Oats,s\n2001,242,1,M,Oats,s\n"
               "2001,100,0,M,Oats,s\n2001,100,5,M,Kelp,s\n2001,100,NA,M,Oats,s\n")
    grids = spark.createDataFrame([("Oats", "s", "M", "Drip", 0.5, 1.0)],
                                  "crop string, site string, region string, Irrigation string, "
                                  "ML_Fraction double, WM_ML_factor double")
    got = sorted((r.DOY, r.irrig1, r.simulation)
                 for r in readers.read_daily_baseline(spark, path, grids).collect())
    assert got == [(55, 0.5, "optimal"), (241, 1.0, "optimal")]
    put(tmp_path / "all" / "Scenario02" / "daily_result.dat", open(path).read())
    rows = readers.read_daily_scenarios(spark, str(tmp_path / "all"), grids).collect()
    assert {r.simulation for r in rows} == {"Scenario02"} and len(rows) == 2


def test_windows_of_scenarios_only(spark, tmp_path):
    path = put(tmp_path / "w.csv",
               "simulation,start_date,stop_date\noptimal,0,0\nScenario01,121,135\n,1,2\n")
    assert [tuple(r) for r in readers.read_windows(spark, path).collect()] == [
        ("Scenario01", 121, 135)]


def test_downloaded_daily_values(spark):
    raw = spark.createDataFrame([("32E050", "2000-12-31", "7.5"), ("1", "2001-03-01", "Ice")],
                                "site_no string, Date string, X_00060_00003 string")
    got = [tuple(r) for r in readers.discharge_from_daily_values(raw).collect()]
    assert got == [("32E050", 2000, 12, 31, 366, 7.5), ("1", 2001, 3, 1, 60, None)]


def test_columns_by_position(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert readers.columns_between(df, 2, 3).columns == ["b", "c"]


def test_sinks(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 2).alias("simulation"),
                                 (F.col("id") % 5).alias("Year"), "id")
    sinks.write_partitioned(df, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == 100 and set(back.columns) == {"simulation", "Year", "id"}
    assert (tmp_path / "p" / "simulation=0" / "Year=0").is_dir()
    sinks.write_csv(df, str(tmp_path / "c"), one_file=True)
    assert len(list((tmp_path / "c").glob("*.csv"))) == 1
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 100


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    path = shared_dir(spark)
    assert path.endswith(f"freshet-{spark.sparkContext.applicationId}")
    assert not named or path.startswith(named)
