"""Writes a small, seeded set of study input files."""

import csv
import random
from pathlib import Path

from freshet.functions import fixed_values as fv
from freshet.plans.study import LAYOUT

CROPS = ["Corn_grain", "Alfalfa_Hay", "Onion", "Spring_wheat", "Rye", "Kelp"]
SITES = [("46.15625", "-118.40625"), ("46.21875", "-118.40625"), ("46.28125", "-118.34375"),
         ("48.40625", "-119.53125"), ("48.46875", "-119.53125"), ("48.53125", "-119.46875")]
YEARS = [2014, 2015, 2016]


def site_id(lat, long):
    return f"{lat}N{long.replace('-', '')}W"


def region_of(index):
    return "WallaWalla" if index < 3 else "Okanogan"


def write(root: Path, name: str, header: list[str], rows: list, sep: str = ",") -> None:
    path = root / LAYOUT[name] if name in LAYOUT else root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="") as f:
        out = csv.writer(f, delimiter=sep)
        out.writerow(header)
        out.writerows(rows)


def write_study(root: Path, seed: int = 1) -> Path:
    rng = random.Random(seed)
    crops, sites = CROPS, list(enumerate(SITES))
    write(root, "efficiency", ["Irrigation", "Efficiency", "ML_Fraction"],
          [("Drip", 0.9, 0.95), ("Pivot", 0.8, 0.85)])
    write(root, "moisture", ["crop", "WM_ML_factor"], [(c, 1.1 + i / 10)
                                                      for i, c in enumerate(crops)])
    write(root, "prices", ["crop", "Mean_price_2020_2023", "Mean_Price_of_all_time_1979_2023"],
          [(c, 3.5 + i, 3 + i) for i, c in enumerate(crops)])

    grids, field_rows, rights, field_no = [], [], [], 0
    for i, (lat, long) in sites:
        for j, crop in enumerate(crops):
            types = ["Drip", "Pivot"] if (i + j) % 4 == 0 else ["Pivot"]
            for irrigation in types:
                grids.append((crop, site_id(lat, long), region_of(i), irrigation, f"G{i}",
                              round(rng.uniform(5, 90), 2), 50, lat, long, f"D{i}{j}"))
            for _ in range(rng.randint(1, 3)):
                field_no += 1
                field_rows.append((field_no, crop, round(rng.uniform(1, 9), 2), lat, long, 30,
                                   "Basin", f"G{i}", region_of(i), long, lat, site_id(lat, long)))
                date = rng.choice(["1908-05-01", "5/1/1908", ""])
                rights.append((field_no, crop, date, f"R{field_no}", 4.5, lat, long, 1.0, lat,
                               long, "Basin"))
    grids.append(("Corn_grain", "elsewhere", "Yakima", "Drip", "G9", 10, 5, "1", "2", "D"))
    write(root, "grids", ["crop", "site", "region", "Irrigation", "Grid_Number", "Acres",
                          "CropArea", "lat", "long", "WR_DOC_ID"], grids)
    write(root, "fields", ["FID_WSDA", "Crop_Name", "Acres", "lat", "long", "WRIA_ID1", "WRIA",
                           "Grid_Number", "region", "Long", "Lat", "site"], field_rows)
    write(root, "water_rights", ["OBJECTID_1", "Crop_Name", "PriorityDa", "WRDocID", "FieldAcres",
                                 "Lat", "Long", "IntersectA", "join_lat", "join_lon", "WRIA_NM"],
          rights)
    write(root, "interruptible", ["WR_Doc_ID"], [(f"R{n}",) for n in range(1, field_no, 5)])

    header = ["YYYY-MM-DD(DOY)", "crop", "planting_date", "harvest_date", "yield", "used_biomass",
              "irrig", "region", "site", "unused"]
    base = {}
    for i, (lat, long) in sites:
        for crop in crops:
            for y in YEARS:
                harvest = rng.randint(130, 270)
                base[i, crop, y] = (harvest, round(rng.uniform(2000, 9000), 1),
                                    round(rng.uniform(3000, 9900), 1),
                                    round(rng.uniform(200, 700), 1))

    def season(factor):
        rows = []
        for (i, crop, y), (harvest, grain, mass, irrig) in base.items():
            lat, long = SITES[i]
            f = factor(i, crop, y)
            rows.append((f"{y}-08-01({harvest})", crop, f"{y}090", f"{y}{harvest:03d}",
                         round(grain * f, 1), round(mass * f, 1), round(irrig * f, 1),
                         region_of(i), site_id(lat, long), 0))
        rows.append((f"{YEARS[0]}-08-01(200)", "Corn_grain", "NA", "2014200", "NA", 1, 5,
                     "WallaWalla", site_id(*SITES[0]), 0))
        return rows

    write(root, "baseline", header, season(lambda *_: 1.0), "\t")
    for name, *_ in fv.SCENARIO_WINDOWS:
        write(root, f"{LAYOUT['scenarios']}/{name}/result.dat", header,
              season(lambda *_: rng.choice([1.001, 1.0, 0.97, 0.9, 0.7])), "\t")
    demand = []
    for (i, crop, y), (harvest, *_) in base.items():
        for name, start, *_ in fv.SCENARIO_WINDOWS:
            if rng.random() < 0.8:
                demand.append((y, site_id(*SITES[i]), crop, region_of(i), name, start + 5,
                               round(rng.uniform(0, 120), 2)))
    write(root, "window_demand", ["Year", "site", "crop", "region", "simulation",
                                  "target_harvest_date", "irrigation_demand_mm"], demand)
    write(root, "windows", ["simulation", "start_date", "stop_date"],
          [("optimal", 0, 0)] + [w[:3] for w in fv.SCENARIO_WINDOWS])
    write(root, "daily", ["Year", "DOY ", "Irrigation cum(timestep)", "region", "crop", "site"],
          [(y, d, round(rng.uniform(-2, 9), 2), region_of(i), crop, site_id(*SITES[i]))
           for (i, crop, y) in base for d in range(50, 246, 7)], "\t")

    outlet = ["SITENO", "SITENAME", "LONGDD", "LATDD", "VIC lat", "VIC long", "StationCode",
              "SITENAME1", "outlet"]
    write(root, "outlets_first", outlet, [("32E050", "N.F.", 1, 2, 3, 4, "C1", "TR_Dayton", "a"),
                                          ("32A100", "W", 1, 2, 3, 4, "C2", "WR_Detour_Rd", "a")])
    write(root, "cells_first", ["StationCode", "Grid"],
          [("C1", "_".join(SITES[0])), ("C2", "_".join(SITES[0])), ("C2", "_".join(SITES[1])),
           ("C2", "_".join(SITES[2]))])
    write(root, "outlets_second", outlet, [("12447200", "M", 1, 2, 3, 4, "C3", "Malott", "a")])
    write(root, "cells_second", ["StationCode", "Grid"],
          [("C3", "_".join(s)) for s in SITES[3:]])
    names = {s[3]: s[0] for s in fv.STATIONS if s[3]}
    stations = ["3.20E+51", "32A100", "12447200"]
    write(root, "gauges", ["SITENO", "SITENAME", "LONGDD", "LATDD", "SITEURL", "join_lat",
                           "join_lon"],
          [(s, names.get(s, names["32E050"]), 1, 2, "u", 3, 4) for s in stations])
    write(root, "rule_gauges", ["MIFR_NAME", "SITENO"],
          [("N.F.Touchet", "3.20E+51"), ("Detour", "32A100"), ("Malott", "12447200")])
    months = ["May", "Jun", "Jul", "Aug"]
    starts = dict(zip(months, (121, 152, 182, 213)))
    write(root, "calendar", ["Month", "Start_date", "End_date", "Day", "DOY"],
          [(m, 1 if d < 15 else 16, 15 if d < 15 else 31, d + 1, starts[m] + d)
           for m in months for d in range(30)])
    halves = [(m, a, b) for m in months for a, b in ((1, 15), (16, 31))]
    write(root, "rules/walla.csv", ["Month", "Start_date", "End_date", "N.F.Touchet", "Detour"],
          [(*h, round(2 + 0.05 * i, 2), f"1,{100 + i} (Closure)" if i == 3 else f"1,{100 + i}")
           for i, h in enumerate(halves)])
    write(root, "rules/okanogan.csv", ["Month", "Start_date", "End_date", "Malott", "Nowhere"],
          [(*h, round(5 + 0.1 * i, 2), "n/a") for i, h in enumerate(halves)])
    level = {"32A100": 1090, "12447200": 5}
    write(root, "discharge", ["site_no", "Year", "Month", "Day", "DOY", "Discharge_cfs"],
          [(s, y, 1, 1, d, round(level.get(s, 2) * rng.uniform(0.9, 1.1), 2))
           for s in stations for y in YEARS for d in range(100, 251)])

    basin = [("Corn_grain", "b1", "Drip", "H", "1", 40.5, 50, 45.1, -121.2, "D1"),
             ("Alfalfa_Hay", "b1", "Pivot", "H", "1", 70.0, 50, 45.1, -121.2, "D2"),
             ("Onion", "b2", "Pivot", "H", "2", 20.0, 50, 45.2, -121.2, "D3")]
    write(root, "basin_grids", ["Crop_Name", "site", "Irrigation", "HUC10_NAME", "Grid_Number",
                                "Acres", "CropAcres", "lat", "long", "WR_DOC_ID (Dummy)"], basin)

    def basin_season(f):
        return [(f"{y}-08-01(220)", c, f"{y}090", f"{y}{h}", 5000 * f(n), 6000 * f(n),
                 400 * f(n), "Fifteenmile", s, 0)
                for y in (2014, 2015) for n, (c, s, h) in enumerate(
                    [("Corn_grain", "b1", 250), ("Alfalfa_Hay", "b1", 230), ("Onion", "b2", 170)])]
    write(root, "basin_baseline", header, basin_season(lambda n: 1.0))
    write(root, f"{LAYOUT['basin_scenarios']}/Scenario05/result.dat", header,
          basin_season(lambda n: (0.9, 0.8, 0.7)[n]))
    return root
