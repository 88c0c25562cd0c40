"""SQL twins of the queries in ``testfiles``: what the files say, straight from the tables."""

from __future__ import annotations

from ..functions import fixed_values as fv
from . import testdata as td
from . import testdata_sql as base
from . import testfiles as tf

_CROPS = "crops(crop, name) AS (VALUES " + ", ".join(f"('{c}', '{n}')" for c, n in tf.CROPS.items()) + ")"
_STUDY = base._in([c for c in tf.CROPS.values() if c in fv.GRAIN_CROPS + fv.HAY_CROPS])


def _events(years: str = "") -> str:
    first, last = fv.IRRIGATION_DAYS
    return base._with(base.SHIP, base.CROPPED, _CROPS, """days AS (
  SELECT site, name, "Year", "DOY", l_returnflag, sum(l_quantity) AS q FROM cropped JOIN crops USING (crop) GROUP BY ALL)""") + f"""
SELECT l_returnflag AS simulation, name AS crop, "Year", CASE WHEN site % 2 = 0 THEN 'Drip' ELSE 'Pivot' END AS "Irrigation",
       count(*) AS n, sum(CAST(round(q * CASE WHEN site % 2 = 0 THEN {tf.SHARES['Drip']}::DOUBLE ELSE {tf.SHARES['Pivot']}::DOUBLE END
                                    * 100) AS BIGINT)) / 100.0::DOUBLE AS irrig1
FROM days WHERE l_returnflag IN {base._in(td.SCENARIOS)} AND name IN {_STUDY} AND "DOY" BETWEEN {first} AND {last} {years}
GROUP BY 1, 2, 3, 4"""


_CELLS = """cells AS (
  SELECT s_suppkey, s_nationkey, s_suppkey % 7 = 0 AS short, s_suppkey % 7 <> 0 AND s_suppkey % 11 = 0 AS long,
         printf('%.5f', s_suppkey / 16.0::DOUBLE) AS lat, printf('%.5f', -s_nationkey / 16.0::DOUBLE) AS lon FROM supplier)"""
_WET = ", ".join(f"('{c}', {f!r}::DOUBLE)" for c, f in tf.MOISTURE.items())
_UNIT = ", ".join([f"('{c}', {1 / fv.KG_PER_BUSHEL!r}::DOUBLE)" for c in fv.BUSHEL_CROPS]
                  + [f"('{c}', {fv.TON_PER_KG!r}::DOUBLE)" for c in fv.TON_CROPS]
                  + [f"('{c}', {fv.CWT_PER_KG!r}::DOUBLE)" for c in fv.CWT_CROPS])
_BASIN = base._with(base.SHIP, base.CROPPED, base.SEASON, base.PRICES, _CROPS, f"""wet(name, factor) AS (VALUES {_WET}),
sold(name, unit) AS (VALUES {_UNIT}),
grids AS (SELECT site, crop, CAST(count(*) AS DOUBLE) AS acres FROM cropped GROUP BY ALL),
valued AS (
  SELECT s.site, s.crop, name, s."Year", simulation, g.acres, irrig * {tf.SHARES['Pivot']}::DOUBLE AS irrig,
         yield_kgha * CASE WHEN name IN {base._in(fv.HAY_CROPS)} THEN 2 ELSE 1 END * factor AS wet,
         unit, price, CASE WHEN name = 'Onion' THEN 170 ELSE 250 END AS harvest
  FROM season s JOIN crops USING (crop) JOIN wet USING (name) JOIN sold USING (name) JOIN prices p ON p.crop = s.crop
       JOIN grids g ON g.site = s.site AND g.crop = s.crop
  WHERE name IN {_STUDY}),
pairs AS (
  SELECT s.*, b.irrig AS irrig0, b.wet * (b.acres * 0.405) AS total0, s.wet * (s.acres * 0.405) AS total
  FROM valued s JOIN valued b USING (site, crop, "Year")
  WHERE s.simulation IN {base._in(td.SCENARIOS)} AND b.simulation = '{td.BASE}'),
points AS (
  SELECT site, name, "Year", simulation, acres, CASE WHEN acrft < 0.01 THEN 0 ELSE acrft END AS acrft,
         CASE WHEN money < 1 THEN 0 ELSE money END AS money
  FROM (SELECT *, CASE WHEN irrig0 - irrig < 1 THEN 0 ELSE irrig0 - irrig END * 0.00328084 * acres AS acrft,
               total0 * unit * price - total * unit * price AS money FROM pairs WHERE harvest > {fv.BASIN_HARVEST_CUTOFF})),
curve AS (
  SELECT *, money / NULLIF(acrft, 0) AS cost,
         sum(acrft) OVER (PARTITION BY simulation, "Year" ORDER BY money / NULLIF(acrft, 0), name, CAST(site AS VARCHAR)
                          ROWS UNBOUNDED PRECEDING) AS cum
  FROM points WHERE acrft > 0)""")

_NUMBER = f"CASE WHEN r_name = '{tf.SPOILED_REGION}' THEN '{fv.SPOILED_STATION_ID[1]}' ELSE '1244' || r_regionkey END"

SQL = {
    "daily_files": _events(),
    "daily_tree": _events(f'AND "Year" BETWEEN {tf.DAILY_YEARS[0]} AND {tf.DAILY_YEARS[1]}'),

    "cell_files": "WITH " + _CELLS + """
SELECT DISTINCT lower(n_name) AS station, 'N' || n_nationkey AS "SITENO",
       CASE WHEN NOT short THEN lat || 'N' || replace(lon, '-', '') || 'W' END AS site
FROM cells JOIN nation ON s_nationkey = n_nationkey WHERE NOT long""",

    "long_cell_rows": "WITH " + _CELLS + """
SELECT 'C' || s_nationkey AS "StationCode", 'shifted' AS beyond, count(*) AS n, min(lat || '_' || lon) AS first_cell
FROM cells WHERE long AND s_nationkey < 12 GROUP BY 1, 2""",

    "single_basin": _BASIN + f"""
SELECT "Year", sum(acres) FILTER (WHERE cum <= {tf.BASIN_CUTOFF}) AS acres,
       max(cost) FILTER (WHERE cum < {tf.BASIN_CUTOFF}) AS target_cost,
       {fv.BARTER_PRICE_PER_ACFT * fv.BARTER_TARGET_ACFT!r}::DOUBLE
         / NULLIF(sum(acres) FILTER (WHERE cum <= {tf.BASIN_CUTOFF}), 0) AS price_per_acre,
       {fv.BARTER_TARGET_ACFT}::DOUBLE AS target_volume
FROM curve WHERE "Year" = {tf.BASIN_YEAR} GROUP BY "Year\"""",

    "rights_files": "WITH " + _CROPS + f""",
parts AS (
  SELECT p_partkey AS part, name AS crop, p_size::DOUBLE AS "Acres_PF",
         CASE WHEN p_partkey % 17 > 0 THEN 'B' || p_partkey % 9 END AS "WRIA",
         CASE WHEN p_size % 3 < 2 THEN '5/1/19' || lpad((p_partkey % 90 + 10)::VARCHAR, 2, '0') END AS "PriorityDate",
         'WR' || p_partkey % 50 AS "WRDocID", printf('%.5f', 40 + p_partkey % 100 / 16.0::DOUBLE) AS lat,
         printf('%.5f', -118 - p_partkey % 50 / 16.0::DOUBLE) AS long
  FROM part JOIN crops ON p_type = crops.crop)
SELECT part, crop, "Acres_PF", "WRIA", "PriorityDate", "WRDocID", lat, long,
       lat || 'N' || replace(long, '-', '') || 'W' AS grid, 2.5::DOUBLE AS field_lat
FROM parts
WHERE ("WRIA" IS NULL OR "WRIA" NOT IN {base._in(tf.RIGHTS_LEFT_OUT)}) AND "WRDocID" NOT IN (SELECT 'WR' || n_nationkey FROM nation)""",

    "gauge_files": base._with(base.REGION_DAYS, base.RULE_TEXT, base.RULE_VALUE, base.CALENDAR, f"""flows AS (
  SELECT station, {_NUMBER} AS number, CAST(year(l_shipdate) AS INTEGER) AS "Year", CAST(dayofyear(l_shipdate) AS INTEGER) AS "DOY", q
  FROM region_days JOIN region ON r_name = station),
extra AS (
  SELECT station, "Year", sum(q) * {td.AUG_SHARE} AS a FROM flows
  WHERE "DOY" BETWEEN {fv.RULE_DAYS[0]} AND {fv.RULE_DAYS[1]} GROUP BY ALL)""") + """
SELECT number AS "SITENO", lower(station) AS "SITENAME", "Year", "DOY", q AS "Discharge_cfs", "MIFR_rules", "Condition",
       a AS streamflow_aug_cfs, CASE WHEN q < "MIFR_rules" THEN 'Yes_Need' ELSE 'Not_Need' END AS "Aug_Need",
       CASE WHEN q < "MIFR_rules" AND a + q > "MIFR_rules" THEN 'YES' ELSE 'NO' END AS "Can_meet_MIFR"
FROM flows JOIN extra USING (station, "Year") JOIN calendar USING ("DOY")
     JOIN rules ON rules."Month" = calendar."Month" AND "MIFR_SITE_NAME" = station
WHERE "DOY" BETWEEN 120 AND 240""",

    "published_calendar": base.SQL["discharge_calendar"],
}
