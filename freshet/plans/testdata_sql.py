"""SQL twins of the queries in ``testdata``, for an independent engine."""

from __future__ import annotations

from ..functions import fixed_values as fv
from . import testdata as td

_WINDOWS = ", ".join(f"('{n}', {a}, {b}, '{s}', '{h}')" for n, a, b, s, h in fv.SCENARIO_WINDOWS)
_UNITS = ", ".join(f"('{c}', CAST({f!r} AS DOUBLE))" for c, f in td.UNITS)
_SHARES = ", ".join(f"('{c}', CAST({f!r} AS DOUBLE))" for c, f in td.NET_SHARE.items())
_WET = ", ".join(f"('{c}', CAST({f!r} AS DOUBLE))" for c, f in td.WET_FACTOR.items())
_GROUPS = ", ".join(f"('{c}', '{g}')" for c, g in td.GROUPS.items())


def _in(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# --- common table expressions ---------------------------------------------------
WIN = f"""win(simulation, start_date, stop_date, simulation_abb, simulation_half) AS (
  VALUES {_WINDOWS})"""
SHIP = """ship AS (
  SELECT l_suppkey AS site, l_partkey AS part, CAST(year(l_shipdate) AS INTEGER) AS "Year",
         CAST(dayofyear(l_shipdate) AS INTEGER) AS "DOY", l_quantity, l_extendedprice,
         l_discount, l_tax, l_returnflag, l_linestatus
  FROM lineitem)"""
SITES = """sites AS (
  SELECT s_suppkey AS site, n_name AS region, r_name AS basin
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
                JOIN region ON n_regionkey = r_regionkey)"""
BRIDGE = """bridge AS (
  SELECT site, region AS station FROM sites UNION ALL SELECT site, basin FROM sites)"""
CROPPED = """cropped AS (
  SELECT ship.*, p_type AS crop FROM ship JOIN part ON ship.part = p_partkey)"""
MEAN_PRICE = "sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0::DOUBLE / count(*)"
SEASON = f"""season AS (
  SELECT site, crop, "Year", l_returnflag AS simulation, avg(l_quantity) AS irrig,
         {MEAN_PRICE} AS yield_kgha, CAST(count(*) AS DOUBLE) AS acres
  FROM cropped GROUP BY ALL)"""
PRICES = """prices AS (
  SELECT p_type AS crop,
         sum(CAST(round(p_retailprice * 100) AS BIGINT)) / 100.0::DOUBLE / count(*) AS price
  FROM part GROUP BY p_type)"""
UNITS = f"""units(crop, factor) AS (VALUES {_UNITS})"""


def _impact(source: str) -> str:
    """impact: the comparison of ``source`` rows with the N season, valued."""
    return f"""base AS (SELECT * FROM season WHERE simulation = '{td.BASE}'),
pairs AS (
  SELECT s.site, s.crop, s."Year", s.simulation, b.acres,
         b.irrig AS irrig_opt, s.irrig, b.yield_kgha AS yield_opt, s.yield_kgha,
         b.yield_kgha * (b.acres * 0.405) AS total_opt, s.yield_kgha * (b.acres * 0.405) AS total
  FROM {source} s JOIN base b USING (site, crop, "Year")),
raw AS (
  SELECT pairs.*,
         CASE WHEN irrig_opt - irrig < 1 THEN 0 ELSE irrig_opt - irrig END AS mm,
         CASE WHEN total_opt - total < 1 THEN 0 ELSE total_opt - total END AS loss,
         irrig / NULLIF(irrig_opt, 0) * 100 AS pct_irrig,
         yield_kgha / NULLIF(yield_opt, 0) * 100 AS pct_yield,
         CASE WHEN factor IS NULL THEN 0 ELSE total * factor END AS sold,
         CASE WHEN factor IS NULL THEN 0 ELSE total_opt * factor END AS sold_opt,
         price
  FROM pairs LEFT JOIN units USING (crop) LEFT JOIN prices USING (crop)),
valued AS (
  SELECT raw.*, mm * 0.00328084 * acres AS acrft,
         mm * 0.00328084 * (acres * 43560) / 1296000 AS cfs,
         sold * price AS money, sold_opt * price - sold * price AS money_loss
  FROM raw),
impact AS (
  SELECT site, crop, "Year", simulation, acres, mm, cfs, pct_irrig, sold, sold_opt, money,
         100 - pct_irrig AS saved_pct, 100 - pct_yield AS reduction,
         CASE WHEN pct_yield > 100 THEN 100 ELSE pct_yield END AS pct_yield,
         CASE WHEN acrft < 0.01 THEN 0 ELSE acrft END AS acrft,
         CASE WHEN loss < 0 THEN 0 ELSE loss END AS loss,
         CASE WHEN money_loss < 1 THEN 0 ELSE money_loss END AS money_loss
  FROM valued)"""


FLAGGED = f"flagged AS (SELECT * FROM season WHERE simulation IN {_in(td.SCENARIOS)})"
FLAG_IMPACT = ",\n".join([SHIP, CROPPED, SEASON, PRICES, UNITS, FLAGGED, _impact("flagged")])
DAILY = """daily_raw AS (
  SELECT "Year", site, crop, "DOY", sum(l_quantity) AS irrig1 FROM cropped GROUP BY ALL),
harvest AS (
  SELECT "Year", site, crop, CAST(floor(avg("DOY")) AS INTEGER) AS harvest_date
  FROM cropped GROUP BY ALL),
daily AS (SELECT * FROM daily_raw JOIN harvest USING ("Year", site, crop))"""
DEMAND = """demand AS (
  SELECT "Year", site, crop, simulation, start_date + 5 AS target_harvest_date,
         sum(CASE WHEN harvest_date BETWEEN start_date AND start_date + 5 THEN 0
             ELSE irrig1 END) AS irrigation_demand_mm
  FROM daily JOIN win ON "DOY" BETWEEN start_date AND stop_date GROUP BY ALL)"""
FIELDS = f"""parts AS (
  SELECT site, part, p_type AS crop, p_brand, sum(l_quantity) AS part_size
  FROM ship JOIN part p ON ship.part = p.p_partkey GROUP BY ALL),
wholes AS (SELECT site, crop, sum(part_size) AS whole_size FROM parts GROUP BY ALL),
fields AS (
  SELECT site, crop, part, part_size, whole_size,
         part_size / NULLIF(whole_size, 0) AS fraction
  FROM parts JOIN wholes USING (site, crop)
  WHERE p_brand <> '{td.INTERRUPTIBLE_BRAND}')"""
def _share(measure: str, digits: int) -> str:
    """Whole units of what k of w get, halves up; measures are not negative."""
    return f"(2 * floor({measure} * 1e{digits}::DOUBLE + 0.5)::HUGEINT * k + w) // (2 * w)"


def _grid(apart: str = "") -> str:
    """Units of what the given parts of a row get; each of several wholes by itself."""
    return f"""sized AS (
  SELECT site, crop{apart}, sum(part_size)::HUGEINT AS k, max(whole_size)::HUGEINT AS w FROM fields GROUP BY ALL),
units_ AS (
  SELECT i.site, i.crop, i."Year", i.simulation, i.acres, sum(k)::DOUBLE AS part_acres,
         sum({_share('acrft', 6)})::BIGINT AS acrft_u, sum({_share('cfs', 6)})::BIGINT AS cfs_u,
         sum({_share('loss', 2)})::BIGINT AS loss_u, sum({_share('money_loss', 2)})::BIGINT AS money_u
  FROM impact i JOIN sized f ON i.site = f.site AND i.crop = f.crop
  GROUP BY i.site, i.crop, i."Year", i.simulation, i.acres),
grid AS (
  SELECT *, acrft_u / 1e6::DOUBLE AS acrft, cfs_u / 1e6::DOUBLE AS cfs, loss_u / 1e2::DOUBLE AS loss,
         money_u / 1e2::DOUBLE AS money_loss FROM units_)"""


GRID = _grid()
UNEQUAL_FIELDS = """parts AS (
  SELECT site, crop, l_linestatus, part, sum(l_quantity) AS part_size FROM cropped GROUP BY ALL),
wholes AS (SELECT site, crop, l_linestatus, sum(part_size) AS whole_size FROM parts GROUP BY ALL),
fields AS (
  SELECT site, crop, l_linestatus, part_size, whole_size
  FROM parts JOIN wholes USING (site, crop, l_linestatus) JOIN part ON parts.part = p_partkey
  WHERE p_brand <> '""" + td.INTERRUPTIBLE_BRAND + """')"""
GRID_ROWS = """
SELECT site, crop, "Year", simulation, acres AS "Acres", part_acres AS "Acres_PF",
       acrft AS streamflow_aug_acrft, cfs AS streamflow_aug_cfs, loss AS "WM_yield_loss",
       money_loss AS "Revenue_loss", money_loss / NULLIF(acrft, 0) AS cost_acrft,
       money_loss / NULLIF(acres, 0) AS cost_acr
FROM grid"""
SITE_TOTALS = """site_totals AS (
  SELECT site, "Year", simulation, sum(acres) AS acres, sum(acrft_u)::BIGINT AS acrft_u,
         sum(cfs_u)::BIGINT AS cfs_u, sum(money_u)::BIGINT AS money_u
  FROM grid GROUP BY ALL)"""


def _spread(fields: str) -> str:
    """shared: what each part of ``fields`` gets of a row, in units."""
    def part(measure: str, digits: int) -> str:
        upto = _share(measure, digits)
        return f"({upto} - {upto.replace('* k +', '* (k - p) +')})"
    return f"""placed AS (
  SELECT site, crop, part, fraction, part_size::HUGEINT AS p, whole_size::HUGEINT AS w,
         sum(part_size) OVER (PARTITION BY site, crop ORDER BY part ROWS UNBOUNDED PRECEDING)::HUGEINT AS k
  FROM {fields}),
shared AS (
  SELECT i.site, i.crop, i."Year", i.simulation, i.acrft, i.money_loss, part, fraction,
         {part('acrft', 6)} AS acrft_u, {part('money_loss', 2)} AS money_u
  FROM impact i JOIN placed f ON i.site = f.site AND i.crop = f.crop)"""


POINTS = """points AS (
  SELECT site, "Year", simulation, sum(l_quantity) AS vol,
         CAST(count(*) AS DOUBLE) AS acres,
         sum(CAST(round(l_extendedprice * l_discount * 10000) AS BIGINT)) / 10000.0::DOUBLE
           / NULLIF(sum(l_quantity), 0) AS cost
  FROM ship JOIN win ON "DOY" BETWEEN start_date AND stop_date GROUP BY ALL)"""


def _curve(key: str, source: str) -> str:
    return f"""curve AS (
  SELECT {key}, "Year", simulation, site, acres, vol, cost,
         sum(vol) OVER w AS cum, sum(acres) OVER w AS cum_size, row_number() OVER w AS rn
  FROM points JOIN {source} USING (site) WHERE cost IS NOT NULL
  WINDOW w AS (PARTITION BY {key}, "Year", simulation ORDER BY cost, site
               ROWS UNBOUNDED PRECEDING))"""


REGION_CURVE = ",\n".join([WIN, SHIP, SITES, POINTS, _curve("region", "sites")])
STATION_CURVE = ",\n".join([WIN, SHIP, SITES, BRIDGE, POINTS, _curve("station", "bridge")])

REGION_DAYS = """region_days AS (
  SELECT r_name AS station, CAST(month(l_shipdate) AS INTEGER) AS "Month", l_shipdate,
         sum(l_quantity) AS q
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL)"""
RULE_TEXT = """rule_text AS (
  SELECT "Month", station AS "MIFR_SITE_NAME",
         CAST(m // 1000 AS VARCHAR) || ',' || lpad(CAST(m % 1000 AS VARCHAR), 3, '0')
         || CASE WHEN "Month" IN (7, 8) THEN ' (Closure)' ELSE '' END AS "MIFR_rules"
  FROM (SELECT station, "Month", CAST(round(avg(q) * 100) AS BIGINT) AS m
        FROM region_days GROUP BY ALL))"""
RULE_VALUE = """rules AS (
  SELECT "Month", "MIFR_SITE_NAME",
         TRY_CAST(replace(replace("MIFR_rules", ' (Closure)', ''), ',', '') AS DOUBLE)
           AS "MIFR_rules",
         CASE WHEN "MIFR_rules" LIKE '%Closure%' THEN 'Closure' ELSE 'Open' END AS "Condition"
  FROM rule_text)"""
CALENDAR = """calendar AS (
  SELECT CAST(d AS INTEGER) AS "DOY",
         CAST(month(DATE '2001-01-01' + CAST(d - 1 AS INTEGER)) AS INTEGER) AS "Month"
  FROM range(1, 366) t(d))"""

VERDICTS = ",\n".join([WIN, SITES, BRIDGE, CALENDAR, """days AS (
  SELECT station, CAST(year(l_shipdate) AS INTEGER) AS "Year",
         CAST(month(l_shipdate) AS INTEGER) AS "Month",
         CAST(dayofyear(l_shipdate) AS INTEGER) AS "DOY", sum(l_quantity) AS q
  FROM lineitem JOIN bridge ON l_suppkey = site GROUP BY ALL),
month_rules AS (
  SELECT station, "Month", avg(q) AS r FROM days GROUP BY ALL),
day_rules AS (
  SELECT station, "DOY", r FROM month_rules JOIN calendar USING ("Month")
  WHERE "DOY" BETWEEN 120 AND 240),
inside AS (
  SELECT station, "Year", simulation, "DOY", q
  FROM days JOIN win ON "DOY" BETWEEN start_date AND stop_date),
extra AS (
  SELECT station, "Year", simulation, sum(q) * 0.02 AS a FROM inside GROUP BY ALL),
v AS (
  SELECT station, "Year", simulation, "DOY", q, a, r, a + q AS total, q < r AS need,
         r - q AS d,
         CASE WHEN q < r AND a + q > r THEN 'YES' ELSE 'NO' END AS can,
         CASE WHEN q < r AND q < r * 0.75 AND a + q > r * 0.75 THEN 'YES' ELSE 'NO' END AS can75,
         CASE WHEN q < r AND q < r * 0.75 AND q < r * 0.5 AND a + q > r * 0.5
              THEN 'YES' ELSE 'NO' END AS can50,
         CASE WHEN a + q >= r THEN 100 ELSE a / NULLIF(r - q, 0) * 100 END AS pct
  FROM inside JOIN extra USING (station, "Year", simulation)
       JOIN day_rules USING (station, "DOY"))"""])
RUNS = VERDICTS + """,
kept AS (
  SELECT * FROM (SELECT v.*, bool_or(need) OVER (PARTITION BY station, "Year", simulation) AS any_
                 FROM v) WHERE any_ AND need),
runs AS (
  SELECT * FROM (
    SELECT kept.*, "DOY" - lag("DOY") OVER g AS back, lead("DOY") OVER g - "DOY" AS ahead
    FROM kept WINDOW g AS (PARTITION BY station, "Year", simulation ORDER BY "DOY"))
  WHERE back = 1 OR ahead = 1)"""
PULSE = RUNS + """,
pairs AS (
  SELECT runs.*, "DOY" - lag("DOY") OVER g AS step, lag(d) OVER g AS before
  FROM runs WINDOW g AS (PARTITION BY station, "Year", simulation ORDER BY "DOY")),
sums AS (
  SELECT pairs.*, CASE WHEN step = 1 THEN d + before END AS two FROM pairs),
least AS (
  SELECT sums.*, min(two) OVER (PARTITION BY station, "Year", simulation) AS smallest FROM sums),
larger AS (
  SELECT least.*, CASE WHEN two = smallest THEN greatest(d, before) END AS larger FROM least),
pulse AS (
  SELECT station, "Year", simulation, max(larger) AS req,
         max(larger) * 1296000 / 43560 AS req_acft
  FROM larger GROUP BY ALL)"""
_PRICED = """,
need AS (SELECT station, "Year", simulation, req_acft AS need FROM pulse),
j AS (SELECT n.station, n."Year", n.simulation, n.need, c.cost, c.cum, c.rn, c.acres
      FROM need n JOIN curve c ON n.station = c.station AND n."Year" = c."Year"
                              AND n.simulation = c.simulation),
picked AS (
  SELECT station, "Year", simulation, need,
         arg_min(cost, rn) FILTER (WHERE cum >= need) AS hit_cost,
         arg_min(cum, rn) FILTER (WHERE cum >= need) AS hit_cum,
         arg_max(cost, rn) FILTER (WHERE cum <= need) AS miss_cost,
         arg_min(cost, rn) FILTER (WHERE cum >= need * 0.5) AS half_cost,
         arg_min(cum, rn) FILTER (WHERE cum >= need * 0.5) AS half_cum,
         arg_min(cost, rn) FILTER (WHERE cum <= need * 0.5) AS first_cost,
         arg_min(cum, rn) FILTER (WHERE cum <= need * 0.5) AS first_cum
  FROM j GROUP BY ALL),
choice AS (
  SELECT station, "Year", simulation, need, coalesce(hit_cost, miss_cost) AS mc,
         CASE WHEN hit_cost IS NOT NULL THEN hit_cum ELSE need END AS vol,
         CASE WHEN hit_cost IS NOT NULL THEN 'YES' ELSE 'NO' END AS meets,
         coalesce(half_cost, first_cost) AS mc50, coalesce(half_cum, first_cum) AS vol50
  FROM picked),
areas AS (
  SELECT c.station, c."Year", c.simulation,
         sum(j.acres) FILTER (WHERE j.cost <= mc AND j.cum <= vol) AS acres
  FROM choice c JOIN j ON c.station = j.station AND c."Year" = j."Year"
                      AND c.simulation = j.simulation GROUP BY ALL),
priced AS (
  SELECT n.station, n."Year", n.simulation, n.need, meets, coalesce(mc, 0) AS mc,
         coalesce(vol, 0) AS vol, coalesce(mc50, 0) AS mc50, coalesce(vol50, 0) AS vol50,
         coalesce(acres, 0) AS acres, coalesce(mc, 0) * n.need AS cost_total,
         coalesce(mc, 0) * n.need / NULLIF(coalesce(acres, 0), 0) AS cost_acre,
         coalesce(mc, 0) * n.need / NULLIF(n.need, 0) AS cost_af
  FROM need n LEFT JOIN choice USING (station, "Year", simulation)
              LEFT JOIN areas USING (station, "Year", simulation))"""
#: the same with a row for every different need of a key
_PRICED_MANY = _PRICED.replace("need AS (SELECT station, \"Year\", simulation, req_acft AS need FROM pulse)",
                               "need AS (SELECT DISTINCT station, \"Year\", simulation, d * 1296000 / 43560 AS need FROM runs)")
for _old, _new in (
        ("""c.simulation = j.simulation GROUP""", """c.simulation = j.simulation AND c.need = j.need GROUP"""),
        ("SELECT c.station, c.\"Year\", c.simulation,\n         sum(", "SELECT c.station, c.\"Year\", c.simulation, c.need,\n         sum("),
        ("choice USING (station, \"Year\", simulation)", "choice USING (station, \"Year\", simulation, need)"),
        ("areas USING (station, \"Year\", simulation)", "areas USING (station, \"Year\", simulation, need)")):
    assert _old in _PRICED_MANY
    _PRICED_MANY = _PRICED_MANY.replace(_old, _new)
LOOKUP = PULSE + ",\n" + ",\n".join([SHIP, POINTS, _curve("station", "bridge")]) + _PRICED
LOOKUP_MANY = PULSE + ",\n" + ",\n".join([SHIP, POINTS, _curve("station", "bridge")]) + _PRICED_MANY
#: several curves a station, one after the other
LOOKUP_REGIONS = PULSE + ",\n" + ",\n".join([SHIP, POINTS]) + """,
nations AS (
  SELECT basin AS station, region, "Year", simulation, site, acres, vol, cost,
         sum(vol) OVER (PARTITION BY basin, region, "Year", simulation ORDER BY cost, site
                        ROWS UNBOUNDED PRECEDING) AS cum
  FROM points JOIN sites USING (site) WHERE cost IS NOT NULL),
curve AS (
  SELECT nations.*, row_number() OVER (PARTITION BY station, "Year", simulation
                                       ORDER BY region, cost, site) AS rn FROM nations)""" + _PRICED
PRICED_ROWS = """
SELECT station, "Year", simulation, need AS need, meets AS meets_need,
       mc AS "MC_Cost", vol AS nearest_cum_stream, mc50 AS "MC_Cost_50",
       vol50 AS nearest_cum_stream_50, acres AS "Contributing_acres",
       cost_total AS "Total_Cost", cost_acre AS "Cost_acre",
       cost_af AS "cost_AF"
FROM priced"""
MET = LOOKUP + """,
able AS (SELECT * FROM runs WHERE can = 'YES'),
met AS (
  SELECT s.*, p.cost_total, p.cost_acre, p.cost_af FROM (
    SELECT station, "Year", simulation, "DOY", "DOY" - lag("DOY") OVER g AS b2,
           lead("DOY") OVER g - "DOY" AS a2
    FROM able WINDOW g AS (PARTITION BY station, "Year", simulation ORDER BY "DOY")) s
  JOIN priced p USING (station, "Year", simulation) WHERE b2 = 1 OR a2 = 1)"""
CROP_ACRES = f"""groups(crop, group1) AS (VALUES {_GROUPS}),
crop_sites AS (
  SELECT site, crop, avg(acres) AS acres FROM season WHERE simulation = '{td.SCENARIOS[0]}'
  GROUP BY ALL),
crop_acres AS (
  SELECT station, group1, sum(acres) AS acres
  FROM crop_sites JOIN groups USING (crop) JOIN bridge USING (site) GROUP BY ALL)"""


def _bin(value: str, bins, closed: bool) -> str:
    arms = []
    for i, (low, high, label) in enumerate(bins):
        left = ">=" if closed and i == 0 else ">"
        right = "<" if high == 100 else "<="
        arms.append(f"WHEN {value} {left} {low} AND {value} {right} {high} THEN '{label}'")
    return (f"CASE {' '.join(arms)} WHEN {value} = 100 THEN '{fv.FULL_PERCENT_LABEL}' "
            f"ELSE '{fv.NO_PERCENT_LABEL}' END")


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _box(source: str, keys: str, value: str, digits: str) -> str:
    """Box summary of ``source``(keys, v)."""
    r = (lambda c: f"round({c}, {digits})") if digits else (lambda c: c)
    return f"""boxes AS (
  SELECT {keys}, quantile_cont({value}, 0.25) AS lower, quantile_cont({value}, 0.5) AS middle,
         quantile_cont({value}, 0.75) AS upper
  FROM {source} GROUP BY ALL)
SELECT {', '.join('s.' + c.strip() for c in keys.split(','))},
       {r('b.lower')} AS lower, {r('b.middle')} AS middle, {r('b.upper')} AS upper,
       min(s.{value}) FILTER (WHERE s.{value} BETWEEN b.lower - 1.5 * (b.upper - b.lower)
                                     AND b.upper + 1.5 * (b.upper - b.lower)) AS ymin,
       max(s.{value}) FILTER (WHERE s.{value} BETWEEN b.lower - 1.5 * (b.upper - b.lower)
                                     AND b.upper + 1.5 * (b.upper - b.lower)) AS ymax,
       CAST(count(*) AS BIGINT) AS n,
       CAST(count(*) FILTER (WHERE s.{value} NOT BETWEEN b.lower - 1.5 * (b.upper - b.lower)
                                     AND b.upper + 1.5 * (b.upper - b.lower)) AS BIGINT)
         AS outliers
FROM {source} s JOIN boxes b USING ({keys})
GROUP BY {', '.join('s.' + c.strip() for c in keys.split(','))}, b.lower, b.middle, b.upper"""


_MATRIX = ",\n       ".join(
    f"max(CASE WHEN simulation = '{n}' THEN pct END) AS \"{label}\"" for n, label in td.HALVES.items())
_WIDE = ",\n       ".join(
    f"round(max(CASE WHEN group1 = '{g}' THEN acres END), 6) AS \"{g}\"" for g in fv.CROP_GROUP_ORDER)

YEARS = VERDICTS + """,
spans AS (SELECT station, max("Year") - min("Year") + 1 AS years FROM v GROUP BY ALL)"""

ORDER_RUNS = f"""gaps AS (
  SELECT o_orderstatus, o_orderkey AS k, {td.RUN_PRICE} - o_totalprice AS d FROM orders WHERE o_totalprice < {td.RUN_PRICE}),
beside AS (
  SELECT *, k - lag(k) OVER w AS back, lead(k) OVER w - k AS ahead, lag(d) OVER w AS before
  FROM gaps WINDOW w AS (PARTITION BY o_orderstatus ORDER BY k)),
runs AS (SELECT *, CASE WHEN back = 1 THEN d + before END AS two FROM beside WHERE back = 1 OR ahead = 1),
least AS (SELECT o_orderstatus, min(two) AS two FROM runs GROUP BY ALL),
pulses AS (
  SELECT o_orderstatus, max(greatest(d, before)) AS req FROM runs JOIN least USING (o_orderstatus, two) GROUP BY ALL)"""
_CROP_ROWS = ", ".join(
    f"({i}, '{c}', '{'Annual_crop' if c in fv.GRAIN_CROPS else 'Hay_crop'}', '{g}', {fv.CROP_GROUP_ORDER.index(g) + 1}, "
    f"'{fv.CROP_DISPLAY_NAMES.get(c, c)}', {fv.CROP_DISPLAY_ORDER.index(fv.CROP_DISPLAY_NAMES.get(c, c)) + 1})"
    for i, c in enumerate(td.STUDY_CROPS)
    for g in ["Corn and onion" if c in fv.CORN_AND_ONION else "Grain crops" if c in fv.GRAIN_CROPS else "Hay crops"])
_STATION_ROWS = ", ".join(
    f"({i}, '{short}', '{code or short}', {repr(number) if number else 'NULL'}, {fv.STATION_NAME_ORDER.index(short) + 1}, "
    f"{fv.STATION_CODE_ORDER.index(code or short) + 1}, {fv.STATION_RATIO_ORDER.index(code or short) + 1})"
    for i, (_, short, code, number) in enumerate(fv.STATIONS))

SQL = {
    "order_runs": _with(ORDER_RUNS) + """
SELECT o_orderstatus, k AS o_orderkey, d AS deficit, req AS "Req_aug", req * 1296000 / 43560 AS "Req_aug_Acft",
       req * 1296000 / 43560 * 0.5 AS "Fiftyp_aug"
FROM runs JOIN pulses USING (o_orderstatus)""",

    "order_pulse": _with(ORDER_RUNS) + """
SELECT o_orderstatus, req AS "Req_aug", req * 1296000 / 43560 AS "Req_aug_Acft",
       req * 1296000 / 43560 * 0.5 AS "Fiftyp_aug"
FROM pulses""",

    "any_order_groups": f"""
SELECT o_custkey, o_orderkey, o_totalprice FROM orders
WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > {td.KEEP_PRICE})""",

    "event_windows": """
WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 3.6e9::DOUBLE AS at_ FROM events)
SELECT w.event_id AS error_id, count(*) AS n, min(e.event_id) AS first_id, max(e.event_id) AS last_id,
       sum(CAST(round(e.value * 100) AS BIGINT)) / 100.0::DOUBLE AS value
FROM e w JOIN e ON e.user_id = w.user_id AND e.at_ BETWEEN w.at_ AND w.at_ + w.value * 20
WHERE w.event_type = 'error' GROUP BY w.event_id""",

    "crop_labels": f"""
SELECT crop, n, size, crop_kind, crop_group, group_rank, crop_name, crop_rank
FROM (SELECT p_partkey % {len(td.STUDY_CROPS)} AS i, count(*) AS n, sum(p_size)::BIGINT AS size FROM part GROUP BY 1)
JOIN (VALUES {_CROP_ROWS}) c(i, crop, crop_kind, crop_group, group_rank, crop_name, crop_rank) USING (i)""",

    "station_orders": f"""
SELECT station, label, "SITENO", qty, name_rank, code_place, ratio_place,
       row_number() OVER (ORDER BY name_rank) AS nth_by_name, row_number() OVER (ORDER BY code_place) AS nth_by_code,
       row_number() OVER (ORDER BY ratio_place) AS nth_by_ratio
FROM (SELECT s_nationkey % {len(fv.STATIONS)} AS i, sum(l_quantity) AS qty
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)
JOIN (VALUES {_STATION_ROWS}) s(i, station, label, "SITENO", name_rank, code_place, ratio_place) USING (i)""",

    "crop_mix_rest": _with(SHIP, CROPPED, SEASON, SITES, BRIDGE, CROP_ACRES) + """
SELECT station, """ + ", ".join(
        f"round(max(CASE WHEN group1 = '{g}' THEN acres END), 6) AS \"{g}\"" for g in fv.CROP_GROUP_ORDER[:2]) + """,
       round(sum(CASE WHEN group1 NOT IN (""" + ", ".join(f"'{g}'" for g in fv.CROP_GROUP_ORDER[:2]) + """) THEN acres END), 6)
         AS "Other"
FROM crop_acres GROUP BY station""",

    "scenario_window_join": _with(WIN, SHIP) + """
SELECT simulation, start_date, "Year", count(*) AS n, sum(l_quantity) AS qty,
       min("DOY") AS first_day, max("DOY") AS last_day
FROM ship JOIN win ON "DOY" BETWEEN start_date AND stop_date GROUP BY ALL""",

    "window_labels": _with(WIN, SHIP) + """
SELECT simulation_abb, simulation_half, count(*) AS n
FROM ship LEFT JOIN win ON "DOY" BETWEEN start_date AND stop_date GROUP BY ALL""",

    "ratio_null_on_zero": """
SELECT l_discount, l_tax, count(*) AS n, round(l_tax / NULLIF(l_discount, 0), 6)
       AS tax_per_discount
FROM lineitem GROUP BY l_discount, l_tax""",

    "negated_membership": _with(SHIP) + """
SELECT l_returnflag, "Year", count(*) AS n, sum(l_quantity) AS qty FROM ship
WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_acctbal < 0 AND s_suppkey = site)
GROUP BY ALL""",

    "table_membership": _with(SHIP) + """
SELECT l_returnflag, "Year", count(*) AS n, sum(l_quantity) AS qty FROM ship
WHERE EXISTS (SELECT 1 FROM supplier WHERE s_acctbal < 0 AND s_suppkey = site)
GROUP BY ALL""",

    "complete_cases": _with(SHIP) + """
SELECT l_returnflag, "Year", count(*) AS n, sum(l_quantity) AS qty,
       round(sum(l_tax / NULLIF(l_discount, 0)), 5) AS rate
FROM ship WHERE l_tax / NULLIF(l_discount, 0) IS NOT NULL GROUP BY ALL""",

    "discharge_calendar": """
SELECT CAST(year(o_orderdate) AS INTEGER) AS "Year", CAST(month(o_orderdate) AS INTEGER)
       AS "Month", CAST(day(o_orderdate) AS INTEGER) AS "Day",
       CAST(dayofyear(o_orderdate) AS INTEGER) AS "DOY",
       round(sum(o_totalprice), 2) AS "Discharge_cfs"
FROM orders GROUP BY o_orderdate""",

    "grid_factors": _with(SHIP, CROPPED, f"""shares(kind, share) AS (VALUES {_SHARES}),
wet(crop, factor) AS (VALUES {_WET}),
year_rows AS (
  SELECT site, crop, "Year", sum(l_quantity) AS q, count(*) AS n FROM cropped GROUP BY ALL),
grid_rows AS (
  SELECT site, crop, l_linestatus AS kind, CAST(count(*) AS DOUBLE) AS acres
  FROM cropped GROUP BY ALL)""") + """
SELECT site, crop, "Year", kind AS "Irrigation", q * share AS irrig, n * factor AS wet_rows,
       acres AS "Acres", acres * 0.405 AS area_ha_opt
FROM year_rows JOIN grid_rows USING (site, crop) JOIN shares USING (kind) JOIN wet USING (crop)
WHERE q * share > 0""",

    "basin_impact": _with(SHIP, CROPPED, f"""season AS (
  SELECT site, crop, "Year", l_returnflag AS simulation, l_linestatus AS planting_date,
         avg(l_quantity) AS irrig, {MEAN_PRICE} AS yield_kgha, CAST(count(*) AS DOUBLE) AS acres
  FROM cropped GROUP BY ALL),
both_ AS (
  SELECT s.crop, s."Year", s.simulation, s.planting_date, b.acres, s.irrig, b.irrig AS irrig0,
         CASE WHEN b.irrig - s.irrig < 1 THEN 0 ELSE b.irrig - s.irrig END AS mm,
         b.yield_kgha * (b.acres * 0.405) - s.yield_kgha * (b.acres * 0.405) AS lost
  FROM season s JOIN season b ON s.site = b.site AND s.crop = b.crop AND s."Year" = b."Year"
  WHERE b.simulation = '{td.BASE}' AND s.simulation IN {_in(td.SCENARIOS)})""") + """
SELECT crop, "Year", simulation, planting_date, count(*) AS n,
       round(sum(mm * 0.00328084 * acres), 9) AS volume,
       max(CASE WHEN lost < 1 THEN 0 ELSE lost END) AS largest_loss,
       min(irrig / NULLIF(irrig0, 0) * 100) AS least_irrig
FROM both_ GROUP BY crop, "Year", simulation, planting_date""",

    "unify_measure": _with(SHIP, CROPPED) + f"""
SELECT crop, CASE WHEN crop IN {_in(td.GRAIN)} THEN 'grain' ELSE 'hay' END AS kind,
       count(*) AS n,
       round(sum(CASE WHEN crop IN {_in(td.GRAIN)} THEN l_quantity ELSE l_extendedprice END), 2)
         AS measure
FROM cropped WHERE crop IN {_in(td.GRAIN + td.HAY)} GROUP BY ALL""",

    "impact_vs_baseline": _with(FLAG_IMPACT, SITES) + """
SELECT region, site, crop, "Year", simulation, acres AS "Acres",
       mm AS streamflow_aug_mm, acrft AS streamflow_aug_acrft,
       cfs AS streamflow_aug_cfs, loss AS "WM_yield_loss",
       pct_irrig AS "Percentage_irrig", 100 - pct_irrig AS "Per_irrig_saved",
       pct_yield AS "Percentage_yield",
       100 - pct_yield AS "Per_yield_reduction"
FROM valued JOIN sites USING (site)""",

    "price_outcome": _with(SHIP, CROPPED, SEASON, PRICES, UNITS) + """
SELECT site, crop, "Year", simulation,
       CASE WHEN factor IS NULL THEN 0 ELSE yield_kgha * (acres * 0.405) * factor END
         AS sold_unit,
       CASE WHEN factor IS NULL THEN 0 ELSE yield_kgha * (acres * 0.405) * factor END
             * price AS economic_return
FROM season LEFT JOIN units USING (crop) LEFT JOIN prices USING (crop)""",

    "impact_clamps": _with(FLAG_IMPACT) + """
SELECT site, crop, "Year", simulation, pct_yield AS "Percentage_yield",
       acrft AS streamflow_aug_acrft, loss AS "WM_yield_loss",
       money_loss AS "Revenue_loss",
       money_loss / NULLIF(acrft, 0) AS "Cost_acre_ft",
       money_loss / NULLIF(acres, 0) AS "Cost_acre"
FROM impact""",

    "per_acre_measures": _with(FLAG_IMPACT) + """
SELECT site, crop, "Year", simulation, loss / acres AS yield_loss_acre,
       (sold_opt - sold) / acres + 0.0 AS "Production_loss_acre",
       money / acres AS "Economic_return_ac",
       money_loss / acres AS "Revenue_loss_acre",
       sold / acres AS "Production_acre"
FROM impact""",

    "window_demand": _with(WIN, SHIP, CROPPED, DAILY, DEMAND) + "SELECT * FROM demand",

    "impact_table": _with(WIN, SHIP, CROPPED, SEASON, PRICES, UNITS, DAILY, DEMAND, f"""windowed AS (
  SELECT site, crop, "Year", simulation, avg(l_quantity) AS irrig,
         {MEAN_PRICE} AS yield_kgha
  FROM cropped JOIN win ON "DOY" BETWEEN start_date AND stop_date
  WHERE l_returnflag IN {_in(td.SCENARIOS)} GROUP BY ALL)""", _impact("windowed"), """full_impact AS (
  SELECT i.site, i.crop, i."Year", i.simulation, acres, money_loss,
         coalesce(irrigation_demand_mm, 0) AS mm_demand
  FROM impact i LEFT JOIN demand d ON i.site = d.site AND i.crop = d.crop
       AND i."Year" = d."Year" AND i.simulation = d.simulation)""") + """
SELECT site, crop, "Year", simulation, acres AS "Acres", mm_demand AS irrigation_demand_mm,
       mm_demand * 0.00328084 * acres AS streamflow_aug_acrft,
       mm_demand * 0.00328084 * (acres * 43560) / 1296000 AS streamflow_aug_cfs,
       money_loss AS "Revenue_loss",
       money_loss / NULLIF(mm_demand * 0.00328084 * acres, 0) AS "Cost_acre_ft",
       money_loss / NULLIF(acres, 0) AS "Cost_acre"
FROM full_impact""",

    "apportion_to_parts": _with(FLAG_IMPACT, FIELDS, _spread("fields")) + """
SELECT site, crop, part, count(*) AS n, max(fraction) AS fraction,
       sum(acrft_u)::BIGINT / 1e6::DOUBLE AS volume, sum(money_u)::BIGINT / 1e2::DOUBLE AS loss
FROM shared GROUP BY site, crop, part""",

    "shares_add_up": _with(FLAG_IMPACT, FIELDS, """every AS (
  SELECT site, crop, part, part_size, whole_size, 0 AS fraction FROM parts JOIN wholes USING (site, crop))""",
                           _spread("every")) + """
SELECT site, crop, "Year", simulation, acrft AS streamflow_aug_acrft, money_loss AS "Revenue_loss", count(*) AS parts,
       floor(acrft * 1e6::DOUBLE + 0.5)::BIGINT / 1e6::DOUBLE AS volume,
       floor(money_loss * 1e2::DOUBLE + 0.5)::BIGINT / 1e2::DOUBLE AS loss
FROM shared GROUP BY ALL""",

    "field_to_grid": _with(FLAG_IMPACT, FIELDS, GRID) + GRID_ROWS,

    "field_to_grid_unequal": _with(FLAG_IMPACT, UNEQUAL_FIELDS, _grid(", l_linestatus")) + GRID_ROWS,

    "field_rights": _with(SHIP, CROPPED, """grids AS (
  SELECT site, crop, l_linestatus, CAST(count(*) AS DOUBLE) AS acres FROM cropped GROUP BY ALL
  HAVING count(*) > 4),
owned AS (
  SELECT site, crop, l_linestatus, part, sum(l_quantity) AS part_size,
         CAST(round(min(l_tax) * 100) AS INTEGER) AS number
  FROM cropped GROUP BY ALL)""") + """
SELECT site, crop, l_linestatus, part, part_size AS "Acres_PF", acres AS "Acres",
       'WR' || number AS "WRDocID", part_size / NULLIF(acres, 0) AS fraction_acres
FROM owned JOIN grids USING (site, crop, l_linestatus)
WHERE number > 0 AND number NOT IN (SELECT r_regionkey FROM region)""",

    "daily_demand": _with(WIN, SHIP, CROPPED, """base AS (
  SELECT "Year", site, crop, l_linestatus AS "Irrigation", CAST(floor(avg("DOY")) AS INTEGER) AS harvest_date
  FROM cropped WHERE l_returnflag = 'N' GROUP BY ALL),
days AS (SELECT "Year", site, crop, "DOY", sum(l_quantity) AS irrig1 FROM cropped GROUP BY ALL)""") + """
SELECT "Year", site, crop, "Irrigation", simulation, start_date + 5 AS target_harvest_date,
       sum(CASE WHEN harvest_date >= start_date AND harvest_date <= start_date + 5 THEN 0 ELSE irrig1 END)
         AS irrigation_demand_mm
FROM days JOIN base USING ("Year", site, crop) JOIN win ON "DOY" BETWEEN start_date AND stop_date
GROUP BY ALL""",

    "running_totals_nulls": """
WITH rows_ AS (
  SELECT l_linestatus, CAST(month(l_shipdate) AS INTEGER) AS "Month", l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
         CASE WHEN l_discount > 0.05 THEN l_quantity END AS qty FROM lineitem)
SELECT l_linestatus, "Month", l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       sum(qty) OVER (PARTITION BY l_linestatus, "Month" ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
                      ROWS UNBOUNDED PRECEDING) AS run,
       sum(qty) OVER (PARTITION BY l_linestatus, "Month") AS total
FROM rows_""",

    "grid_rollup": _with(FLAG_IMPACT, FIELDS, GRID, SITE_TOTALS, SITES) + """
SELECT region, site, "Year", simulation, acres AS "T_Acres",
       acrft_u / 1e6::DOUBLE AS "Streamflow_aug_vol_acft", cfs_u / 1e6::DOUBLE AS streamflow_aug_cfs,
       money_u / 1e2::DOUBLE AS "T_Revenue_loss",
       (money_u / 1e2::DOUBLE) / NULLIF(acrft_u / 1e6::DOUBLE, 0) AS cost_per_acft_v
FROM site_totals JOIN sites USING (site)""",

    "gauge_rollup": _with(FLAG_IMPACT, FIELDS, GRID, SITE_TOTALS, SITES, BRIDGE) + """
SELECT station, "Year", simulation, sum(acrft_u)::BIGINT / 1e6::DOUBLE AS "Streamflow_aug_vol_acft",
       sum(cfs_u)::BIGINT / 1e6::DOUBLE AS streamflow_aug_cfs
FROM site_totals JOIN bridge USING (site) GROUP BY ALL""",

    "supply_curve": _with(REGION_CURVE) + """
SELECT region, "Year", simulation, site, acres AS "Acres", vol AS streamflow_aug_acrft,
       cost AS cost_acrft, cum AS cum_streamflow FROM curve""",

    "nested_supply_curves": _with(STATION_CURVE) + """
SELECT station, "Year", simulation, site, cost AS cost_acrft, cum AS cum_streamflow, cum_size
FROM curve""",

    "curve_slice": _with(STATION_CURVE) + f"""
SELECT station, "Year", simulation, site, cost AS cost_acrft, cum AS cum_streamflow
FROM curve WHERE "Year" = 1998 AND simulation IN {_in(fv.EXAMPLE_SCENARIOS)}
  AND station IN ('ASIA', 'NATION_7')""",

    "barter_price": _with(REGION_CURVE) + """
SELECT region, "Year", simulation, sum(acres) FILTER (WHERE cum <= 131) AS acres,
       max(cost) FILTER (WHERE cum < 131) AS target_cost,
       round(17.87 * 115.74 / sum(acres) FILTER (WHERE cum <= 131), 6) AS price_per_acre,
       CAST(115.74 AS DOUBLE) AS target_volume
FROM curve GROUP BY region, "Year", simulation""",

    "rules_unpivot": _with(REGION_DAYS, RULE_TEXT) + "SELECT * FROM rule_text",

    "rule_text_parse": _with(REGION_DAYS, RULE_TEXT, RULE_VALUE) + "SELECT * FROM rules",

    "rules_to_days": _with(REGION_DAYS, RULE_TEXT, RULE_VALUE, CALENDAR) + """
SELECT "MIFR_SITE_NAME", r_regionkey AS "SITENO", "Month", "DOY", "MIFR_rules", "Condition"
FROM rules JOIN region ON r_name = "MIFR_SITE_NAME" JOIN calendar USING ("Month")
WHERE "DOY" BETWEEN 120 AND 240""",

    "deficit_verdicts": _with(VERDICTS) + """
SELECT station, "Year", simulation, "DOY", q AS "Discharge_cfs", a AS streamflow_aug_cfs,
       r AS "MIFR_rules", total AS "Contributing_flow", can AS "Can_meet_MIFR",
       CASE WHEN need THEN 'Yes_Need' ELSE 'Not_Need' END AS "Aug_Need",
       d + 0.0 AS "MIFR_Dff",
       CASE WHEN d <= 0 THEN 0 ELSE d END AS "MIFR_Dff1",
       CASE WHEN r > q THEN d ELSE 0 END AS "Aug_2_mt_MIFR",
       pct AS "Percentage_aug", r * 0.75 AS "MIFR_R_75",
       r * 0.5 AS "MIFR_R_50", can75 AS "Can_meet_MIFR_75", can50 AS "Can_meet_MIFR_50",
       CASE WHEN can = 'NO' THEN pct ELSE 0 END AS "per_aug_not_meet_MIFR"
FROM v""",

    "any_need_groups": _with(VERDICTS) + """
SELECT station, "Year", simulation, count(*) AS n_days FROM v
GROUP BY ALL HAVING bool_or(can = 'YES')""",

    "consecutive_runs": _with(RUNS) + """
SELECT station, "Year", simulation, "DOY", d AS "MIFR_Dff" FROM runs""",

    "required_pulse": _with(PULSE) + """
SELECT station, "Year", simulation, req AS "Req_aug",
       req_acft AS "Req_aug_Acft", req_acft * 0.5 AS "Fiftyp_aug"
FROM pulse""",

    "aug_ratio": _with(PULSE) + """
SELECT station, "Year", simulation, "DOY", larger AS "MaxOfTwo",
       a / NULLIF(d, 0) AS "RelativeRatioOfAug",
       CASE WHEN a / NULLIF(d, 0) > 1 THEN 1 ELSE a / NULLIF(d, 0) END
         AS "RelativeRatioOfAug_adj",
       larger * 1296000 / 43560 AS "Req_aug_acft",
       a * 1296000 / 43560 AS "Aug_avail_acft"
FROM (SELECT larger.*, max(larger) OVER (PARTITION BY station, "Year", simulation) AS most
      FROM larger WHERE larger IS NOT NULL)
WHERE larger = most""",

    "curve_lookup": _with(LOOKUP) + PRICED_ROWS,

    "curve_lookup_regions": _with(LOOKUP_REGIONS) + PRICED_ROWS,

    "curve_lookup_many": _with(LOOKUP_MANY) + PRICED_ROWS,

    "need_days_with_pulse": _with(PULSE) + """
SELECT station, "Year", simulation, "DOY", d AS "MIFR_Dff", req AS "Req_aug",
       req_acft AS "Req_aug_Acft", req_acft * 0.5 AS "Fiftyp_aug"
FROM runs JOIN pulse USING (station, "Year", simulation)""",

    "mean_cost_matrix": _with(MET) + """
SELECT station, simulation, 'Yes_Need' AS "Aug_Need", 'YES' AS "Can_meet_MIFR",
       round_even(avg(t), 0) AS "Total_Cost", round_even(avg(ca), 0) AS "Cost_acre",
       round_even(avg(af), 0) AS "cost_AF", round_even(round_even(avg(t), 0) / 1000, 0) AS "TC1"
FROM (SELECT station, "Year", simulation, avg(cost_total) AS t, avg(cost_acre) AS ca,
             avg(cost_af) AS af FROM met GROUP BY ALL)
GROUP BY station, simulation""",

    "met_year_counts": _with(MET) + """
SELECT station, simulation, count(DISTINCT "Year") AS met_years FROM met GROUP BY ALL""",

    "crop_mix_shares": _with(SHIP, CROPPED, SEASON, SITES, BRIDGE, CROP_ACRES) + """
SELECT station, group1, round(acres, 6) AS "Acres",
       round(sum(acres) OVER (PARTITION BY station), 6) AS "Total_ac",
       round_even(acres / sum(acres) OVER (PARTITION BY station) * 100, 1) AS "Percentage",
       round(acres / 1000, 6) AS group_thousand_ac
FROM crop_acres""",

    "crop_mix_wide": _with(SHIP, CROPPED, SEASON, SITES, BRIDGE, CROP_ACRES) + f"""
SELECT station, {_WIDE} FROM crop_acres GROUP BY station""",

    "median_by_group": _with(FLAG_IMPACT) + """
SELECT crop, simulation, round(median(money_loss / acres), 6) AS "Cost_acre",
       round(median(saved_pct), 6) AS "Per_irrig_saved",
       round(median(reduction), 6) AS "Per_yield_reduction",
       round(median(mm), 6) AS streamflow_aug_mm
FROM impact WHERE reduction BETWEEN 0 AND 40 GROUP BY ALL""",

    "box_summary": _with(_box("lineitem", "l_returnflag, l_linestatus", "l_extendedprice", "4")),

    "impact_boxes": f"""SELECT crop, simulation, lower, middle, upper, round(ymin, 6) AS ymin,
       round(ymax, 6) AS ymax, n, outliers FROM (
{_with(FLAG_IMPACT, "rows_ AS (SELECT crop, simulation, reduction FROM impact WHERE reduction BETWEEN 0 AND 40)",
       _box("rows_", "crop, simulation", "reduction", "6"))})""",

    "cost_per_acre_boxes": f"""SELECT crop, lower, middle, upper, round(ymin, 6) AS ymin,
       round(ymax, 6) AS ymax, n, outliers FROM (
{_with(FLAG_IMPACT, "rows_ AS (SELECT crop, c FROM (SELECT crop, money_loss / acres AS c FROM impact) WHERE c <= 1000 AND c BETWEEN 0 AND 1000)",
       _box("rows_", "crop", "c", "6"))})""",

    "percent_summary": _with(RUNS) + f"""
SELECT station, "Year", simulation, round(med, 8) AS "Percen_med",
       round(mn, 8) AS "Percen_mn", lo AS "Percen_min", hi AS "Percen_max",
       {_bin('mn', fv.OPEN_PERCENT_BINS, False)} AS "Percent_mn_1",
       {_bin('med', fv.OPEN_PERCENT_BINS, False)} AS "Percent_md_1",
       {_bin('lo', fv.OPEN_PERCENT_BINS, False)} AS "Percent_min_1",
       {_bin('hi', fv.CLOSED_PERCENT_BINS, True)} AS "Percent_max_1"
FROM (SELECT station, "Year", simulation, median(pct) AS med, avg(pct) AS mn,
             min(pct) AS lo, max(pct) AS hi FROM runs GROUP BY ALL)""",

    "percent_bins": _with(RUNS) + f"""
SELECT {_bin('p', fv.CLOSED_PERCENT_BINS, True)} AS closed_bin,
       {_bin('p', fv.OPEN_PERCENT_BINS, False)} AS open_bin, count(*) AS n
FROM (SELECT pct AS p FROM runs) GROUP BY ALL""",

    "years_need_matrix": _with(YEARS) + f"""
SELECT station, {_MATRIX}
FROM (SELECT station, simulation,
             round_even(count(DISTINCT "Year") * 100.0::DOUBLE / max(years), 1) AS pct
      FROM v JOIN spans USING (station) WHERE can50 = 'YES' GROUP BY ALL)
GROUP BY station""",

    "years_needing": _with(YEARS) + """
SELECT station, simulation, count(DISTINCT "Year") AS "Req_years",
       CAST(max(years) AS BIGINT) AS "Analyzed_yrs",
       round_even(count(DISTINCT "Year") * 100.0::DOUBLE / max(years), 1) AS "Percentage"
FROM v JOIN spans USING (station) WHERE need GROUP BY ALL""",

    "placeholder_union": _with(WIN, SHIP) + """
SELECT simulation, l_returnflag, sum(l_quantity) AS qty
FROM ship JOIN win ON "DOY" BETWEEN start_date AND stop_date GROUP BY ALL
UNION ALL SELECT 'Scenario02', r_name, NULL FROM region""",

    "union_distinct": _with(SHIP) + """
SELECT "Year", l_returnflag, count(*) AS sites FROM (
  SELECT site, "Year", l_returnflag FROM ship
  UNION SELECT s_suppkey, 1998, 'N' FROM supplier) GROUP BY ALL""",

    "water_right_merge": """
WITH dated AS (
  SELECT o_custkey, CASE
    WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '3%'
      THEN strftime(o_orderdate, '%Y-%m-%d')
    WHEN o_orderpriority LIKE '2%'
      THEN month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate) END AS d
  FROM orders),
a AS (SELECT o_custkey AS c1, CAST(CAST(split_part(d, '-', 2) AS INTEGER) AS VARCHAR) || '/'
             || CAST(CAST(split_part(d, '-', 3) AS INTEGER) AS VARCHAR) || '/'
             || split_part(d, '-', 1) AS d1
      FROM dated WHERE d LIKE '%-%'),
b AS (SELECT o_custkey AS c2, d AS d2 FROM dated WHERE d IS NULL OR d NOT LIKE '%-%')
SELECT coalesce(d1, d2) AS "PriorityDate", count(*) AS rights
FROM a FULL JOIN b ON c1 IS NOT DISTINCT FROM c2 AND d1 IS NOT DISTINCT FROM d2
GROUP BY ALL""",

    "site_key_build": """
SELECT s_suppkey, printf('%.5f', s_suppkey / 16.0::DOUBLE) || '_'
         || printf('%.5f', -s_nationkey / 16.0::DOUBLE) AS cell,
       printf('%.5f', s_suppkey / 16.0::DOUBLE) || 'N'
         || printf('%.5f', s_nationkey / 16.0::DOUBLE) || 'W' AS site,
       s_nationkey || '_' || s_suppkey AS site_key,
       replace(s_name, 'Supplier', 'Site') AS renamed
FROM supplier""",

    "station_bridge": """
SELECT DISTINCT n_name AS station, printf('%.5f', s_suppkey / 16.0::DOUBLE) || 'N'
       || printf('%.5f', s_nationkey / 16.0::DOUBLE) || 'W' AS site
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name IN ('ASIA', 'EUROPE', 'AFRICA')""",

    "harvest_timing": _with(WIN, SHIP, CROPPED, DAILY) + """
SELECT simulation, crop, count(*) AS n, sum(irrig1) AS qty, min(harvest_date) AS first_harvest
FROM daily JOIN win ON "DOY" BETWEEN start_date AND stop_date
WHERE harvest_date > start_date + 5 GROUP BY ALL""",

    "read_scenarios": _with(SHIP, CROPPED, SEASON) + """
SELECT simulation, crop, "Year", count(*) AS n, round(sum(irrig), 6) AS irrig,
       round(sum(yield_kgha * 2), 4) AS used_biomass, 273 AS harvest_day
FROM season GROUP BY ALL""",
}


def statements() -> dict[str, str]:
    from . import testfiles_sql  # builds on this module

    return SQL | testfiles_sql.SQL
