"""Daily flow against minimum-flow rules: deficits, runs of days, required pulse.

Group sizes: the keys here are (station, year, window), and rows are one per day,
so a group never holds more than the days of a year.  The windows below can stay
plain windows at any scale, and all of them share one partitioning, hence one
shuffle; :mod:`.long_runs` is for groups without such a bound.  Rows that break the one-row-per-day property fail instead of being dropped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.keys import rule_condition, rule_value
from ..functions.semantics import col, if_else, pair_max, ratio
from ..functions.units import cfs_to_acre_feet


# --- rules ---------------------------------------------------------------------
def unpivot_rules(wide: DataFrame, ids: Sequence[str], *, name: str = "MIFR_SITE_NAME",
                  value: str = "MIFR_rules") -> DataFrame:
    """One row per (ids, rule column); rule columns are all but ``ids``."""
    rules = [c for c in wide.columns if c not in set(ids)]
    text = wide.select(*ids, *[F.col(f"`{c}`").cast("string").alias(c) for c in rules])
    # quoted: a rule site may have dots in its name
    return text.unpivot(list(ids), [F.col(f"`{c}`") for c in rules], name, value)


def parse_rules(rules: DataFrame, *, text: str = "MIFR_rules", condition: str = "Condition"
                ) -> DataFrame:
    """Rule text to a number plus an Open/Closure flag; not a number -> NULL."""
    return rules.withColumns({condition: rule_condition(text), text: rule_value(text)})


def rules_to_days(rules: DataFrame, calendar: DataFrame, on: Sequence[str], *, day: str = "DOY",
                  days: tuple[int, int] = fv.RULE_DAYS) -> DataFrame:
    """Repeat each half-month rule for its days, within the season."""
    return rules.join(calendar.where(F.col(day).between(*days)), list(on))


def threshold_rules(wide_tables: Mapping[str, DataFrame] | Sequence[DataFrame],
                    ids: Sequence[str], calendar: DataFrame, rule_gauges: DataFrame, *,
                    on: Sequence[str] | None = None, name: str = "MIFR_SITE_NAME",
                    gauge_name: str = "MIFR_NAME", value: str = "MIFR_rules",
                    day: str = "DOY") -> DataFrame:
    """Wide rule tables to daily numeric rules tied to gauges."""
    tables = list(wide_tables.values()) if isinstance(wide_tables, Mapping) else wide_tables
    rules = None
    for table in tables:
        long = unpivot_rules(table, ids, name=name, value=value)
        rules = long if rules is None else rules.unionByName(long)
    gauges = rule_gauges.withColumnRenamed(gauge_name, name)
    parsed = parse_rules(rules.join(gauges, name, "left"), text=value)
    shared = on or [c for c in parsed.columns if c in calendar.columns]
    return rules_to_days(parsed, calendar, shared, day=day)


# --- verdicts ------------------------------------------------------------------
def deficit_days(df: DataFrame, *, flow: str = "Discharge_cfs", rule: str = "MIFR_rules",
                 extra: str = "streamflow_aug_cfs",
                 levels: Sequence[float] = fv.RULE_LEVELS) -> DataFrame:
    """Verdicts of each day: need, whether the augmented flow meets the rule.

    Meeting is strict (an augmented flow equal to the rule does not meet it),
    while the percentage counts equality as 100.  A share of the rule can only be
    met where the flow is below that share.
    """
    q, r, a = F.col(flow), F.col(rule), F.col(extra)
    total = a + q
    need = q < r
    out = {
        "Contributing_flow": total,
        "Can_meet_MIFR": if_else(need & (total > r), F.lit("YES"), F.lit("NO")),
        "Aug_Need": if_else(need, F.lit("Yes_Need"), F.lit("Not_Need")),
        "MIFR_Dff": r - q,
        "MIFR_Dff1": if_else(r - q <= 0, F.lit(0.0), r - q),
        "Aug_2_mt_MIFR": if_else(r > q, r - q, F.lit(0.0)),
        "Percentage_aug": if_else(total >= r, F.lit(100.0), ratio(a, r - q) * 100),
    }
    below = need
    for level in levels:
        part = r * level
        below = below & (q < part)
        tag = round(level * 100)
        out[f"MIFR_R_{tag}"] = part
        out[f"Can_meet_MIFR_{tag}"] = if_else(below & (total > part), F.lit("YES"), F.lit("NO"))
    return df.withColumns(out).withColumn(
        "per_aug_not_meet_MIFR",
        if_else(F.col("Can_meet_MIFR") == "NO", F.col("Percentage_aug"), F.lit(0.0)))


# --- runs of days ---------------------------------------------------------------
def keep_groups_with(df: DataFrame, keys: Sequence[str], condition: Column) -> DataFrame:
    """All rows of the groups in which any row satisfies ``condition``."""
    group = Window.partitionBy(*keys)
    return (df.withColumn("_any", F.max(F.coalesce(condition, F.lit(False))).over(group))
            .where("_any").drop("_any"))


def consecutive_runs(df: DataFrame, keys: Sequence[str], day: str, *,
                     where: Column | None = None, unique: bool = False) -> DataFrame:
    """Days that have the day before or after in their group as well.

    ``where`` selects the days that count.  Rows that repeat in all columns count once (set
    ``unique`` where there are none); two different rows for one day of a group fail.
    """
    if where is not None:
        df = df.where(where)
    if not unique:
        df = df.distinct()
    by_day = Window.partitionBy(*keys).orderBy(day)
    d = F.col(day)
    before = d - F.lag(day).over(by_day)
    return (df.withColumns({"_prev": F.when(before == 0, F.raise_error(F.lit(
                                f"two different rows for one {day} of {', '.join(keys)}"))).otherwise(before),
                            "_next": F.lead(day).over(by_day) - d})
            .where((F.col("_prev") == 1) | (F.col("_next") == 1)).drop("_prev", "_next"))


# --- required pulse ---------------------------------------------------------------
def pair_deficits(runs: DataFrame, keys: Sequence[str], day: str, deficit: str) -> DataFrame:
    """Per row: two-day deficit with the day before, the group's smallest, and the
    larger day of the pair on the rows where the smallest occurs."""
    by_day = Window.partitionBy(*keys).orderBy(day)
    group = Window.partitionBy(*keys)
    before = F.lag(deficit).over(by_day)
    step = F.col(day) - F.lag(day).over(by_day)
    return (runs.withColumns({"DOY_diff": step,
                              "_before": before})
            .withColumn("MovingSum_MIFRdef",
                        F.when(F.col("DOY_diff") == 1, F.col(deficit) + F.col("_before")))
            .withColumn("MinMovingSum", F.min("MovingSum_MIFRdef").over(group))
            .withColumn("MaxOfTwo", F.when(F.col("MovingSum_MIFRdef") == F.col("MinMovingSum"),
                                           pair_max(F.col(deficit), F.col("_before"))))
            .drop("_before"))


def required_pulse(runs: DataFrame, keys: Sequence[str], day: str, deficit: str) -> DataFrame:
    """One row per group: the larger day of the pair with the smallest two-day
    deficit; pairs tied on the sum count with the largest of their days."""
    return (pair_deficits(runs, keys, day, deficit)
            .groupBy(*keys).agg(F.max("MaxOfTwo").alias("Req_aug"))
            .withColumns(pulse_volumes()))


def with_required_pulse(runs: DataFrame, keys: Sequence[str], day: str, deficit: str) -> DataFrame:
    """Every run day with its group's required pulse, without a join."""
    pairs = pair_deficits(runs, keys, day, deficit)
    group = Window.partitionBy(*keys)
    return (pairs.withColumn("Req_aug", F.max("MaxOfTwo").over(group))
            .drop("DOY_diff", "MovingSum_MIFRdef", "MinMovingSum", "MaxOfTwo")
            .withColumns(pulse_volumes()))


def pulse_volumes() -> dict[str, Column]:
    volume = cfs_to_acre_feet("Req_aug")
    return {"Req_aug_Acft": volume, "Fiftyp_aug": volume * 0.5}


def augmentation_ratio(runs: DataFrame, keys: Sequence[str], day: str, deficit: str,
                       extra: str) -> DataFrame:
    """Available over needed on the day that sets the requirement, capped at 1.

    The denominator is that day's own deficit; the requirement is kept beside it
    as ``MaxOfTwo``, with both volumes in acre-feet.
    """
    group = Window.partitionBy(*keys)
    pairs = pair_deficits(runs, keys, day, deficit).where(F.col("MaxOfTwo").isNotNull())
    return (pairs.withColumn("_most", F.max("MaxOfTwo").over(group))
            .where(F.col("MaxOfTwo") == F.col("_most")).drop("_most")
            .withColumn("RelativeRatioOfAug", ratio(extra, deficit))
            .withColumns({
                "RelativeRatioOfAug_adj": if_else(F.col("RelativeRatioOfAug") > 1, F.lit(1.0),
                                                  F.col("RelativeRatioOfAug")),
                "Req_aug_acft": cfs_to_acre_feet("MaxOfTwo"),
                "Aug_avail_acft": cfs_to_acre_feet(col(extra)),
            }))
