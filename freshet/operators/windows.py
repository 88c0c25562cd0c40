"""Calendar windows: tagging daily rows and summing demand inside a window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import fixed_values as fv
from ..functions.semantics import col, if_else
from .intervals import tag_intervals


def tag_windows(df: DataFrame, day: str, windows: DataFrame | None = None, *,
                name: str = "simulation", start: str = "start_date",
                stop: str = "stop_date") -> DataFrame:
    """Give every row the windows that contain its day (inclusive bounds).

    Rows in no window drop out; rows in several windows repeat.  The fixed windows are used
    by default: spread over their days and broadcast, they meet the rows in an equi hash
    join.  A caller's windows may be long, fractional and many: they meet the
    rows in blocks (:func:`.intervals.tag_intervals`).
    """
    if windows is None:
        days = dims.scenario_days(df.sparkSession, "_day").select(
            "_day", F.col("simulation").alias(name), F.col("start_date").alias(start),
            F.col("stop_date").alias(stop))
        first, last = fv.SCENARIO_WINDOWS[0][1], fv.SCENARIO_WINDOWS[-1][2]
        df = df.where(F.col(day).between(first, last))
        return df.join(F.broadcast(days), F.col(day) == F.col("_day")).drop("_day")
    return tag_intervals(df, windows.select(name, start, stop), point=day, start=start, stop=stop)


def window_demand(daily: DataFrame, keys: Sequence[str], *, day: str, measure: Column | str,
                  harvest: str, windows: DataFrame | None = None, name: str = "simulation",
                  grace: int = fv.HARVEST_GRACE_DAYS, out: str = "irrigation_demand_mm",
                  target: str = "target_harvest_date") -> DataFrame:
    """Demand per window; none where the harvest falls in its first days.

    A harvest on the start day up to ``grace`` days later (both ends included)
    sets the demand to zero.  An unknown harvest or measure on any day makes the
    demand of that window unknown (NULL) rather than silently smaller.
    """
    tagged = tag_windows(daily, day, windows, name=name)
    tagged = tagged.withColumn(target, F.col("start_date") + grace)
    taken = if_else(F.col(harvest).between(F.col("start_date"), F.col(target)),
                    F.lit(0.0), col(measure))
    tagged = tagged.withColumn("_taken", taken)
    missing = F.max(F.col("_taken").isNull())
    return (tagged.groupBy(*keys, name, target)
            .agg(F.sum("_taken").alias(out), missing.alias("_missing"))
            .withColumn(out, F.when(~F.col("_missing"), F.col(out))).drop("_missing"))
