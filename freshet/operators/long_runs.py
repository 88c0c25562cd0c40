"""Runs of days and their pulse in groups of any size.

The operators of :mod:`.flow` use plain windows, right where a group holds the days of one year.  These give
the same results where one station, or one missing key, holds a third of all rows: the days are cut
into range slices, each row meets its neighbours across the cuts, and totals of a group are put together
from its pieces.  All of them work on rows that :func:`cut_days` has cut once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import pair_max
from . import slices
from .flow import pulse_volumes


def cut_days(df: DataFrame, keys: Sequence[str], day: str, *, n: int | None = None) -> DataFrame:
    """The rows by group and day, in slices; rows that repeat in all columns count once."""
    return slices.cut(df.distinct(), keys, [day], "days", n)


def keep_groups_with(cut: DataFrame, keys: Sequence[str], condition: Column) -> DataFrame:
    """All rows of the groups in which any row satisfies ``condition``."""
    any_row = {"_any": (F.max, F.coalesce(condition, F.lit(False)))}
    return slices.group_totals(cut, keys, any_row).where("_any").drop("_any")


def consecutive_runs(cut: DataFrame, keys: Sequence[str], day: str, *, where: Column | None = None,
                     deficit: str | None = None) -> DataFrame:
    """Days that have the day before or after in their group as well.

    Two different rows for one day of a group fail.  With ``deficit`` every row also has its sum with the day before,
    ``MovingSum``, and the larger of the two, ``Larger``; both are NULL where that day is not in the group.
    """
    rows = cut if where is None else cut.where(where)
    rows = slices.neighbours(rows, keys, [day], [day, *([deficit] if deficit else [])])
    d = F.col(day)
    back, ahead = d - F.col(f"before.{day}"), F.col(f"after.{day}") - d
    back = F.when(back == 0, F.raise_error(F.lit(f"two different rows for one {day} of {', '.join(keys)}")).cast("long")
                  ).otherwise(back.cast("long"))
    rows = rows.withColumn("_back", back).where((F.col("_back") == 1) | (ahead == 1))
    if deficit:
        had = F.when(F.col("_back") == 1, F.col(f"before.{deficit}"))
        rows = rows.withColumns({"MovingSum": F.col(deficit) + had, "Larger": pair_max(F.col(deficit), had)})
    return rows.drop("before", "after", "_back")


def _least_pair() -> Column:
    """Orders pairs of days by their sum, the least last, then by the larger of the two."""
    return F.when(F.col("MovingSum").isNotNull(), F.struct((-F.col("MovingSum")).alias("sum"), F.col("Larger").alias("larger")))


def required_pulse(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per group: the larger day of the pair with the smallest sum, from runs with a deficit."""
    pairs = runs.groupBy(*keys).agg(F.max(_least_pair()).alias("_pair"))
    return pairs.withColumn("Req_aug", F.col("_pair.larger")).drop("_pair").withColumns(pulse_volumes())


def with_required_pulse(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every run day with its group's required pulse, without a join of days."""
    rows = slices.group_totals(runs, keys, {"_pair": (F.max, _least_pair())})
    return (rows.withColumn("Req_aug", F.col("_pair.larger")).drop("_pair", "MovingSum", "Larger")
            .withColumns(pulse_volumes()))
