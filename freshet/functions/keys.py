"""Key building and text repair: grid ids, dates, rule text, station numbers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed_values as fv
from .semantics import col, number


def five_decimals(c: Column | str) -> Column:
    """Coordinate as text with exactly five decimals; NULL stays NULL."""
    c = col(c)
    return F.when(c.isNotNull(), F.format_string("%.5f", c.cast("double")))


def grid_site(lat: Column | str, long: Column | str) -> Column:
    """``<lat>N<long>W`` with the minus signs of the longitude removed."""
    return F.concat(col(lat).cast("string"), F.lit("N"),
                    F.regexp_replace(col(long).cast("string"), "-", ""), F.lit("W"))


def grid_site_from_cell(cell: Column | str, separator: str = "_") -> Column:
    """Grid id from a ``lat_long`` cell name."""
    parts = F.split(col(cell), separator)
    return grid_site(parts.getItem(0), parts.getItem(1))


def composite_key(*columns: Column | str) -> Column:
    """Join key text ``a_b_c``; NULL parts are spelled ``NA``, never skipped."""
    return F.concat_ws("_", *[F.coalesce(col(c).cast("string"), F.lit("NA")) for c in columns])


def day_of_season(code: Column | str) -> Column:
    """Day of year from a ``YYYYDDD`` code."""
    return F.substring(col(code), 5, 3).try_cast("int")


def year_of_dated_label(label: Column | str) -> Column:
    """Year from ``YYYY-MM-DD(DOY)``."""
    return F.split(col(label), "-").getItem(0).try_cast("int")


def slashed_date(text: Column | str) -> Column:
    """``Y-M-D`` rewritten as ``M/D/Y`` without leading zeros; other text as is."""
    text = col(text)
    parts = F.split(text, "-")
    rewritten = F.concat_ws("/", parts.getItem(1).try_cast("int").cast("string"),
                            parts.getItem(2).try_cast("int").cast("string"), parts.getItem(0))
    return F.when(text.contains("-"), rewritten).otherwise(text)


def repaired_station_id(c: Column | str) -> Column:
    """Station numbers stay text; undo the one a spreadsheet turned into a float."""
    spoiled, right = fv.SPOILED_STATION_ID
    c = F.trim(col(c).cast("string"))
    return F.when(c == spoiled, F.lit(right)).otherwise(c)


def rule_condition(text: Column | str) -> Column:
    text = col(text)
    return F.when(F.coalesce(text.contains(fv.CLOSURE_WORD), F.lit(False)), F.lit("Closure")
                  ).otherwise(F.lit("Open"))


def rule_value(text: Column | str) -> Column:
    """Number in ``1,200 (remark)``: drop the first remark and the commas."""
    plain = F.regexp_replace(col(text), "^(.*?)" + fv.REMARK_PATTERN, "$1")
    return number(F.regexp_replace(plain, ",", ""))


def merge_regions(c: Column | str, merged: Mapping[str, str] = fv.MERGED_REGIONS) -> Column:
    c = col(c)
    for old, new in merged.items():
        c = F.regexp_replace(c, old, new)
    return c


def calendar_columns(df: DataFrame, date: str) -> DataFrame:
    """Add Year, Month, Day and DOY as integers."""
    return df.withColumns({
        "Year": F.year(date), "Month": F.month(date),
        "Day": F.dayofmonth(date), "DOY": F.dayofyear(date),
    })
