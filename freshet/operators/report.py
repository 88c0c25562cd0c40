"""Report tables: shares, percent bins, medians, box summaries, matrices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.semantics import col, first_match, half_even, null_safe_join, ratio
from . import slices
from .running import exact_quantiles, quantiles_of_slices, value_counts


def share_of_total(df: DataFrame, keys: Sequence[str], measure: str, *, total: str = "Total_ac",
                   share: str = "Percentage", digits: int = 1) -> DataFrame:
    """Share of each row in its group's total, in percent.

    For summed rows, one per category: a group is as large as the categories are
    many.
    """
    df = df.withColumn(total, F.sum(measure).over(Window.partitionBy(*keys)))
    return df.withColumn(share, half_even(ratio(measure, total) * 100, digits))


def bin_percent(value: Column | str, *, closed: bool = True) -> Column:
    """Label of the percent bin; exactly 100 is a bin of its own.

    ``closed`` puts 0 into the first bin; otherwise 0 gets the label of values
    outside every bin.  NULL stays NULL.
    """
    v = col(value)
    arms = []
    for i, (low, high, text) in enumerate(fv.CLOSED_PERCENT_BINS if closed
                                          else fv.OPEN_PERCENT_BINS):
        above = v >= low if closed and i == 0 else v > low
        below = v < high if high == 100 else v <= high
        arms.append((above & below, F.lit(text)))
    arms.append((v == 100, F.lit(fv.FULL_PERCENT_LABEL)))
    arms.append((v.isNotNull(), F.lit(fv.NO_PERCENT_LABEL)))
    return first_match(arms)


def percent_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median, mean, minimum and maximum per group with their bins.

    Groups are (station, year, window) days, a bounded handful, so the built-in
    exact median is safe.
    """
    out = df.groupBy(*keys).agg(
        F.median(value).alias("Percen_med"), F.avg(value).alias("Percen_mn"),
        F.min(value).alias("Percen_min"), F.max(value).alias("Percen_max"))
    return out.withColumns({
        "Percent_mn_1": bin_percent("Percen_mn", closed=False),
        "Percent_md_1": bin_percent("Percen_med", closed=False),
        "Percent_min_1": bin_percent("Percen_min", closed=False),
        "Percent_max_1": bin_percent("Percen_max"),
    })


def medians(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Exact median of several measures per group, in one pass over the rows.

    The measures are stacked so that all of them are ranked together.  A group
    has a row if any measure has a value there.
    """
    stacked = (df.select(*keys, *[F.col(m).cast("double").alias(m) for m in measures])
               .unpivot(list(keys), list(measures), "_measure", "_value"))
    found = exact_quantiles(stacked, [*keys, "_measure"], "_value", {"_median": 0.5})
    return found.groupBy(*keys).pivot("_measure", list(measures)).agg(F.first("_median"))


def box_summary(df: DataFrame, keys: Sequence[str], value: str, *,
                limits: tuple[float, float] | None = None, reach: float = 1.5) -> DataFrame:
    """Box-plot numbers per group: quartiles, whisker ends, counts.

    Axis ``limits`` drop values outside them before anything is computed, as a
    plot with those limits would.  Whiskers end at the outermost values within
    ``reach`` inter-quartile ranges of the box.
    """
    if limits is not None:
        df = df.where(F.col(value).between(*limits))
    counts = slices.cut(value_counts(df, keys, value), keys, [value], "counts")
    boxes = quantiles_of_slices(counts, keys, value, {"lower": 0.25, "middle": 0.5, "upper": 0.75})
    v, n = F.col(value), F.col("_n")
    span = (F.col("upper") - F.col("lower")) * reach
    inside = v.between(F.col("lower") - span, F.col("upper") + span)
    return (null_safe_join(counts, boxes, keys)
            .groupBy(*keys, "lower", "middle", "upper").agg(
                F.min(F.when(inside, v)).alias("ymin"), F.max(F.when(inside, v)).alias("ymax"),
                F.sum(n).alias("n"),
                F.coalesce(F.sum(F.when(~inside, n)), F.lit(0)).alias("outliers")))


def to_matrix(df: DataFrame, rows: Sequence[str], column: str, value: str,
              labels: Sequence[str], *, rest: str | None = None) -> DataFrame:
    """Long to wide with a fixed label list, so no extra pass finds the labels.

    Nothing is lost without a word: the same pass sees what lies outside the list.  ``rest`` names a column
    for the sum of it (NULL where there is none); without ``rest`` a label outside the list fails, while
    rows without a label have no column to go to and are left out.
    """
    labels = list(labels)
    label = F.col(column)
    outside = label.isNotNull() & ~label.isin(labels)
    if rest is not None:
        outside = F.coalesce(outside, F.lit(True)) | label.isNull()
    marked = df.withColumn("_label", F.when(outside, F.lit("_rest")).otherwise(label.cast("string")))
    taken = F.when(F.first("_label") == "_rest", F.sum(value)).otherwise(F.first(value, ignorenulls=True)) if rest else (
        F.first(value, ignorenulls=True))
    wide = marked.groupBy(*rows).pivot("_label", [*map(str, labels), "_rest"]).agg(
        taken.alias("v"), F.count(F.lit(1)).alias("n"), F.max(F.when(outside, label)).alias("x"))
    found = {x: F.col(f"`{x}_v`") for x in map(str, labels)}
    if rest is not None:
        found[rest] = F.col("_rest_v")
    elif labels:
        head = str(labels[0])
        said = F.concat(F.lit(f"a {column} outside the list: "), F.col("_rest_x"))
        found[head] = F.when(F.col("_rest_n") > 0, F.raise_error(said).cast(dict(df.dtypes)[value])).otherwise(found[head])
    return wide.select(*rows, *[c.alias(x) for x, c in found.items()])


def years_needing(df: DataFrame, site: str, scenario: str, year: str, need: Column, *,
                  digits: int = 1) -> DataFrame:
    """Percent of a site's years in which a scenario window had a need.

    The span of years counts all of a site's rows, with or without need.  Days
    are reduced to one row per (site, scenario, year) first.
    """
    yearly = df.groupBy(site, scenario, year).agg(
        F.max(F.coalesce(need, F.lit(False))).alias("_need"))
    per_scenario = yearly.groupBy(site, scenario).agg(
        F.sum(F.col("_need").cast("long")).alias("Req_years"),
        F.min(year).alias("_first"), F.max(year).alias("_last"))
    group = Window.partitionBy(site)
    span = (F.max("_last").over(group) - F.min("_first").over(group) + 1).cast("long")
    return (per_scenario.withColumn("Analyzed_yrs", span).drop("_first", "_last")
            .where(F.col("Req_years") > 0)
            .withColumn("Percentage", half_even(
                ratio(F.col("Req_years") * 100.0, "Analyzed_yrs"), digits)))


def years_matrix(df: DataFrame, site: str, scenario: str, year: str, need: Column, *,
                 labels: Mapping[str, str], digits: int = 1) -> DataFrame:
    """:func:`years_needing` with one column per scenario label."""
    long = years_needing(df, site, scenario, year, need, digits=digits)
    return to_matrix(long, [site], scenario, "Percentage", list(labels)).select(
        site, *[F.col(f"`{k}`").alias(v) for k, v in labels.items()])


def mean_cost_matrix(df: DataFrame, yearly: Sequence[str], final: Sequence[str]) -> DataFrame:
    """Mean cost per year, then across years, rounded half to even.

    The thousands come from the already rounded total.
    """
    per_year = df.groupBy(*yearly).agg(
        F.avg("Total_Cost").alias("Total_Cost"), F.avg("Cost_acre").alias("Cost_acre"),
        F.avg("cost_AF").alias("cost_AF"))
    out = per_year.groupBy(*final).agg(
        half_even(F.avg("Total_Cost")).alias("Total_Cost"),
        half_even(F.avg("Cost_acre")).alias("Cost_acre"),
        half_even(F.avg("cost_AF")).alias("cost_AF"))
    return out.withColumn("TC1", half_even(F.col("Total_Cost") / 1000))


def met_year_counts(df: DataFrame, keys: Sequence[str], year: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.countDistinct(year).alias("met_years"))


def with_placeholders(df: DataFrame, placeholders: DataFrame) -> DataFrame:
    """Append rows that only carry their axis labels."""
    return df.unionByName(placeholders, allowMissingColumns=True)
