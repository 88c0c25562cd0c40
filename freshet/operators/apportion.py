"""Whole-to-part apportioning and roll-ups.

The exact forms count measures and sizes in whole units of their last digit.  The parts of a whole stand in a
fixed order; what goes to the first of them up to a part is the rounded product of the measure and their
size, and a part's share is what is added there.  So shares lie within one unit of the true ones, and those of
all parts add up to the measure, whatever the order of rows.  Where only sums over leading
parts are wanted, the shares between fall out, and no row is multiplied by its parts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import col, exact_sum, from_units, ratio, sum_or_zero, to_units, units_up_to
from .running import running_totals


def apportion_to_parts(whole: DataFrame, parts: DataFrame, keys: Sequence[str], *,
                       part_size: str, whole_size: str, measures: Mapping[str, Column | str],
                       fraction: str = "fraction_acres") -> DataFrame:
    """Share the measures of each whole among its parts by size (inner join).

    ``parts`` carries ``part_size`` and ``whole_size``.  The size is never a join
    key: equality of computed doubles is not something to rely on.
    """
    shares = parts.withColumn(fraction, ratio(part_size, whole_size))
    joined = whole.join(shares, list(keys))
    return joined.withColumns({
        out: (F.col(m) if isinstance(m, str) else m) * F.col(fraction)
        for out, m in measures.items()})


def apportion_exactly(whole: DataFrame, parts: DataFrame, keys: Sequence[str], *, part: Sequence[str],
                      part_size: str, whole_size: str, measures: Mapping[str, tuple[Column | str, int]],
                      size_digits: int = 0, fraction: str = "fraction_acres") -> DataFrame:
    """:func:`apportion_to_parts` with shares that add up.

    part       identifies a part within its whole, and orders the parts
    measures   output column -> (measure, digits)

    Parts of a key with another ``whole_size`` belong to another whole.  The running sizes are those of the
    parts alone; a key may have any number of them.
    """
    sized = parts.withColumns({"_size": to_units(part_size, size_digits), "_whole": to_units(whole_size, size_digits)})
    sized = running_totals(sized, [*keys, "_whole"], list(part), {"_upto": "_size"})
    joined = whole.join(sized, list(keys))
    before = F.col("_upto") - F.col("_size")
    out = joined.withColumns({f"_units_{o}": to_units(m, d) for o, (m, d) in measures.items()})
    return out.withColumns({
        o: from_units(units_up_to(f"_units_{o}", "_upto", "_whole") - units_up_to(f"_units_{o}", before, "_whole"), d)
        for o, (_, d) in measures.items()} | {fraction: ratio(part_size, whole_size)}
    ).drop("_upto", "_size", "_whole", *[f"_units_{o}" for o in measures])


def rollup_exactly(whole: DataFrame, parts: DataFrame, keys: Sequence[str], *, part_size: str, whole_size: str,
                   measures: Mapping[str, tuple[Column | str, int]], size_out: str, size_digits: int = 0,
                   apart: Sequence[str] = ()) -> DataFrame:
    """:func:`rollup_parts` in whole units: what the given parts of each row get, together.

    It is the sum of the shares :func:`apportion_exactly` gives them.  ``apart`` names columns of ``parts`` that
    tell several wholes of a key apart; rows of ``whole`` then meet each of these, and equal rows
    become one.  Without them two wholes of a key fail.
    """
    sized = parts.select(*keys, *apart, to_units(part_size, size_digits).alias("_size"),
                         to_units(whole_size, size_digits).alias("_whole"))
    sizes = sized.groupBy(*keys, *apart).agg(
        F.sum("_size").alias("_size"),
        F.when(F.min("_whole") == F.max("_whole"), F.max("_whole")).otherwise(
            F.when(F.count("_whole") > 0, F.raise_error(F.lit(f"parts of one whole differ in {whole_size}")).cast("long"))
        ).alias("_whole"))
    joined = whole.join(sizes, list(keys))
    shares = {f"_share_{o}": F.coalesce(units_up_to(to_units(m, d), "_size", "_whole"), F.lit(0).cast("long"))
              for o, (m, d) in measures.items()}
    out = joined.withColumns(shares)
    if apart:
        out = out.groupBy(*whole.columns).agg(*[F.sum(c).alias(c) for c in shares], F.sum("_size").alias("_size"))
    else:
        out = out.drop("_whole")
    return out.withColumns({o: from_units(f"_share_{o}", d) for o, (_, d) in measures.items()}
                           | {size_out: from_units("_size", size_digits)}).drop("_size", *shares)


def rollup_parts(whole: DataFrame, parts: DataFrame, keys: Sequence[str], *,
                 part_size: str, whole_size: str, measures: Mapping[str, str],
                 size_out: str, count_out: str | None = None) -> DataFrame:
    """Apportion and sum back to the whole's rows in one step.

    Summing ``m * f`` over the parts of a row is ``m`` times the sum of ``f``, so
    the parts' fractions are summed to one row per key first: no row is multiplied by its
    parts, and a key with very many parts is combined before the shuffle.
    Each part counts by its own whole, which may differ within a key.  Missing measures
    count as 0, as in a sum that skips them.
    """
    shares = parts.groupBy(*keys).agg(
        sum_or_zero(part_size).alias("_size"), F.sum(ratio(part_size, whole_size)).alias("_fraction"),
        F.count(F.lit(1)).alias("_parts"))
    joined = whole.join(shares, list(keys))
    zero = F.lit(0.0)
    out = joined.withColumns({
        o: F.coalesce(F.col(m) * F.col("_fraction"), zero) for o, m in measures.items()
    }).withColumn(size_out, F.col("_size"))
    if count_out:
        out = out.withColumn(count_out, F.col("_parts"))
    return out.drop("_fraction", "_size", "_parts")


def _sum(c: Column | str, digits: int | None) -> Column:
    return sum_or_zero(c) if digits is None else F.coalesce(exact_sum(col(c), digits), F.lit(0.0))


def rollup_grid(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column | str],
                ratios: Mapping[str, tuple[str, str]] | None = None,
                means: Mapping[str, Column | str] | None = None,
                digits: Mapping[str, int] | None = None) -> DataFrame:
    """Sums (0 for nothing), means, then ratios of the summed columns.

    ``digits`` names the sums that are exact, and their digits.
    """
    aggs = [_sum(c, (digits or {}).get(out)).alias(out) for out, c in sums.items()]
    aggs += [F.avg(c).alias(out) for out, c in (means or {}).items()]
    out = df.groupBy(*keys).agg(*aggs)
    return out.withColumns({o: ratio(n, d) for o, (n, d) in ratios.items()}) if ratios else out


def rollup_stations(grid: DataFrame, bridge: DataFrame, keys: Sequence[str],
                    sums: Mapping[str, Column | str], *, site: str = "site",
                    station: str = "station", digits: Mapping[str, int] | None = None) -> DataFrame:
    """Sum grid rows up to every station they contribute to, in one pass.

    A grid site may feed several nested stations, so the join fans out by the
    stations per site.  Rows are first summed per site, which keeps the fan-out
    off the raw rows.
    """
    per_site = rollup_grid(grid, [site, *keys], sums, digits=digits)
    links = bridge.select(station, site).distinct()
    return (per_site.join(links, site)
            .groupBy(station, *keys).agg(*[_sum(o, (digits or {}).get(o)).alias(o) for o in sums]))


def two_level_mean_sum(df: DataFrame, inner: Sequence[str], outer: Sequence[str], measure: str,
                       out: str) -> DataFrame:
    """Mean per inner group, summed per outer group."""
    return (df.groupBy(*inner).agg(F.avg(measure).alias("_mean"))
            .groupBy(*outer).agg(sum_or_zero("_mean").alias(out)))
