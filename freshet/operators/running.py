"""Running totals and exact order statistics that survive a hot group.

Both work on range slices (:mod:`.slices`): there is one algorithm for every size, and its result
does not depend on the number of slices.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.semantics import col
from ..session import shared_dir
from . import slices


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so the work above runs once however often the result is
    used, and a lost executor costs a re-read rather than a re-computation that
    might order its rows differently.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   values: Mapping[str, Column | str], *, totals: Mapping[str, str] | None = None) -> DataFrame:
    """Add running sums within ``keys`` in the order of ``order``.

    values   output column -> summed expression (first row up to this row)
    totals   output column -> name in ``values`` whose group total to add
    order    must identify a row within its group, or tied rows share no fixed
             order; NULLs come first
    """
    return totals_of_slices(slices.cut(df, keys, order), keys, order, values, totals=totals).drop(slices.SLICE)


def totals_of_slices(cut: DataFrame, keys: Sequence[str], order: Sequence[str],
                     values: Mapping[str, Column | str], *, totals: Mapping[str, str] | None = None) -> DataFrame:
    """:func:`running_totals` of rows that are cut already.

    Each slice is summed by itself, and what earlier slices hold of its first group is added.
    """
    totals = dict(totals or {})
    inputs = {out: f"_in_{i}" for i, out in enumerate(values)}
    rows = cut.withColumns({inputs[o]: col(v) for o, v in values.items()})
    here = slices.within(keys)
    upto = here.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumns({o: F.sum(c).over(upto) for o, c in inputs.items()}
                              | {t: F.sum(inputs[o]).over(here) for t, o in totals.items()})
    pieces = slices.ends(rows, keys, {c: F.sum(c) for c in inputs.values()}, cut)
    carried = pieces.select(
        slices.SLICE, *keys,
        *[F.sum(c).over(slices.earlier(keys)).alias(f"_before{c}") for c in inputs.values()],
        *[F.sum(inputs[o]).over(Window.partitionBy(*keys)).alias(f"_all_{t}") for t, o in totals.items()])
    types = dict(summed.dtypes)
    # a sum of nothing stays NULL, as in a plain window
    full = {o: F.coalesce(F.col(o) + F.col(f"_before{c}"), o, f"_before{c}").cast(types[o]) for o, c in inputs.items()}
    full |= {t: F.coalesce(f"_all_{t}", t) for t in totals}
    out = slices.attach(summed, carried, keys).withColumns(full)
    return out.drop(*inputs.values(), *[f"_before{c}" for c in inputs.values()], *[f"_all_{t}" for t in totals])


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probabilities: Mapping[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group: output column -> probability.

    Equal values are counted before anything is shuffled by group, then the
    ranks are found with :func:`running_totals`; no task holds a whole group's
    values.  NULL and NaN values are ignored; a group with no value gets no row.
    """
    return quantiles_of_slices(slices.cut(value_counts(df, keys, value), keys, [value]), keys, value, probabilities)


def quantiles_of_slices(counts: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float], *,
                        weight: str = "_n") -> DataFrame:
    """:func:`exact_quantiles` of counted values (see :func:`value_counts`) that are cut by value already."""
    ranked = totals_of_slices(counts, keys, [value], {"_upto": weight}, totals={"_total": "_upto"})
    picks = []
    for i, p in enumerate(probabilities.values()):
        at = (F.col("_total") - 1) * F.lit(float(p))
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("_upto") - F.col(weight) <= pos) & (pos < F.col("_upto"))
            picks.append(F.max(F.when(here, F.col(value).cast("double"))).alias(f"_{side}{i}"))
        picks.append(F.max(at - F.floor(at)).alias(f"_w{i}"))
    found = ranked.groupBy(*keys).agg(*picks)
    return found.select(*keys, *[
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")).alias(out)
        for i, out in enumerate(probabilities)])


def value_counts(df: DataFrame, keys: Sequence[str], value: str, n: str = "_n") -> DataFrame:
    """Distinct values per group with their counts; NULL and NaN are left out."""
    kept = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return kept.groupBy(*keys, value).agg(F.count(F.lit(1)).alias(n))
