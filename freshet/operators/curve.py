"""Cost-ordered supply curves and look-ups into them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import complete_cases, finite, null_safe_join, ratio
from . import slices
from .running import running_totals, stage


def supply_curve(points: DataFrame, keys: Sequence[str], *, cost: str, volume: str,
                 tie: Sequence[str], size: str | None = None, out: str = "cum_streamflow",
                 size_out: str = "cum_size") -> DataFrame:
    """Cumulate ``volume`` in the order of ``cost`` within ``keys``.

    Rows with any missing value or an infinite cost are left out.  ``tie`` must
    make a row unique within its group; it fixes the order among equal costs.
    With ``size`` the running size is added as well.
    """
    points = complete_cases(points).where(finite(cost))
    values = {out: volume}
    if size:
        values[size_out] = size
    return running_totals(points, keys, [cost, *tie], values)


def curve_lookup(need: DataFrame, curve: DataFrame, keys: Sequence[str], *, amount: str,
                 cost: str, cum: str = "cum_streamflow", size: str = "Acres",
                 order: Sequence[str] | None = None, half: float = 0.5, largest: bool = True) -> DataFrame:
    """Price required amounts on the curve; one row per key of ``need``.

    The largest requirement of a key counts, or, unless ``largest``, every different one has a row.
    It is priced by one step of the curve: the first, in
    ``order``, whose cumulative volume reaches it (met), else the last one (not
    met, and the volume priced is the requirement itself).  A key without a curve
    costs 0.  The ``half`` requirement is looked up in the same way; where no
    step reaches it, the *first* step is used.  The total is the marginal cost at
    the requirement times the whole requirement, not the area under the curve.
    The size is that of all steps that neither cost more nor lie beyond the volume priced.

    ``order`` (default: cost, cumulative volume) must order the steps of a key up to steps alike in
    cost and volume.  Where a key has several curves, as a station with
    cells in two regions, it begins with what tells the curves apart.  Along one curve neither
    cost nor cumulative volume falls.
    """
    keys = list(keys)
    tells = [c for c in order or () if c not in (cost, cum)]
    curve = curve.select(*keys, *tells, F.col(cost).alias("_cost"), F.col(cum).alias("_cum"), F.col(size).alias("_size"))
    need = need.groupBy(*keys).agg(F.max(amount).alias("need")) if largest else (
        need.select(*keys, F.col(amount).alias("need")).distinct())
    if tells:
        # read for the curves there are, for the steps and for the sizes
        curve, need = stage(curve, "curves"), stage(need, "needs")
    found = _steps_reaching(need, curve, keys, tells, half)
    met = F.col("_hit").isNotNull()
    priced = found.withColumns({
        "meets_need": F.when(met, "YES").when(F.col("_last").isNotNull(), "NO"),
        "MC_Cost": F.coalesce("_hit.cost", "_last.cost", F.lit(0.0)),
        "nearest_cum_stream": F.when(met, F.col("_hit.cum")).when(F.col("_last").isNotNull(), F.col("need")).otherwise(0.0),
        "MC_Cost_50": F.coalesce("_half.cost", F.lit(0.0)),
        "nearest_cum_stream_50": F.coalesce("_half.cum", F.lit(0.0))})
    if tells:
        priced = _sizes_below(priced, curve, keys, tells)
    else:
        priced = priced.withColumn("Contributing_acres", F.when(met, F.col("_hit.size")).otherwise(F.col("_total")))
    return (priced.withColumn("Contributing_acres", F.coalesce("Contributing_acres", F.lit(0.0)))
            .withColumn("Total_Cost", F.col("MC_Cost") * F.col("need"))
            .withColumns({"Cost_acre": ratio("Total_Cost", "Contributing_acres"),
                          "cost_AF": ratio("Total_Cost", "need")})
            .select(*keys, "need", "meets_need", "MC_Cost", "nearest_cum_stream", "MC_Cost_50", "nearest_cum_stream_50",
                    "Contributing_acres", "Total_Cost", "Cost_acre", "cost_AF"))


def _steps_reaching(need: DataFrame, curve: DataFrame, keys: list[str], tells: list[str], half: float) -> DataFrame:
    """keys, need, and the steps that price it: _hit, _last, _half, and the size of all steps, _total.

    Needs and their halves are merged into the curve by cumulative volume; each takes the next step, from
    its own slice or from the first later one that has a step of the curve.  There is no join of needs
    and steps, and a key may have any number of either.
    """
    group = [*keys, *tells]
    points = need
    if tells:
        points = null_safe_join(need, curve.select(*group).distinct(), keys, "left")
    which = F.explode(F.array(F.struct(F.lit(1.0).alias("share"), F.lit("full").alias("which")),
                              F.struct(F.lit(half).alias("share"), F.lit("half").alias("which"))))
    points = points.select(*group, "need", which.alias("p")).select(
        *group, "need", "p.which", (F.col("need") * F.col("p.share")).alias("_cum"), F.lit(0).alias("_kind"))
    steps = curve.where(F.col("_cum").isNotNull()).withColumn("_kind", F.lit(1))
    order = ["_cum", "_kind", "_cost"]  # a step equal to the need comes after it, hence reaches it
    merged = slices.cut(points.unionByName(steps, allowMissingColumns=True), group, order, "merged")

    here = slices.within(group).orderBy(*order)
    is_step = F.col("_kind") == 1
    step = F.struct(F.col("_cost").alias("cost"), F.col("_cum").alias("cum"), F.col("_upto").alias("size"))
    # steps alike in cost and volume count together, as one step: a range frame takes them all
    upto = F.sum("_size").over(here.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rows = merged.withColumn("_upto", upto).withColumn("_step", F.when(is_step, step))
    # the next step is the last one seen from the far end: a frame to the end of the group is read anew for every row
    following = slices.within(group).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = slices.within(group)
    rank = F.when(is_step, F.struct("_cum", "_cost"))
    found = rows.withColumns({"_next": F.last("_step", ignorenulls=True).over(following),
                              "_first": F.min_by("_step", rank).over(whole), "_last": F.max_by("_step", rank).over(whole),
                              "_sum": F.sum("_size").over(whole)})

    pieces = slices.ends(rows, group, {"_sum": F.sum("_size"), "_first": F.min_by("_step", rank), "_last": F.max_by("_step", rank)}, merged)
    before, after, everywhere = slices.earlier(group), slices.later(group), Window.partitionBy(*group)
    grown = lambda c, by: F.when(F.col(c).isNotNull(), F.struct(
        F.col(f"{c}.cost").alias("cost"), F.col(f"{c}.cum").alias("cum"),
        (F.col(f"{c}.size") + F.coalesce(by, F.lit(0.0))).alias("size")))
    pieces = pieces.withColumn("_before", F.sum("_sum").over(before))
    pieces = pieces.withColumn("_own", grown("_first", F.col("_before")))
    in_order = everywhere.orderBy(slices.SLICE).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = pieces.select(
        slices.SLICE, *group, "_before", F.first("_own", ignorenulls=True).over(after).alias("_later"),
        F.first("_own", ignorenulls=True).over(in_order).alias("_very_first"),
        F.last("_last", ignorenulls=True).over(in_order).alias("_very_last"),
        F.sum("_sum").over(everywhere).alias("_all"))
    out = slices.attach(found.where(F.col("_kind") == 0).drop("_step"), carried, group)
    hit = F.when(F.col("need").isNotNull(), F.coalesce(grown("_next", F.col("_before")), F.col("_later")))
    out = out.select(*group, "need", "which", hit.alias("_hit"), F.coalesce("_very_first", "_first").alias("_first"),
                     F.coalesce("_very_last", "_last").alias("_last"), F.coalesce("_all", "_sum").alias("_total"))

    # the curves of a key in their order: the first that reaches the need counts, else the last step of the last one
    place = F.struct(*tells) if tells else F.lit(0)
    full, halved = F.col("which") == "full", F.col("which") == "half"
    reached = F.col("_hit").isNotNull()
    return out.groupBy(*keys, "need").agg(
        F.min_by("_hit", F.when(full & reached, place)).alias("_hit"),
        F.max_by("_last", F.when(full & F.col("_last").isNotNull(), place)).alias("_last"),
        F.coalesce(F.min_by("_hit", F.when(halved & reached, place)),
                   F.min_by("_first", F.when(halved & F.col("_first").isNotNull(), place))).alias("_half"),
        F.max(F.when(full, F.col("_total"))).alias("_total"))


def _sizes_below(priced: DataFrame, curve: DataFrame, keys: list[str], tells: list[str]) -> DataFrame:
    """Add the size of the steps of all curves of a key up to a cost and a volume.

    Up to a cost, as up to a volume, are the steps from the beginning of a curve: the lesser of the two sizes counts.
    Both come from running totals with the priced needs merged in.
    """
    group = [*keys, *tells]
    points = null_safe_join(curve.select(*group).distinct(), stage(priced, "priced"), keys).select(
        *group, "need", F.col("MC_Cost").alias("_cost"), F.col("nearest_cum_stream").alias("_cum"))
    below = None
    for by in ("_cost", "_cum"):
        rows = points.withColumn("_kind", F.lit(1)).unionByName(curve.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
        run = running_totals(rows, group, [by, "_kind"], {"_run": "_size"}).where(F.col("_kind") == 1).select(
            *group, "need", F.coalesce("_run", F.lit(0.0)).alias("_run"))
        below = run if below is None else below.unionByName(run)
    sizes = (below.groupBy(*group, "need").agg(F.min("_run").alias("_size"))
             .groupBy(*keys, "need").agg(F.sum("_size").alias("Contributing_acres")))
    return null_safe_join(priced, sizes, [*keys, "need"], "left")


def curve_slice(curve: DataFrame, **equal) -> DataFrame:
    """Rows of a curve at fixed key values; a list means any of them."""
    for name, value in equal.items():
        values = list(value) if isinstance(value, (list, tuple, set)) else [value]
        curve = curve.where(F.col(name).isin(values))
    return curve


def barter_price(curve: DataFrame, keys: Sequence[str], *, price: float, target: float,
                 cutoff: float | Column, size: str = "Acres", cost: str = "cost_acrft",
                 cum: str = "cum_streamflow") -> DataFrame:
    """Price per unit of size for buying ``target`` at a flat ``price``.

    The payment is spread over the size of the curve rows up to ``cutoff``
    (inclusive); the target point sits at the highest cost strictly below it.
    """
    cut = cutoff if isinstance(cutoff, Column) else F.lit(float(cutoff))
    v = F.col(cum)
    return (curve.groupBy(*keys).agg(
        F.sum(F.when(v <= cut, F.col(size))).alias("acres"),
        F.max(F.when(v < cut, F.col(cost))).alias("target_cost"))
        .withColumn("price_per_acre", ratio(F.lit(price * target), "acres"))
        .withColumn("target_volume", F.lit(float(target))))
