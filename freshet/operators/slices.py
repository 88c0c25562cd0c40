"""Ordered rows in range slices, for windows over groups of any size.

A plain window puts a whole group into one task.  With one group holding a third of a 100 TB
table that is too much, so the ordered rows are cut into ranges, whatever their number: a group may
go on from slice to slice.

``cut`` orders the rows by one range exchange and writes every range with its number, as a
table bucketed by that number.  A scan of it is clustered by slice already: windows and aggregates
within (slice, group) run without another exchange.  Only the first and the last group of a
slice can have rows in other slices.  ``ends`` gathers what these hold, a few small rows for each slice;
only rows of these groups are aggregated for it.  From them follows what earlier or later slices hold of a group, and a broadcast of that is
bounded by the number of slices, not by the data.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import INITIAL_PARTITIONS, shared_dir, written_table

SLICE = "_slice"


def slice_count(spark: SparkSession) -> int:
    """As many slices as the session has shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")),
               int(spark.conf.get(INITIAL_PARTITIONS, None) or 1))


def cut(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str = "slices",
        n: int | None = None) -> DataFrame:
    """The rows of ``df``, written, with the slice each belongs to; ``n`` slices, or :func:`slice_count`.

    All slices together are ordered by (keys, order), NULLs first; rows alike in all of
    these share a slice.  A retry reads what is written, so a row never changes its slice.
    """
    spark = df.sparkSession
    n = n or slice_count(spark)
    name = f"{label}_{uuid.uuid4().hex}"
    part = F.spark_partition_id().alias("_part")
    numbers = spark.createDataFrame(list(enumerate(_numbers(n))), f"_part int, {SLICE} int")
    (df.repartitionByRange(n, *keys, *order).select("*", part).join(F.broadcast(numbers), "_part").drop("_part")
     .write.format("parquet").mode("errorifexists").option("path", f"{shared_dir(spark)}/{name}")
     .bucketBy(n, SLICE).saveAsTable(name))
    return written_table(spark, name)


@lru_cache(maxsize=64)
def _numbers(n: int) -> tuple[int, ...]:
    """Ascending slice numbers that fall into ``n`` different buckets, so that each has a task of its own."""
    out, free, i = [], set(range(n)), 0
    while free:
        bucket = _hash(i) % n
        if bucket in free:
            free.remove(bucket)
            out.append(i)
        i += 1
    return tuple(out)


def _hash(i: int, seed: int = 42) -> int:
    """Spark's hash of an int, a signed 32-bit Murmur 3; the tests compare it with Spark's."""
    def turn(x, by):
        return (x << by | x >> 32 - by) & 0xFFFFFFFF

    k = turn(i * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
    h = (turn(seed ^ k, 13) * 5 + 0xE6546B64 & 0xFFFFFFFF) ^ 4
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * factor & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def within(keys: Sequence[str]) -> WindowSpec:
    """The rows of a group that share a slice."""
    return Window.partitionBy(SLICE, *keys)


def ends(rows: DataFrame, keys: Sequence[str], held: Mapping[str, Column], table: DataFrame | None = None) -> DataFrame:
    """Aggregates ``held`` of the first and the last group of each slice: (slice, keys, held).

    A group with rows in several slices has all its pieces here.  ``table`` is what :func:`cut` gave, where
    ``rows`` were made from it at some cost: only its keys are read to find the groups.
    """
    if keys:
        one = len(keys) == 1  # cheaper than a struct, but least and largest pass over a missing key
        key = F.col(keys[0]) if one else F.struct(*keys)
        bounds = (rows if table is None else table).groupBy(F.col(SLICE).alias("_of")).agg(
            F.min(key).alias("_first"), F.max(key).alias("_last"))
        rows = rows.join(F.broadcast(bounds), F.col(SLICE) == F.col("_of"))
        at_end = key.eqNullSafe(F.col("_first")) | key.eqNullSafe(F.col("_last"))
        rows = rows.where((at_end | key.isNull()) if one else at_end)
    return rows.groupBy(SLICE, *keys).agg(*[c.alias(o) for o, c in held.items()])


def earlier(keys: Sequence[str]) -> WindowSpec:
    """Over ``ends``: the pieces of the group in slices before."""
    return Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)


def later(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(1, Window.unboundedFollowing)


def attach(rows: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns of ``carried`` (slice, keys, ...) beside the rows of their piece, NULL beside all other rows.

    ``carried`` has three rows a slice at most (first, last, missing key), hence the broadcast.
    """
    on = [SLICE, *keys]
    small = F.broadcast(carried.withColumnsRenamed({c: f"_at_{c}" for c in on}))
    same = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in on]
    return rows.join(small, same, "left").drop(*[f"_at_{c}" for c in on])


def group_totals(cut: DataFrame, keys: Sequence[str], totals: Mapping[str, tuple[Callable[[Column], Column], Column]],
                 table: DataFrame | None = None) -> DataFrame:
    """Add aggregates of the whole group to every row: output column -> (F.sum, F.min or F.max, expression)."""
    rows = cut.withColumns({f"_in_{o}": c for o, (_, c) in totals.items()})
    local = rows.withColumns({o: fn(F.col(f"_in_{o}")).over(within(keys)) for o, (fn, _) in totals.items()})
    pieces = ends(rows, keys, {f"_all_{o}": fn(F.col(f"_in_{o}")) for o, (fn, _) in totals.items()}, table)
    whole = Window.partitionBy(*keys)
    carried = pieces.select(SLICE, *keys, *[fn(F.col(f"_all_{o}")).over(whole).alias(f"_all_{o}")
                                            for o, (fn, _) in totals.items()])
    return (attach(local, carried, keys).withColumns({o: F.coalesce(f"_all_{o}", o) for o in totals})
            .drop(*[f"_all_{o}" for o in totals], *[f"_in_{o}" for o in totals]))


def neighbours(cut: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], *,
               before: str = "before", after: str = "after", table: DataFrame | None = None) -> DataFrame:
    """Add the ``values`` of the row before and of the row after in the group, as structs.

    They are NULL on the first and on the last row of a group, not of a slice.  ``order`` must tell the rows of a
    group apart, or rows alike in it have no fixed neighbours.
    """
    row, place = F.struct(*values), F.struct(*order)
    here = within(keys).orderBy(*order)
    local = cut.withColumns({before: F.lag(row).over(here), after: F.lead(row).over(here)})
    pieces = ends(cut, keys, {"_first": F.min_by(row, place), "_last": F.max_by(row, place)}, table)
    carried = pieces.select(SLICE, *keys, F.last("_last").over(earlier(keys)).alias("_before"),
                            F.first("_first").over(later(keys)).alias("_after"))
    return (attach(local, carried, keys)
            .withColumns({before: F.coalesce(before, "_before"), after: F.coalesce(after, "_after")})
            .drop("_before", "_after"))
