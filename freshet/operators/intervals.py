"""Points and the intervals that contain them, joined by equality.

An interval is covered by blocks of the power of two next to its length: one or two, seldom three.  A point
lies in one block of every size in use.  (size, block) is an equi join key: hash joined, split on a
hot key, never a nested loop, and its cost does not depend on how finely positions are measured.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import finite

#: bits of a block number, so that doubles hold it exactly
BLOCK_BITS = 50


def tag_intervals(points: DataFrame, intervals: DataFrame, *, point: str, start: str, stop: str,
                  on: Sequence[str] = ()) -> DataFrame:
    """Rows of ``points`` with every interval that contains ``point`` (both ends included) and shares ``on``.

    Positions are numbers, fractional or not.  Intervals may overlap and be of any length; one
    that ends before it starts, or has a missing or infinite end, contains nothing.  Rows in no interval
    drop out.  Columns of the two sides other than ``on`` have different names.
    """
    low, high = F.col(start).cast("double"), F.col(stop).cast("double")
    log2 = lambda c: F.coalesce(F.log2(F.when(c > 0, c)), F.lit(-1000.0))
    least = F.floor(log2(F.greatest(F.abs(low), F.abs(high)))) - BLOCK_BITS
    level = F.greatest(F.ceil(log2(high - low)), least).cast("int")
    covered = intervals.where(finite(low) & finite(high) & (low <= high)).withColumn("_level", level)
    width = F.pow(F.lit(2.0), F.col("_level"))
    covered = covered.withColumn("_block", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    # the sizes in use: a few dozen at most
    levels = sorted(r[0] for r in covered.select("_level").distinct().collect())
    size = F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))
    p = F.col(point).cast("double")
    placed = points.where(finite(p)).withColumn("_level", size)
    # beyond the blocks of a size nothing is covered, and the number need not be exact
    block = F.floor(p / F.pow(F.lit(2.0), F.col("_level")))
    placed = placed.withColumn("_block", F.when(F.abs(p / F.pow(F.lit(2.0), F.col("_level"))) < 2.0 ** 62, block))
    return (placed.join(covered, [*on, "_level", "_block"])
            .where(p.between(low, high)).drop("_level", "_block"))
