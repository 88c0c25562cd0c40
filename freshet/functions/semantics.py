"""NULL, NaN, zero-denominator and rounding rules shared by all operators.

Spark's defaults differ from the semantics the analyses need in a handful of
places; each helper below is one of those places.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def col(c: Column | str) -> Column:
    """Accept a column name or an expression."""
    return F.col(c) if isinstance(c, str) else c


def if_else(condition: Column, yes, no) -> Column:
    """Three-valued choice: a NULL condition gives NULL, not the else branch."""
    return F.when(condition, yes).when(~condition, no)


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Division that is NULL for a zero denominator (0/0 as well as x/0)."""
    return F.try_divide(col(numerator), col(denominator))


def percent(part: Column | str, whole: Column | str) -> Column:
    return ratio(part, whole) * 100


def sum_or_zero(c: Column | str) -> Column:
    """Sum that is 0, not NULL, when a group has no value at all."""
    return F.coalesce(F.sum(col(c)), F.lit(0.0))


def exact_sum(c: Column | str, digits: int) -> Column:
    """Sum of decimal-valued doubles, exact and the same in every row order.

    Sums whole units of the last digit as 64-bit integers: no rounding drift when
    tasks are retried, and still a combinable, code-generated aggregate.  An
    overflow raises.
    """
    scale = 10.0 ** digits
    return F.sum(F.rint(col(c) * scale).cast("long")) / scale


def to_units(c: Column | str, digits: int) -> Column:
    """Whole units of the last digit, halves up: the same on every engine with IEEE doubles."""
    return F.floor(col(c) * 10.0 ** digits + 0.5)


def from_units(units: Column | str, digits: int) -> Column:
    return col(units).cast("double") / 10.0 ** digits


def units_up_to(units: Column | str, size: Column | str, whole: Column | str) -> Column:
    """``units * size / whole`` as a whole number, halves away from zero; exact for 64-bit inputs.

    What goes to the parts up to some place in a fixed order: the share of one part is the
    difference of two such numbers, so shares of all parts add up to what goes to the last place.
    NULL where the whole is NULL or zero.
    """
    number = lambda c: col(c).cast("decimal(19,0)")
    whole = F.nullif(col(whole), F.lit(0).cast("long"))
    twice = F.abs(number(units)) * (number(size) * 2) + F.abs(number(whole))
    return F.try_divide(F.sign(col(units)).cast("decimal(1,0)") * (twice - twice % (F.abs(number(whole)) * 2)),
                        F.abs(number(whole)) * 2).cast("long")


def pair_max(a: Column, b: Column) -> Column:
    """Larger of two values; NULL as soon as one of them is NULL."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def floor_to_zero(c: Column | str, limit: float) -> Column:
    """Set values under ``limit`` to zero, keep NULL as NULL."""
    c = col(c)
    return if_else(c < limit, F.lit(0.0), c)


def half_even(c: Column | str, digits: int = 0) -> Column:
    return F.bround(col(c), digits)


def number(text: Column | str) -> Column:
    """Number from text; NULL where the text is not a number."""
    return col(text).try_cast("double")


def first_match(arms: Iterable[tuple[Column, Column]]) -> Column:
    """Value of the first arm whose condition holds, NULL if none does."""
    out = None
    for condition, value in arms:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def in_values(c: Column | str, values: Sequence) -> Column:
    """Set membership that is never NULL: NULL is not a member."""
    return F.coalesce(col(c).isin(list(values)), F.lit(False))


def not_in_values(c: Column | str, values: Sequence) -> Column:
    """Negated membership that keeps NULL rows."""
    return ~in_values(c, values)


def _float_columns(df: DataFrame, columns: Iterable[str] | None) -> list[str]:
    wanted = None if columns is None else set(columns)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (DoubleType, FloatType))
            and (wanted is None or f.name in wanted)]


def nan_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Normalise NaN to NULL so that aggregates skip it."""
    found = _float_columns(df, columns)
    if not found:
        return df
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in found})


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep rows without a missing value in ``columns`` (default: all)."""
    return df.dropna("any", subset=list(columns) if columns else None)


def finite(c: Column | str) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def is_in_table(df: DataFrame, other: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``other`` (semi join)."""
    return _membership(df, other, on, "left_semi")


def not_in_table(df: DataFrame, other: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``other``.

    An anti join, so rows with a NULL key stay and a NULL in ``other`` does not
    empty the result the way NOT IN would.
    """
    return _membership(df, other, on, "left_anti")


def _membership(df: DataFrame, other: DataFrame, on: dict[str, str], how: str) -> DataFrame:
    # Distinct keys: repeats combine before the shuffle, which the join reuses.
    keys = {right: f"_member_{i}" for i, right in enumerate(on.values())}
    small = other.select(*[F.col(r).alias(a) for r, a in keys.items()]).distinct()
    condition = [F.col(left) == F.col(keys[right]) for left, right in on.items()]
    return df.join(small, condition, how)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL equals NULL; the keys of ``left`` stay."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(other, condition, how).drop(*[f"_right_{k}" for k in keys])


def null_safe_merge(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer merge on all columns of two tables that share all of them.

    NULL equals NULL.  Rows on one side only stay as they are; a row on both
    sides appears once per matching pair.  Written as a left join plus an anti
    join, both of which Spark can split on a hot key; a full outer join it cannot.
    """
    columns = left.columns
    other = right.select(*[F.col(c).alias(f"_right_{c}") for c in columns])
    same = [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in columns]
    matched = left.join(other, same, "left").select(*columns)
    mine = left.select(*[F.col(c).alias(f"_right_{c}") for c in columns])
    return matched.unionByName(right.select(*columns).join(mine, same, "left_anti"))
