"""Unit conversions and clean-up clamps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .semantics import col, if_else


def hectares(acres: Column | str) -> Column:
    return col(acres) * fv.HECTARE_PER_ACRE


def square_feet(acres: Column | str) -> Column:
    return col(acres) * fv.FT2_PER_ACRE


def mm_to_feet(depth: Column | str) -> Column:
    return col(depth) * fv.FT_PER_MM


def mm_to_acre_feet(depth: Column | str, acres: Column | str) -> Column:
    return mm_to_feet(depth) * col(acres)


def mm_to_cubic_feet(depth: Column | str, acres: Column | str) -> Column:
    return mm_to_feet(depth) * square_feet(acres)


def cubic_feet_to_cfs(volume: Column | str, days: int = fv.WINDOW_DAYS) -> Column:
    """Constant rate that delivers ``volume`` cubic feet in ``days`` days."""
    return col(volume) / (fv.SECONDS_PER_DAY * days)


def cfs_to_acre_feet(rate: Column | str, days: int = fv.WINDOW_DAYS) -> Column:
    return col(rate) * (fv.SECONDS_PER_DAY * days) / fv.FT2_PER_ACRE


def clamp_above(c: Column | str, limit: float) -> Column:
    """Cap at ``limit``; NULL stays NULL."""
    c = col(c)
    return if_else(c > limit, F.lit(float(limit)), c)
