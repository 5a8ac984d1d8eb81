"""Scalar helpers: text tests, rounding, time differences, JSON parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_null_or_empty(c: Column) -> Column:
    return F.coalesce(F.length(c), F.lit(0)) == 0


def equals_ignore_case(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def round_even(c: Column, digits: int) -> Column:
    """Half to even."""
    return F.bround(c, digits)


def seconds_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(1e6)


def parameter(json: Column, name: str, kind: str, default: Column | None = None) -> Column:
    """A typed trigger parameter; absent or not of that type is the default, null without one."""
    found = F.get_json_object(json, f"$.{name}").try_cast(kind)
    return found if default is None else F.coalesce(found, default)


def required_parameter(json: Column, name: str, kind: str) -> Column:
    """The same, but a missing one fails the query."""
    found = parameter(json, name, kind)
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.lit(f"parameter {name} is missing")).cast(kind))
