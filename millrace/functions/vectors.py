"""Vector clocks: maps from source to sequence number, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge(a: Column, b: Column) -> Column:
    """The larger number of each source."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(x, y))


def sequence(v: Column, source: str | Column) -> Column:
    """The number of a source, -1 if it is missing."""
    return F.coalesce(F.try_element_at(v, F.lit(source) if isinstance(source, str) else source), F.lit(-1).cast("bigint"))


def at_most(a: Column, b: Column) -> Column:
    """Whether every source of ``a`` is in ``b`` with a number as large; a source that ``b`` lacks makes it false."""
    return F.forall(F.map_entries(a), lambda e: F.coalesce(F.try_element_at(b, e["key"]) >= e["value"], F.lit(False)))


def subsumes(a: Column, b: Column) -> Column:
    """Whether ``a`` is as far as ``b`` on every source of ``b``, a missing source counting as -1."""
    return F.forall(F.map_entries(b), lambda e: sequence(a, e["key"]) >= e["value"])


def advance(v: Column, source: str) -> Column:
    """The vector with the source's number raised by one, from 1 if it is new."""
    own = F.create_map(F.lit(source), F.greatest(sequence(v, source), F.lit(0)) + 1)
    return F.map_zip_with(v, own, lambda _, x, y: F.coalesce(y, x))


def total(v: Column) -> Column:
    """The sum of all numbers."""
    return F.aggregate(F.map_values(v), F.lit(0).cast("bigint"), lambda a, x: a + x)


def text(v: Column) -> Column:
    """``EpochVector[a=1, b=2]`` sorted by source, ``EpochVector.None`` if empty."""
    parts = F.transform(F.array_sort(F.map_entries(v)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return F.when(F.cardinality(v) == 0, "EpochVector.None").otherwise(F.concat(F.lit("EpochVector["), F.array_join(parts, ", "), F.lit("]")))
