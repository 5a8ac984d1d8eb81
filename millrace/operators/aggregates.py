"""Grouped aggregation, per chunk, per batch and over everything; nesting of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_rows(df: DataFrame, keys: list[str], aggregates: dict[str, Column], chunk: str | None = None) -> DataFrame:
    """Aggregates per key over the whole frame, or within each chunk if one is named."""
    return df.groupBy(*([chunk] if chunk else []), *keys).agg(*(c.alias(n) for n, c in aggregates.items()))


def count_and_total(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n_rows, total_value) per group, such as a batch and category."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(value).alias("total_value"))


def running_totals(df: DataFrame, value: str) -> DataFrame:
    """One row: the rows and the sum of the values in whole hundredths, cut towards zero; 0 for no rows."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum((F.col(value) * 100).cast("bigint")), F.lit(0)).cast("bigint").alias("total_hundredths"))


def nest(df: DataFrame, keys: list[str], items: str, fields: list[str]) -> DataFrame:
    """One row per key with its rows as a sorted array of structs. A key's rows must fit into a row, as nesting implies."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(items))


def unnest(df: DataFrame, items: str) -> DataFrame:
    """The inverse of ``nest``: a row per struct of the array; empty and null arrays give none."""
    rest = [c for c in df.columns if c != items]
    return df.select(*rest, F.inline(items))
