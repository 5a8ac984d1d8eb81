"""Readers of the tables that the queries run over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a data folder; columns and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(column: str | Column) -> Column:
    """Microseconds from 1970-01-01 00:00:00 of a timestamp without zone, as written (the session is in UTC)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(c.cast("timestamp"))
