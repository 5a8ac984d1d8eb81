"""Fan-out, fan-in, set operations and de-duplication."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.durable import durable
from millrace.operators.ordered import numbered_within


def broadcast_to(df: DataFrame, branches: dict[str, Callable[[DataFrame], DataFrame]], keep: bool = False) -> dict[str, DataFrame]:
    """Every branch sees every row. Frames are immutable, so no copy is made for a branch.

    ``keep``: the rows are computed once and kept for all branches; without it each branch works out its own rows,
    which over a scan is cheaper, as each reads only the columns and rows that it needs.
    """
    df = durable(df) if keep else df
    return {name: f(df) for name, f in branches.items()}


def assign_competing(df: DataFrame, consumers: int, by: Column) -> DataFrame:
    """Adds ``consumer``: every row goes to exactly one of the consumers, by its key."""
    if consumers <= 0:
        raise ValueError("at least one consumer is needed")
    return df.withColumn("consumer", F.pmod(by, F.lit(consumers)).cast("int"))


def fan_in(*frames: DataFrame, allow_missing: bool = False) -> DataFrame:
    """All rows of all frames, columns by name (UNION ALL)."""
    if not frames:
        raise ValueError("at least one source is needed")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def column_merge(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Inner join of two branches on a row id; other columns in both get the suffixes ``_left`` and ``_right``."""
    both = (set(left.columns) & set(right.columns)) - {on}
    a = left.select(on, *(F.col(c).alias(f"{c}_left" if c in both else c) for c in left.columns if c != on))
    b = right.select(on, *(F.col(c).alias(f"{c}_right" if c in both else c) for c in right.columns if c != on))
    return a.join(b, on)


def dedup(df: DataFrame, keys: list[str], order: list[str], within: list[str] | None = None) -> DataFrame:
    """The first row per key in the given order, globally or within a chunk. Keys are compared column by column, null equals null.

    The first row is found by a minimum that tasks work out before rows move, so a hot key costs one row per task.
    """
    by = [*(within or []), *keys]
    rest = [c for c in df.columns if c not in by]
    first = F.min(F.struct(*(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)), *rest)).alias("__first")
    return df.groupBy(*by).agg(first).select(*(c if c in by else F.col(f"__first.{c}").alias(c) for c in df.columns))


def control_to_all(data: DataFrame, control: DataFrame, route: Column, targets: list[str]) -> DataFrame:
    """Adds ``target``: data rows go to their route, control rows to every target."""
    every = F.explode(F.array(*(F.lit(t) for t in targets)))
    return data.withColumn("target", route).unionByName(control.withColumn("target", every))


def round_robin(df: DataFrame, consumers: int, order: list[str], by: list[str]) -> DataFrame:
    """Adds ``consumer``: the rows of each key in turn to the consumers. A key of any number of rows is numbered over many tasks."""
    if consumers <= 0:
        raise ValueError("at least one consumer is needed")
    return numbered_within(df, by, order, "__rn").withColumn("consumer", ((F.col("__rn") - 1) % consumers).cast("int")).drop("__rn")
