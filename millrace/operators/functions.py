"""The extension surface: user functions over rows, batches, groups and epochs. Arrow batches throughout, never a row at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_batches(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A stream transformer: 0 to many rows out of each batch of rows; batches of a partition come in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield function(pdf)

    return df.mapInPandas(run, schema)


def map_stream(df: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """A transformer over a whole partition's stream; what it holds from batch to batch lives as long as the task."""
    return df.mapInPandas(function, schema)


def scalar(function: Callable[[pd.Series], pd.Series], kind: str) -> Callable[..., Column]:
    """A scalar function over Arrow batches, for what column expressions can't say."""
    return F.pandas_udf(function, kind)


def grouped(df: DataFrame, keys: list[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, most: int = 1_000_000) -> DataFrame:
    """A user aggregate over all rows of a key at once. A key of more than ``most`` rows fails the query: its rows wouldn't fit into a task.

    Aggregates that can be merged from parts belong into ``folded``, and those that can be written as expressions into
    ``group_rows``: neither has such a bound.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return function(pdf)

    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if sizes > most:
        raise ValueError(f"a key has {sizes} rows, more than {most}")
    return df.groupBy(*keys).applyInPandas(run, schema)


def folded(states: DataFrame, keys: list[str], merge: Callable[[pa.Table], pa.Table], finish: Callable[[pa.Table], pa.Table], schema: str, most: int = 100_000) -> DataFrame:
    """A user aggregate for keys of any size. Each row is a state of its key; ``merge`` makes one state per key out of many, ``finish`` the result of a key's last one.

    ``merge`` is called on states of many keys, its own results among them, in any order and split in any way, and returns the columns
    of ``states``. Tasks merge as rows come, so a key moves as a state or a few from each, not as its rows; a task hands on what it
    holds once these are more than ``most`` keys.
    """
    names = states.columns

    def one_each(table: pa.Table) -> pa.Table:
        return merge(table).select(names).cast(table.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, waiting = [], 0
        for batch in batches:
            have.append(batch)
            waiting += batch.num_rows
            if waiting > most:
                merged = one_each(pa.Table.from_batches(have))
                if merged.num_rows > most:
                    yield from merged.to_batches()
                    merged = merged.slice(0, 0)
                have, waiting = merged.to_batches(), 0
        if have:
            yield from one_each(pa.Table.from_batches(have)).to_batches()

    def last(table: pa.Table) -> pa.Table:
        return finish(one_each(table))

    parts = states.mapInArrow(run, states.schema)
    return parts.groupBy(*keys).applyInArrow(last, schema)


def map_epochs(df: DataFrame, epoch: str, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``map_batches`` within epochs: no call sees rows of two epochs, and every row out keeps its epoch's tag, which the function doesn't return."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tag, part in pdf.groupby(epoch, sort=False, dropna=False):
                out = function(part.drop(columns=epoch))
                yield out.assign(**{epoch: None if pd.isna(tag) else tag})

    kind = df.schema[epoch].dataType.simpleString()
    return df.mapInPandas(run, f"{schema}, `{epoch}` {kind}")
