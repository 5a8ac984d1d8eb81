"""Lookup, write-back and inequality joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A dimension of at most so many rows and bytes is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: A key with more than one part in HOT_PARTS of the facts is hot: there are at most so many, and each is split over SALTS.
HOT_PARTS, SALTS = 200, 64


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a frame has at most ``rows`` rows and, written as JSON, ``size`` bytes; looked at up to the limit only."""
    width = F.coalesce(F.octet_length(F.to_json(F.struct(*df.columns))), F.lit(0)) if df.columns else F.lit(0)
    seen = df.select(width.alias("w")).limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()
    return seen["n"] <= rows and seen["w"] <= size


def small_side(dimension: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """The frame with a broadcast hint if it is small enough."""
    return F.broadcast(dimension) if is_small(dimension, rows, size) else dimension


def lookup_join(facts: DataFrame, dimension: DataFrame, on: list[str] | str | Column, how: str = "left") -> DataFrame:
    """Facts with a dimension's columns; the dimension is broadcast only after a check of its size."""
    return facts.join(small_side(dimension), on, how)


def salted_join(facts: DataFrame, dimension: DataFrame, on: list[str], how: str = "left", rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``lookup_join`` by equal columns for facts of which few keys hold most rows: where the dimension is too large to be broadcast, hot keys are split.

    ``how``: left or inner. A null key meets nothing. The facts are counted by key first, in each task before the shuffle.
    """
    if how not in ("left", "inner"):
        raise ValueError("a salted join is left or inner")
    if is_small(dimension, rows, size):
        return facts.join(F.broadcast(dimension), on, how)
    counts = facts.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    total = facts.count()
    keys = [F.col(c).alias(f"__k{i}") for i, c in enumerate(on)]
    hot = counts.where(F.col("__n") * HOT_PARTS > total).select(*keys).limit(HOT_PARTS).withColumn("__hot", F.lit(True))  # no more can be

    def marked(df: DataFrame) -> DataFrame:
        met = F.lit(True)
        for i, c in enumerate(on):
            met = met & df[c].eqNullSafe(F.col(f"__k{i}"))
        return df.join(F.broadcast(hot), met, "left").drop(*(f"__k{i}" for i in range(len(on))))

    # by the row's own values, so that a task run again gives a row the same salt
    own = [c for c, kind in facts.dtypes if "map<" not in kind and kind != "variant"]
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*own), F.lit(SALTS)).cast("int")).otherwise(0)
    for c in on:  # a null key meets nothing wherever it lies
        salt = F.when(F.col(c).isNull(), F.pmod(F.xxhash64(*own), F.lit(1 << 20)).cast("int")).otherwise(salt)
    left = marked(facts).withColumn("__salt", salt).drop("__hot")
    every = F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    right = marked(dimension).withColumn("__salt", every).drop("__hot")
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def write_back(df: DataFrame, store: DataFrame, key: str, mark: str) -> DataFrame:
    """``df`` with ``mark`` true where the store has the row's key; rows that the store lacks pass through with null."""
    known = store.select(key).distinct().withColumn(mark, F.lit(True))
    return df.join(known, key, "left")


def events_after_snapshot(events: DataFrame, snapshots: DataFrame, run: str, event_id: str, as_of: str) -> DataFrame:
    """The events of each run that its latest snapshot doesn't hold; all events of a run without one."""
    latest = snapshots.groupBy(run).agg(F.max(as_of).alias("__as_of"))
    return events.join(latest, run, "left").where(F.col("__as_of").isNull() | (F.col(event_id) > F.col("__as_of"))).drop("__as_of")
