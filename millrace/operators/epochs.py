"""Epochs: segmentation, progress of blocks, alignment watermark, checkpoint strategies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import vectors
from millrace.operators.ordered import last_known, numbered, numbered_within, segmented


#: Known epochs that an ancestor may be sought among.
MOST_CANDIDATES = 10_000


def single_epoch(df: DataFrame, source: str) -> DataFrame:
    """All rows in one epoch: ``epoch`` is {source: 1}."""
    return df.withColumn("epoch", F.create_map(F.lit(source), F.lit(1).cast("bigint")))


def segment_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``epoch_seq`` from 1: a contiguous run of equal keys is an epoch, the same key later is another."""
    return segmented(df, key, order)


def segment_by_clock(df: DataFrame, clock: DataFrame, ts: str, clock_ts: str, vector: str) -> DataFrame:
    """Adds ``epoch``: the clock's last vector at or before each row's time, null before the first.

    ``clock`` holds a row per change of the clock; rows and ticks meet in one global sort, as a union.
    """
    kind = clock.schema[vector].dataType
    both = df.withColumn("__tick", F.lit(1)).withColumn("__at", F.col(ts)).withColumn("__v", F.lit(None).cast(kind)).unionByName(
        clock.select(F.lit(0).alias("__tick"), F.col(clock_ts).alias("__at"), F.col(vector).alias("__v")), allowMissingColumns=True
    )
    return last_known(both, "__v", ["__at", "__tick"], "epoch").where("__tick = 1").drop("__tick", "__at", "__v")


@dataclass(frozen=True)
class EpochPolicy:
    """When an epoch ends: after ``items`` rows, after ``window_us``, or whichever comes first. Both must be positive."""

    items: int | None = None
    window_us: int | None = None

    def __post_init__(self) -> None:
        if self.items is None and self.window_us is None:
            raise ValueError("a policy needs a count or a time")
        if any(x is not None and x <= 0 for x in (self.items, self.window_us)):
            raise ValueError("a policy's count and time must be positive")

    @classmethod
    def by_count(cls, items: int = 100) -> EpochPolicy:
        return cls(items=items)

    @classmethod
    def by_time(cls, window_us: int) -> EpochPolicy:
        return cls(window_us=window_us)

    @classmethod
    def by_count_or_time(cls, items: int, window_us: int) -> EpochPolicy:
        return cls(items, window_us)


def cut_epochs(df: DataFrame, policy: EpochPolicy, order: list[str], ts_us: str | None = None) -> DataFrame:
    """Adds ``epoch_seq`` from 1 by the policy; times count from the first row's."""
    if policy.window_us is None:
        return numbered(df, order, "__rn").withColumn("epoch_seq", F.expr(f"(__rn - 1) div {policy.items} + 1")).drop("__rn")
    start = df.agg(F.min(ts_us)).first()[0] or 0
    rows = df.withColumn("__tick", F.expr(f"(`{ts_us}` - {start}) div {policy.window_us}"))
    if policy.items is not None:
        rows = numbered_within(rows, ["__tick"], order, "__rn").withColumn("__tick", F.struct("__tick", F.expr(f"(__rn - 1) div {policy.items}").alias("chunk"))).drop("__rn")
    return segmented(rows, "__tick", order).drop("__tick")


def highest_completed(progress: DataFrame) -> DataFrame:
    """(block, source, seq): the greatest completed sequence of each block and source; gaps don't count. ``progress``: block, source, seq, status."""
    return progress.where("status = 'completed'").groupBy("block", "source").agg(F.max("seq").alias("seq"))


def global_watermark(progress: DataFrame) -> DataFrame:
    """(source, seq): of each source the least of its blocks' greatest completed sequences.

    A block that has completed nothing of a source is not waited for, so the watermark can run ahead of it.
    """
    return highest_completed(progress).groupBy("source").agg(F.min("seq").alias("seq"))


def is_aligned(progress: DataFrame, vector: Column) -> DataFrame:
    """One row, ``aligned``: whether the watermark is as far as the vector."""
    mark = global_watermark(progress).agg(F.map_from_entries(F.collect_list(F.struct("source", "seq"))).alias("w"))
    return mark.select(vectors.at_most(vector, F.col("w")).alias("aligned"))


def clear_completed(progress: DataFrame, up_to: DataFrame) -> DataFrame:
    """The progress rows beyond a watermark (source, seq); rows of sources that it lacks stay."""
    mark = up_to.select("source", F.col("seq").alias("__seq"))
    return progress.join(mark, "source", "left").where("__seq is null or seq > __seq or status != 'completed'").drop("__seq")


def align_sources(epochs: DataFrame) -> DataFrame:
    """(seq, n_sources, vector): the barrier of several sources, which advance together: an epoch per sequence with the merged vector. ``epochs``: source, seq."""
    return epochs.groupBy("seq").agg(F.countDistinct("source").alias("n_sources"), F.map_from_entries(F.array_sort(F.collect_set(F.struct("source", F.col("seq").alias("s"))))).alias("vector"))


def barrier(epochs: DataFrame, sources: list[str]) -> DataFrame:
    """(seq, n_sources, vector, made): the barrier of registered sources, which enter an epoch only when all have finished the one before.

    ``epochs``: source, seq - the epochs that each source has finished, from 1. An epoch is ``made`` when every registered
    source has come as far; those beyond are held, whoever has finished them, and all are while a source hasn't come at
    all. A row of a source that isn't registered fails the query; rows with a null count for nothing; repeated rows count once.
    """
    if not sources:
        raise ValueError("at least one source is needed")
    known = F.when(F.col("source").isin(*sources), F.col("source")).otherwise(F.raise_error(F.concat(F.lit("source not registered: "), F.col("source"))))
    rows = epochs.where("source is not null and seq is not null").withColumn("source", known)
    far = {r["source"]: r["far"] for r in rows.groupBy("source").agg(F.max("seq").alias("far")).collect()}  # a row per registered source
    mark = min(far.get(s, 0) for s in sources)
    return align_sources(rows).withColumn("made", F.col("seq") <= mark)


def most_specific_ancestor(vectors_: DataFrame, candidates: DataFrame, key: str, value: str) -> DataFrame:
    """(key, ancestor): of the candidates that each vector subsumes and doesn't equal, the one with the most sources, then the greatest sum, then the least key.

    ``candidates`` is a list of known epochs of at most MOST_CANDIDATES rows, which is checked. A candidate is looked at
    only for vectors that have its first source: they meet by a hash join on that source. One that asks for no source meets all. A row without an ancestor, or with a null vector, gets null.
    """
    if candidates.limit(MOST_CANDIDATES + 1).count() > MOST_CANDIDATES:
        raise ValueError(f"more than {MOST_CANDIDATES} candidate epochs")
    asked = F.transform(F.filter(F.map_entries(F.col("__cv")), lambda e: e["value"] >= 0), lambda e: e["key"])  # a missing source counts as -1
    c = candidates.select(F.col(key).alias("__ck"), F.col(value).alias("__cv")).where("__cv is not null")
    c = c.withColumn("__by", F.struct((F.size(asked) > 0).alias("some"), F.coalesce(F.array_min(asked), F.lit("")).alias("source")))
    ways = F.transform(F.coalesce(F.map_keys(F.col(value)), F.array().cast("array<string>")), lambda x: F.struct(F.lit(True).alias("some"), x.alias("source")))
    rows = vectors_.select(key, value, F.explode(F.concat(ways, F.array(F.struct(F.lit(False).alias("some"), F.lit("").alias("source"))))).alias("__by"))
    equal = vectors.at_most(F.col(value), F.col("__cv")) & vectors.at_most(F.col("__cv"), F.col(value))
    met = rows.join(F.broadcast(c), (rows["__by"] == c["__by"]) & F.col(value).isNotNull() & vectors.subsumes(F.col(value), F.col("__cv")) & ~equal, "left")
    rank = F.struct(F.cardinality("__cv"), vectors.total(F.col("__cv")), -F.col("__ck"))
    return met.groupBy(key).agg(F.max_by("__ck", F.when(F.col("__ck").isNotNull(), rank)).alias("ancestor"))


def every_n(df: DataFrame, seq: str, n: int) -> DataFrame:
    """Adds ``checkpoint``: true at the n-th, 2n-th, ... epoch."""
    if n <= 0:
        raise ValueError("n must be positive")
    return df.withColumn("checkpoint", F.col(seq) % n == 0)


def time_based(df: DataFrame, ts_us: str, interval_us: int, by: list[str] | None = None) -> DataFrame:
    """Adds ``checkpoint``: true first, then when at least the interval has passed since the last true one. One greedy scan over the epochs, per key."""
    if interval_us <= 0:
        raise ValueError("the interval must be positive")

    def scan(pdf):
        pdf, last, out = pdf.sort_values(ts_us), None, []
        for t in pdf[ts_us]:
            hit = last is None or t - last >= interval_us
            last = t if hit else last
            out.append(hit)
        return pdf.assign(checkpoint=out)

    schema = df.schema.simpleString()[7:-1] + ",checkpoint:boolean"
    rows = df if by else df.withColumn("__all", F.lit(0))
    return rows.groupBy(*(by or ["__all"])).applyInPandas(lambda pdf: scan(pdf.drop(columns="__all", errors="ignore")), schema)


def checkpoint_object(states: DataFrame, keys: list[str], block: str, state: str) -> DataFrame:
    """One row per checkpoint with ``states``, a map from block to its state; two states of one block fail the query."""
    return states.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(block).alias("b"), F.col(state).alias("s"))))).alias("states"))


def latest_checkpoint(checkpoints: DataFrame, ts: str) -> DataFrame:
    """The last checkpoint by time, as one row; of equal times the greatest."""
    return checkpoints.agg(F.max(F.struct(ts, *(c for c in checkpoints.columns if c != ts))).alias("c")).where("c is not null").select("c.*")
