"""Batches by size, by size or tick, within epochs, by row ranges and by accumulated chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.durable import durable
from millrace.operators.ordered import PART, laid_out, numbered, numbered_within, running, segmented


def _positive(n: int, what: str) -> None:
    if n <= 0:
        raise ValueError(f"{what} must be positive, not {n}")


def batch_by_size(df: DataFrame, size: int, order: list[str]) -> DataFrame:
    """Adds ``batch_id`` from 1: every ``size`` rows in order make a batch, the last may be smaller. Rows are numbered over all partitions."""
    _positive(size, "the batch size")
    return numbered(df, order, "__rn").withColumn("batch_id", F.expr(f"(__rn - 1) div {size} + 1")).drop("__rn")


def batch_by_size_or_tick(df: DataFrame, size: int, ts_us: str, period_us: int, start_us: int | None = None, within: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Adds ``tick`` and ``chunk``: a timer that ticks every ``period_us`` from ``start_us`` cuts batches, and so do ``size`` rows.

    The timer is free-running: a batch cut by size doesn't restart it. ``start_us`` None: the first time of the
    stream, or of each group of ``within``. Rows are taken by time, those of one time by ``order``, or by their other
    columns where none is given, so that the batches are the same each time. A null time has a null tick.
    """
    _positive(size, "the batch size")
    _positive(period_us, "the period")
    keys = within or []
    ties = order or [c for c, kind in df.dtypes if c not in (*keys, ts_us) and "map<" not in kind]
    rows = laid_out(df, [*keys, *dict.fromkeys([ts_us, *ties])])
    if start_us is None:
        rows = running(rows, keys, F.col(ts_us).cast("bigint"), "__origin", "min")
    else:
        rows = rows.withColumn("__origin", F.lit(start_us).cast("bigint"))
    rows = rows.withColumn("tick", F.expr(f"(`{ts_us}` - __origin) div {period_us}"))
    rows = running(rows, [*keys, "tick"], F.lit(1).cast("bigint"), "__rn")
    return rows.withColumn("chunk", F.floor((F.col("__rn") - 1) / size)).drop("__origin", "__rn", "__at", PART)


def epoch_batch(df: DataFrame, size: int, key: Column, order: list[str]) -> DataFrame:
    """Adds ``epoch_seq`` (contiguous runs of ``key``) and ``batch_no`` from 1 within it: batches never span epochs."""
    _positive(size, "the batch size")
    rows = segmented(df.withColumn("__key", key), "__key", order).drop("__key")
    return numbered_within(rows, ["epoch_seq"], order, "__rn").withColumn("batch_no", F.expr(f"(__rn - 1) div {size} + 1")).drop("__rn")


def row_ranges(df: DataFrame, parts: int, order: list[str]) -> DataFrame:
    """Adds ``part_no`` from 0: contiguous ranges of ceil(rows / parts) rows; there may be fewer ranges than ``parts``, at least 2 are asked for."""
    if parts < 2:
        raise ValueError("at least two ranges are needed")
    rows = numbered(df, order, "__rn")
    size = max(1, -(-df.count() // parts))
    return rows.withColumn("part_no", F.expr(f"(__rn - 1) div {size}")).drop("__rn")


def accumulate_chunks(df: DataFrame, chunk: str, target: int) -> DataFrame:
    """(chunk, n_rows, emit_no): whole chunks in order are put together until they hold ``target`` rows; the last group may be smaller.

    The greedy scan runs over one row per chunk, in order of the chunk's name.
    """
    _positive(target, "the target")
    sizes = durable(df.groupBy(F.col(chunk).alias("chunk")).agg(F.count(F.lit(1)).alias("n_rows")))

    def greedy(key, pdf):
        pdf = pdf.sort_values("chunk")
        out, emit, held = [], 1, 0
        for n in pdf["n_rows"]:
            out.append(emit)
            held += n
            if held >= target:
                emit, held = emit + 1, 0
        return pdf.assign(emit_no=out)[["chunk", "n_rows", "emit_no"]]

    kind = sizes.schema["chunk"].dataType.simpleString()
    return sizes.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandas(greedy, f"chunk {kind}, n_rows bigint, emit_no bigint")


def collect_batches(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each batch as one row with its items in order: ``items``, an array of structs."""
    rest = [c for c in df.columns if c not in keys]
    item = F.struct(*order, *(c for c in rest if c not in order))
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
