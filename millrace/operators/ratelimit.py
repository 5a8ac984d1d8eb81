"""When items leave a rate limiter, as closed forms over the arrival times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import PART, laid_out, numbered, numbered_within, running, running_within


def release_windows(df: DataFrame, arrival: str, order: list[str], permits: int, segments: int = 1) -> DataFrame:
    """Adds ``release``: the window (or segment) in which each item gets a permit, first come first served.

    ``arrival`` counts windows (segments) and doesn't fall in the given order; each window grants ``permits``, a sliding
    window of ``segments`` segments as many. Of the items of one residue modulo ``permits``, the j-th leaves at
    S*j + max over m<=j of (a_m - S*m): a running maximum, carried over partition borders.
    """
    if permits <= 0 or segments <= 0:
        raise ValueError("permits and segments must be positive")
    if segments == 1:
        # S = 1: any earlier item bounds the release by a_m + floor((i - m) / permits), so one running maximum does
        rows = laid_out(df, order)
        rows = running(rows, [], F.lit(1).cast("bigint"), "__i")
        rows = running(rows, [], (F.col(arrival) * permits - F.col("__i")).cast("bigint"), "__m", "max")
        return rows.withColumn("release", F.expr(f"(__i + __m - pmod(__i + __m, {permits})) div {permits}")).drop("__i", "__m", "__at", PART)
    rows = numbered(df, order, "__rn").withColumn("__i", F.col("__rn") - 1).withColumn("__j", F.expr(f"__i div {permits}")).withColumn("__class", F.col("__i") % permits)
    rows = running_within(rows, ["__class"], ["__i"], (F.col(arrival) - F.col("__j") * segments).cast("bigint"), "__m", "max")
    return rows.withColumn("release", (F.col("__m") + F.col("__j") * segments).cast("bigint")).drop("__rn", "__i", "__j", "__class", "__m")


def reject_beyond(df: DataFrame, window: str, order: list[str], permits: int, by: list[str] | None = None) -> DataFrame:
    """Adds ``accepted``: a limiter without a queue lets the first ``permits`` items of each window through, per key of ``by``, and rejects the rest.

    Items of one window are numbered over many tasks. A null window is a window of its own.
    """
    if permits <= 0:
        raise ValueError("permits must be positive")
    return numbered_within(df, [*(by or []), window], order, "__rn").withColumn("accepted", F.col("__rn") <= permits).drop("__rn")


def token_bucket(df: DataFrame, tick: str, order: list[str], capacity: int, tokens: int, by: list[str]) -> DataFrame:
    """Adds ``release``: the tick at which each item gets its token. A bucket per key of ``by`` is full at first and gets ``tokens`` each tick, up to ``capacity``.

    ``tick`` is the tick of arrival and doesn't fall in the given order. From arrival j on, the bucket has at most its
    capacity, so item i leaves no sooner than a_j + ceil((i - j + 1 - capacity) / tokens) for each j <= i, and at the
    greatest of these: ceil((i + 1 - capacity + max of (a_j * tokens - j)) / tokens), one running maximum over many tasks.
    """
    if capacity <= 0 or tokens <= 0:
        raise ValueError("capacity and tokens must be positive")
    rows = running(laid_out(df, [*by, *order]), by, F.lit(1).cast("bigint"), "__i")
    rows = running(rows, by, (F.col(tick) * tokens - F.col("__i")).cast("bigint"), "__m", "max")
    # ceil(x / tokens), exact for any bigint
    leaves = F.expr(f"-((-(__i + 1 - {capacity} + __m) - pmod(-(__i + 1 - {capacity} + __m), {tokens})) div {tokens})")
    return rows.withColumn("release", F.greatest(F.col(tick).cast("bigint"), leaves)).drop("__i", "__m", "__at", PART)
