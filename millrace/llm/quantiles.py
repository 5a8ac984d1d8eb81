"""Percentiles with a rank error bound that can be combined over partitions, days and files (problem 3).

Method: deterministic rank-interval summaries. A summary of n values is a sorted list of (value, least rank,
greatest rank). Every partition makes one per group and compresses it by the uncertainty permitted to it;
summaries then merge in levels, and each carries its level: a level may use up a share of the error of its own, so that
there is always some left for the next. Merging adds rank intervals; after every step the error is read off the
intervals themselves (half the widest step between neighbours of different value), so what is reported is proven.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMMARY = "level int, n bigint, value array<double>, least array<double>, greatest array<double>"
_PARTS = ["level", "n", "value", "least", "greatest"]
#: Summaries of a group that one task merges on the first level.
FAN_IN = 64
#: Summaries that a task hands on at a time.
AT_ONCE = 2_000
#: The share of the error that a partition's summary may use up, and how fast the levels above use up the rest.
LEAF_SHARE, LEVELS = 0.25, 4


def permitted(error: float, level: int) -> float:
    """The error that a summary of this level may have: it rises with the level and never reaches ``error``.

    A level's own share is error * 3 / ((level + 3) * (level + 4)), so a summary of level k has about
    (k + 3) * (k + 4) / (6 * error) tuples at most: ever more slowly growing, not with what is combined.
    """
    return error * (LEAF_SHARE + (1 - LEAF_SHARE) * (1 - LEVELS / (LEVELS + level)))


class RankSummary:
    """Some of n values in order, each with the least and greatest rank that it may have among all n."""

    __slots__ = ("greatest", "least", "n", "value")

    def __init__(self, n: int, value: np.ndarray, least: np.ndarray, greatest: np.ndarray):
        self.n, self.value, self.least, self.greatest = n, value, least, greatest

    @classmethod
    def of(cls, values: np.ndarray) -> RankSummary:
        """Exact: every distinct value by the first and the last rank of its ties."""
        distinct, counts = np.unique(values, return_counts=True)
        last = np.cumsum(counts).astype(float)
        rank = np.column_stack([last - counts + 1, last]).ravel()
        keep = np.ones(len(rank), bool)
        keep[1::2] = counts > 1
        return cls(len(values), np.repeat(distinct, 2)[keep], rank[keep], rank[keep].copy())

    @classmethod
    def of_sorted(cls, values: np.ndarray, before: int = 0) -> RankSummary:
        """``of`` for values in order, of which the first has the rank ``before`` + 1."""
        n = len(values)
        if n == 1:
            return cls(1, values, np.array([before + 1.0]), np.array([before + 1.0]))
        edge = values[1:] != values[:-1]
        keep = np.concatenate([[True], edge]) | np.concatenate([edge, [True]])  # first and last of each run of ties
        rank = np.flatnonzero(keep) + (before + 1.0)
        return cls(n, values[keep], rank, rank.copy())

    @property
    def error(self) -> float:
        """The share of n by which the rank of any quantile read from this summary may at most be off."""
        if len(self.value) < 2:
            return 0.0
        step = (self.greatest[1:] - self.least[:-1])[self.value[1:] != self.value[:-1]]
        return float(step.max(initial=0)) // 2 / self.n  # ranks are whole: in the middle of a step of 2 k one is off by k

    def merge(self, other: RankSummary) -> RankSummary:
        """The summary of both; its error is at most the larger of theirs."""

        def shifted(a: RankSummary, b: RankSummary, side: str) -> tuple[np.ndarray, np.ndarray]:
            at = np.searchsorted(b.value, a.value, side)  # `side` settles ties one way: self before other
            below = np.where(at > 0, b.least[np.maximum(at - 1, 0)], 0)
            above = np.where(at < len(b.value), b.greatest[np.minimum(at, len(b.value) - 1)] - 1, b.n)
            return a.least + below, a.greatest + above

        parts = shifted(self, other, "left"), shifted(other, self, "right")
        value = np.concatenate([self.value, other.value])
        order = np.argsort(value, kind="stable")
        least, greatest = (np.concatenate(x)[order] for x in zip(*parts))
        return RankSummary(self.n + other.n, value[order], least, np.maximum.accumulate(greatest))

    def compress(self, error: float) -> RankSummary:
        """As few tuples as an error of ``error`` permits, about 1 / error; the least and the greatest value stay."""
        last = len(self.value) - 1
        kept, i, room = [0], 0, 2 * error * self.n
        while i < last:
            i = min(last, max(i + 1, int(np.searchsorted(self.greatest, self.least[i] + room, "right")) - 1))
            kept.append(i)
        return RankSummary(self.n, self.value[kept], self.least[kept], self.greatest[kept])

    def quantile(self, probs: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """The values at ranks ceil(prob * n), at least 1, and by how many ranks each may be off, as its own interval shows.

        A value's first rank is at most ``first``, its last rank at least ``last``: of tied tuples, the first and the last one bound it.
        """
        ranks = np.maximum(1, np.ceil(np.array(probs) * self.n))
        edge = self.value[1:] != self.value[:-1]
        first, last = self.greatest[np.concatenate([[True], edge])], self.least[np.concatenate([edge, [True]])]
        value = self.value[np.concatenate([[True], edge])]
        high = np.clip(np.searchsorted(first + last, 2 * ranks), 0, len(value) - 1)
        low = np.maximum(high - 1, 0)
        off = lambda i: np.maximum(0, np.maximum(first[i] - ranks, ranks - last[i]))
        at = np.where(off(low) <= off(high), low, high)
        return value[at], off(at)


def merge_all(parts: list[RankSummary]) -> RankSummary:
    """Pairwise, so that each tuple is merged a logarithmic number of times."""
    while len(parts) > 1:
        parts = [a.merge(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) & ~1 :]
    return parts[0]


def _rows_out(names: list[str], found: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    rows = []
    for row in found:
        rows.append(row)
        if len(rows) == AT_ONCE:
            yield pd.DataFrame(rows, columns=names)
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=names)


def _leaves(names: list[str], error: float):
    """The scan of one partition, sorted by group and value: the task holds the tuples of one group, and these are thinned as they come."""
    share, most = permitted(error, 0), int(8 / error) + 64

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        now, part, have = None, -1, None
        for pdf in batches:
            if not len(pdf):
                continue
            keys, values = [pdf[n].to_numpy() for n in names], pdf["v"].to_numpy(np.float64)
            part = int(pdf["part"].iloc[0])
            fresh = np.zeros(len(pdf), bool)
            fresh[0] = True
            for k in keys:
                fresh[1:] |= k[1:] != k[:-1]
            at = np.flatnonzero(fresh)
            for lo, hi in zip(at, np.append(at[1:], len(pdf))):
                key, more = tuple(k[lo] for k in keys), values[lo:hi]
                if key == now:
                    # ranks are exact, so tuples can be left without the error of those left before adding up
                    s = RankSummary.of_sorted(more, have.n)
                    have = RankSummary(have.n + s.n, np.concatenate([have.value, s.value]), np.concatenate([have.least, s.least]), np.concatenate([have.greatest, s.greatest]))
                else:
                    if now is not None:
                        s = have.compress(share)
                        yield (*now, part, 0, s.n, s.value, s.least, s.greatest)
                    now, have = key, RankSummary.of_sorted(more)
                if len(have.value) > most:
                    have = have.compress(share)
        if now is not None:
            s = have.compress(share)
            yield (*now, part, 0, s.n, s.value, s.least, s.greatest)

    return lambda batches: _rows_out([*names, "part", *_PARTS], scan(batches))


def merged_level(parts: list[RankSummary], levels: list[int], error: float) -> tuple[RankSummary, int]:
    """Summaries of any levels as one of the next; a single one stays as it is."""
    if len(parts) == 1:
        return parts[0], levels[0]
    level = max(levels) + 1
    return merge_all(parts).compress(permitted(error, level)), level


def _merged(rows: DataFrame, by: list[str], names: list[str], error: float) -> DataFrame:
    """The summaries of equal ``by`` merged into one. Rows come sorted, so a task holds the summaries of one group at a time."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        now, parts, levels = None, [], []

        def done() -> tuple:
            s, level = merged_level(parts, levels, error)
            return (*now[: len(names)], level, s.n, s.value, s.least, s.greatest)

        for pdf in batches:
            for row in pdf.itertuples(index=False, name=None):
                key, (level, n, *arrays) = row[: len(by)], row[len(by) :]
                if key != now:
                    if parts:
                        yield done()
                    now, parts, levels = key, [], []
                parts.append(RankSummary(int(n), *map(np.asarray, arrays)))
                levels.append(int(level))
        if parts:
            yield done()

    strings = ", ".join(f"{n} string" for n in names)
    run = lambda batches: _rows_out([*names, *_PARTS], scan(batches))
    return rows.select(*by, *_PARTS).repartition(*by).sortWithinPartitions(*by).mapInPandas(run, f"{strings}, {SUMMARY}")


def summarize(df: DataFrame, group: list[str], value: str, error: float = 0.01) -> DataFrame:
    """One summary per group (columns ``group`` as strings, ``SUMMARY``), of a rank error below ``error``, with room left for ``combine``.

    Rows with a null in ``group`` and null, NaN and infinite values don't count; ties and repeated rows count each.
    An empty table gives no rows. Each partition is sorted by group and value where it lies, so that its task holds one
    group's tuples, however many groups and rows there are. Partition summaries merge by FAN_IN, then per group; a hot
    group costs one summary per partition, whatever its rows. Other columns are ignored. Keep the rows of a day or file
    and give them to ``combine`` with those of others.
    """
    names = [f"__g{i}" for i in range(len(group))]
    rows = df.select(*(F.col(g).cast("string").alias(n) for g, n in zip(group, names)), F.col(value).cast("double").alias("v")).dropna()
    rows = rows.where(F.abs("v") < F.lit(float("inf"))).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*names, "v")
    strings = ", ".join(f"{n} string" for n in names)
    leaves = rows.mapInPandas(_leaves(names, error), f"{strings}, part int, {SUMMARY}")
    first = _merged(leaves.withColumn("__bundle", F.floor(F.col("part") / FAN_IN)), [*names, "__bundle"], names, error)
    whole = _merged(first, names, names, error)
    return whole.select(*(F.col(n).alias(g) for n, g in zip(names, group)), *_PARTS)


def combine(summaries: DataFrame, group: list[str], error: float = 0.01) -> DataFrame:
    """The summaries of days, files or clusters, made or combined before with the same ``error``, merged per group. The rank error stays below ``error``, however often results are combined again."""
    names = [f"__g{i}" for i in range(len(group))]
    rows = summaries.select(*(F.col(g).alias(n) for g, n in zip(group, names)), *_PARTS)
    rows = rows.withColumn("__bundle", F.pmod(F.xxhash64("n", "value"), F.lit(FAN_IN)))
    whole = _merged(_merged(rows, [*names, "__bundle"], names, error), names, names, error)
    return whole.select(*(F.col(n).alias(g) for n, g in zip(names, group)), *_PARTS)


def read_quantiles(summaries: DataFrame, group: list[str], probs: list[float]) -> DataFrame:
    """Of each summary the quantiles: ``group``, ``prob``, ``value``, ``n_values``, ``off_ranks`` (proven for this value), ``rank_error`` (proven for any, as a share of n)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for *key, _, n, value, least, greatest in pdf[[*group, *_PARTS]].itertuples(index=False, name=None):
                s = RankSummary(int(n), np.asarray(value), np.asarray(least), np.asarray(greatest))
                for p, v, off in zip(probs, *s.quantile(probs)):
                    out.append((*key, float(p), float(v), int(n), int(off), s.error))
            if out:
                yield pd.DataFrame(out, columns=[*group, "prob", "value", "n_values", "off_ranks", "rank_error"])

    strings = ", ".join(f"`{g}` string" for g in group)
    return summaries.mapInPandas(run, f"{strings}, prob double, value double, n_values bigint, off_ranks bigint, rank_error double")
