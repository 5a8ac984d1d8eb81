"""Continuous periods and gaps of overlapping intervals, per entity (problem 1).

Method: sort all intervals by range on (entity, start), so a hot entity spans several partitions; take of each
partition the greatest end of its last entity; combine those summaries by prefix on the driver; scan the
partitions again with the carried state. The second summary (start of the island that is open at a partition's
end) is combined the same way, so that the last scan emits every period and gap once, without another shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import PART, part_summaries, range_sorted


class _Scan:
    """The state of a scan over sorted intervals: the entity, its greatest end so far, the start of its open island."""

    def __init__(self, keys: list[str], carry: tuple | None):
        self.keys = keys
        self.entity, self.high, self.island = carry if carry else (None, None, None)

    def step(self, pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """The periods closed and the gaps found by the rows of ``pdf``."""
        n = len(pdf)
        cols = [pdf[k].to_numpy() for k in self.keys]
        start, end = pdf["__start"].to_numpy(np.int64), pdf["__end"].to_numpy(np.int64)
        fresh = np.zeros(n, bool)
        for c in cols:
            fresh[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        goes_on = self.entity is not None and self.entity == first
        fresh[0] = not goes_on
        group = np.cumsum(fresh)
        high = pd.Series(end).groupby(group).cummax().to_numpy().copy()
        if goes_on:
            own = group == 0
            high[own] = np.maximum(high[own], self.high)
        before = np.empty(n, np.int64)
        before[1:] = high[:-1]
        before[0] = self.high if goes_on else 0
        opens = fresh | (start > before)
        at = np.flatnonzero(opens)

        # a period closes where the next one opens; the one open at the batch's start comes from the state
        closed = {k: [] for k in self.keys}
        starts: list = []
        ends: list = []
        if len(at):
            last_rows = at[1:] - 1  # the last row of each island that opens and closes in this batch
            for k, c in zip(self.keys, cols):
                closed[k].append(c[last_rows])
            starts.append(start[at[:-1]])
            ends.append(high[last_rows])
            if self.entity is not None:
                i = at[0]
                for k, v in zip(self.keys, self.entity):
                    closed[k].append(np.array([v], dtype=object))
                starts.append(np.array([self.island or 0]))  # the first scan doesn't know it yet, and drops the periods
                ends.append(np.array([high[i - 1] if i else self.high]))
        periods = pd.DataFrame({k: np.concatenate(v) if v else [] for k, v in closed.items()})
        periods["start"] = np.concatenate(starts).astype(np.int64) if starts else np.array([], np.int64)
        periods["end"] = np.concatenate(ends).astype(np.int64) if ends else np.array([], np.int64)

        holes = np.flatnonzero(opens & ~fresh)
        gaps = pd.DataFrame({k: c[holes] for k, c in zip(self.keys, cols)})
        gaps["start"], gaps["end"] = before[holes], start[holes]

        self.entity, self.high = tuple(c[-1] for c in cols), int(high[-1])
        if len(at):
            self.island = int(start[at[-1]])
        return periods, gaps

    def open_period(self) -> pd.DataFrame:
        return pd.DataFrame({**{k: [v] for k, v in zip(self.keys, self.entity)}, "start": [self.island], "end": [self.high]})


def _tag(frame: pd.DataFrame, kind: str) -> pd.DataFrame:
    frame["span_kind"] = kind
    return frame


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Periods and gaps of each entity: columns ``keys``, ``span_kind`` ('period' or 'gap'), ``start_us``, ``end_us``.

    ``start`` and ``end`` are bigint columns. Intervals that overlap or touch make one period. A row with a null
    in a key, in start or in end, or that ends before it starts, doesn't count; an interval of no length does.
    Repeated rows change nothing. An empty table gives no rows. Other columns of ``df`` are ignored, whatever
    their names.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col(start).cast("bigint").alias("__start"), F.col(end).cast("bigint").alias("__end"))
    for n in names:
        rows = rows.where(F.col(n).isNotNull())
    # Of equal starts only the greatest end matters: copies of an interval fold together before any row moves.
    rows = rows.where("__end >= __start").groupBy(*names, "__start").agg(F.max("__end").alias("__end"))
    types = dict(rows.dtypes)
    rows = range_sorted(rows, [*names, "__start"])

    ends = part_summaries(rows, first=F.min(F.struct(*names)), last=F.max(F.struct(*names, "__end")))
    carry: dict[int, tuple] = {}
    closes: dict[int, bool] = {}
    now: tuple | None = None
    for i, r in enumerate(ends):
        first, last, high = tuple(r["first"]), tuple(r["last"])[:-1], r["last"]["__end"]
        if now and now[0] == first:
            carry[r[PART]] = now
        now = (last, max(high, now[1])) if now and now[0] == last else (last, high)
        closes[r[PART]] = i + 1 == len(ends) or tuple(ends[i + 1]["first"]) != last

    def open_islands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan, part = None, None
        for pdf in batches:
            if len(pdf):
                if scan is None:
                    part = int(pdf[PART].iloc[0])
                    scan = _Scan(names, (*carry[part], None) if part in carry else None)
                scan.step(pdf)
        if scan is not None:
            yield pd.DataFrame({PART: [part], "island": pd.array([scan.island], dtype="Int64")})

    islands = {r[PART]: r["island"] for r in rows.mapInPandas(open_islands, f"{PART} int, island bigint").collect()} if carry else {}
    opened = None
    for r in ends:
        if r[PART] in carry:
            carry[r[PART]] = (*carry[r[PART]], opened)
        if islands.get(r[PART]) is not None:
            opened = islands[r[PART]]

    carried = df.sparkSession.sparkContext.broadcast((carry, closes))  # an entry per partition: sent once to each executor, not with each task

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (carry, closes), scan, part = carried.value, None, None
        for pdf in batches:
            if len(pdf):
                if scan is None:
                    part = int(pdf[PART].iloc[0])
                    scan = _Scan(names, carry.get(part))
                periods, gaps = scan.step(pdf)
                yield from (_tag(frame, kind) for frame, kind in ((periods, "period"), (gaps, "gap")) if len(frame))
        if scan is not None and closes[part]:
            yield _tag(scan.open_period(), "period")

    schema = ", ".join([*(f"{n} {types[n]}" for n in names), "start bigint", "end bigint", "span_kind string"])
    out = rows.mapInPandas(spans, schema)
    return out.select(*(F.col(n).alias(k) for n, k in zip(names, keys)), "span_kind", F.col("start").alias("start_us"), F.col("end").alias("end_us"))
