"""Irregular readings onto a regular grid of slots (problem 5).

Method: an as-of merge of the sorted grid and the readings of each source. Readings fold to one row per occupied
slot (on the map side first), are sorted by range on (source, slot), and every occupied slot gets its neighbour
before it, carried over partition borders by one summary row per partition. The slots between two neighbours are
then made on the JVM side, filled by linear interpolation over time, or marked where the gap is over the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import PART, part_summaries, range_sorted

#: Slots made from one row at a time; longer gaps are first cut into blocks of this many slots.
BLOCK = 4096


def occupied_slots(df: DataFrame, keys: list[str], ts_us: str, value: str, step_us: int) -> DataFrame:
    """One row per source and slot that has a reading: ``slot_us``, the number of readings, the first and last (time, value)."""
    reading = F.struct(F.col("__t"), F.col("__v"))
    rows = df.select(*keys, F.col(ts_us).cast("bigint").alias("__t"), F.col(value).cast("double").alias("__v")).dropna()
    slot = F.col("__t") - F.pmod(F.col("__t"), F.lit(step_us))
    return rows.groupBy(*keys, slot.alias("slot_us")).agg(F.count(F.lit(1)).alias("n"), F.min(reading).alias("first"), F.max(reading).alias("last"))


def regular_grid(df: DataFrame, keys: list[str], ts_us: str, value: str, step_us: int, gap_limit_us: int) -> DataFrame:
    """A row for each slot from the first to the last occupied one of each source.

    Columns: ``keys``, ``slot_us``, ``n_readings`` (repeated deliveries counted), ``value``, ``status``.
    status 'observed': value is the slot's last reading (the greatest value of those at one time);
    'interpolated': no reading, value lies on the line between the last reading before and the first after, taken
    at the slot's start; 'gap': the same, but those readings are more than ``gap_limit_us`` apart, value is null.
    Slots start at whole multiples of ``step_us``. A row with a null or NaN in keys, time or value is no
    reading. An empty table gives no rows; a source with one occupied slot gives one row.
    ``keys`` must be strings or whole numbers. Other columns are ignored, whatever their names.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    base = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col(ts_us).alias("__time"), F.col(value).alias("__value"))
    slots = occupied_slots(base, names, "__time", "__value", step_us)
    slots = slots.select(*names, "slot_us", "n", F.col("first.__t").alias("first_t"), F.col("first.__v").alias("first_v"), F.col("last.__t").alias("last_t"), F.col("last.__v").alias("last_v"))
    types = dict(slots.dtypes)
    slots = range_sorted(slots, [*names, "slot_us"])
    edge = F.struct("slot_us", "last_t", "last_v")
    carry: dict[int, tuple] = {}
    now = None
    for r in part_summaries(slots, first=F.min(F.struct(*names)), last=F.max(F.struct(*names, edge.alias("edge")))):
        if now and now[0] == tuple(r["first"]):
            carry[r[PART]] = now
        now = (tuple(r["last"])[:-1], tuple(r["last"]["edge"]))

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entity, edge, started = None, None, False
        for pdf in batches:
            n = len(pdf)
            if not n:
                continue
            if not started:
                entity, edge = carry.get(int(pdf[PART].iloc[0]), (None, None))
                started = True
            cols = [pdf[k].to_numpy() for k in names]
            same = np.ones(n, bool)
            for c in cols:
                same[1:] &= c[1:] == c[:-1]
            same[0] = entity is not None and entity == tuple(c[0] for c in cols)
            for src, dst, carried in zip(("slot_us", "last_t", "last_v"), ("p_slot", "p_t", "p_v"), edge or (0, 0, 0.0)):
                before = np.empty_like(pdf[src].to_numpy())
                before[1:] = pdf[src].to_numpy()[:-1]
                before[0] = carried
                pdf[dst] = before
            pdf["has_p"] = same
            entity = tuple(c[-1] for c in cols)
            edge = tuple(pdf[c].iloc[-1].item() for c in ("slot_us", "last_t", "last_v"))
            yield pdf[[*names, "slot_us", "n", "first_t", "first_v", "last_v", "p_slot", "p_t", "p_v", "has_p"]]

    schema = ", ".join([*(f"{k} {types[k]}" for k in names), "slot_us bigint, n bigint, first_t bigint, first_v double, last_v double, p_slot bigint, p_t bigint, p_v double, has_p boolean"])
    rows = slots.mapInPandas(pairs, schema)
    step, block = F.lit(step_us), F.lit(step_us * BLOCK)
    first_slot = F.when(F.col("has_p"), F.col("p_slot") + step).otherwise(F.col("slot_us"))
    rows = rows.withColumn("from", F.explode(F.sequence(first_slot, F.col("slot_us"), block)))
    rows = rows.withColumn("at", F.explode(F.sequence("from", F.least(F.col("slot_us"), F.col("from") + block - step), step)))
    seen = F.col("at") == F.col("slot_us")
    near = (F.col("first_t") - F.col("p_t")) <= gap_limit_us
    line = F.col("p_v") + (F.col("first_v") - F.col("p_v")) * (F.col("at") - F.col("p_t")) / (F.col("first_t") - F.col("p_t"))
    return rows.select(
        *(F.col(n).alias(k) for n, k in zip(names, keys)),
        F.col("at").alias("slot_us"),
        F.when(seen, F.col("n")).otherwise(F.lit(0)).cast("bigint").alias("n_readings"),
        F.when(seen, F.col("last_v")).when(near, line).alias("value"),
        F.when(seen, "observed").when(near, "interpolated").otherwise("gap").alias("status"),
    )
