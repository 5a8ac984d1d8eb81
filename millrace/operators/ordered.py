"""A global sort whose partitions know what came before them.

``range_sorted`` sorts rows over the whole cluster by range, so that one entity with any number of rows is
spread over as many partitions as it needs. What a row-by-row scan has to know at the start of a partition is
worked out from one summary row per partition; the driver sees those summaries only, never rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.durable import durable, shuffle_partitions

PART = "__part"


def range_sorted(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` sorted by ``keys`` over all partitions, kept, with the partition's number in the column ``__part``.

    The number is stored with the row: a later union or retry doesn't change it.
    """
    n = shuffle_partitions(df.sparkSession)
    return durable(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn(PART, F.spark_partition_id()))


def part_summaries(df: DataFrame, **aggs: Column) -> list:
    """One row per non-empty partition, in order. Its size is bounded by the number of shuffle partitions."""
    rows = df.groupBy(PART).agg(*(c.alias(n) for n, c in aggs.items())).collect()
    return sorted(rows, key=lambda r: r[PART])


def offsets(rows: list, count: str) -> list[tuple[int, int]]:
    """(partition, what the partitions before it hold) from summaries."""
    out, total = [], 0
    for r in rows:
        out.append((r[PART], total))
        total += r[count] or 0
    return out


def _with_offsets(df: DataFrame, before: list[tuple[int, int]], name: str) -> DataFrame:
    """``df`` with its partition's offset; the list has one entry per partition and is broadcast."""
    small = df.sparkSession.createDataFrame(before, f"{PART} int, `{name}` bigint")
    return df.join(F.broadcast(small), PART)


def laid_out(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` sorted over all partitions and kept, with the partition (``__part``) and the row's place in it (``__at``)."""
    # within a partition the id's low 33 bits count the rows in their sorted order
    rows = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    return durable(rows.withColumn(PART, F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))


def numbered(df: DataFrame, order: list[str], name: str = "rn") -> DataFrame:
    """``df`` with row numbers from 1 in the given order, without bringing all rows to one task.

    The order must tell all rows apart for the numbers to be the same each time. Nulls come first.
    """
    rows = laid_out(df, order)
    before = offsets(part_summaries(rows, n=F.count(F.lit(1))), "n")
    return _with_offsets(rows, before, "__before").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__before", "__at", PART)


def with_previous(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """``df`` laid out in the given order with ``__prev``, a struct of the row before's ``columns``, null for the very first row.

    The last row of each partition reaches the driver and is handed to the partition after it.
    """
    rows = laid_out(df, order)
    kinds = [T.StructField(c, rows.schema[c].dataType) for c in columns]
    now, before = None, []
    for r in part_summaries(rows, last=F.max_by(F.struct(*columns), "__at")):
        before.append((r[PART], now))
        now = r["last"]
    small = df.sparkSession.createDataFrame(before, T.StructType([T.StructField(PART, T.IntegerType()), T.StructField("__carry", T.StructType(kinds))]))
    w = Window.partitionBy(PART).orderBy("__at")  # as many groups as partitions, all of like size
    joined = rows.join(F.broadcast(small), PART)
    return joined.withColumn("__prev", F.when(F.col("__at") == 0, F.col("__carry")).otherwise(F.lag(F.struct(*columns)).over(w))).drop("__carry")


def count_up(rows: DataFrame, flag: Column, name: str) -> DataFrame:
    """Laid-out rows with the number of rows up to each, itself included, for which ``flag`` is true."""
    rows = rows.withColumn("__flag", F.coalesce(flag.cast("bigint"), F.lit(0)))
    before = offsets(part_summaries(rows, n=F.sum("__flag")), "n")
    running = F.sum("__flag").over(Window.partitionBy(PART).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    return _with_offsets(rows, before, "__before").withColumn(name, F.col("__before") + running).drop("__before", "__flag")


def segmented(df: DataFrame, key: str, order: list[str], name: str = "epoch_seq") -> DataFrame:
    """``df`` with the number, from 1, of its contiguous run of equal keys in the given order; null equals null. Runs are numbered over all partitions."""
    rows = with_previous(df, [key], order)
    change = F.col("__prev").isNull() | ~F.col(key).eqNullSafe(F.col("__prev")[key])
    return count_up(rows, change, name).drop("__at", "__prev", PART)


def last_known(df: DataFrame, value: str, order: list[str], name: str) -> DataFrame:
    """``df`` with the last non-null ``value`` at or before each row in the given order, carried over partition borders."""
    rows = laid_out(df, order)
    kind = rows.schema[value].dataType
    now, before = None, []
    for r in part_summaries(rows, last=F.max_by(value, F.when(F.col(value).isNotNull(), F.col("__at")))):
        before.append((r[PART], now))
        now = r["last"] if r["last"] is not None else now
    schema = T.StructType([T.StructField(PART, T.IntegerType()), T.StructField("__carry", kind)])
    w = Window.partitionBy(PART).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(F.broadcast(df.sparkSession.createDataFrame(before, schema)), PART)
    return joined.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(w), F.col("__carry"))).drop(PART, "__at", "__carry")


def running(rows: DataFrame, keys: list[str], value: Column, name: str, how: str = "sum") -> DataFrame:
    """Rows laid out by ``keys`` and an order, with the sum (or "max", "min") of ``value`` over the rows of the key up to each row, itself included.

    A key's rows may fill many partitions: each partition's rows are worked through by themselves, and its first key is handed
    what the partitions before hold of it. Null keys equal each other; a null value changes nothing. ``PART`` and ``__at`` stay.
    """
    agg = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    put = {"sum": lambda a, b: a + b, "max": max, "min": min}[how]
    rows = rows.withColumn("__v", value)
    pieces = rows.groupBy(PART, *keys).agg(F.min("__at").alias("__first"), agg("__v").alias("__held"))
    key = F.struct(*keys) if keys else F.lit(0)
    ends = pieces.groupBy(PART).agg(F.min_by(key, "__first").alias("head"), F.max_by(F.struct(key.alias("k"), F.col("__held").alias("v")), "__first").alias("tail"), F.count(F.lit(1)).alias("n")).collect()
    before, last, held = [], None, None
    for i, r in enumerate(sorted(ends, key=lambda r: r[PART])):
        carry = held if i and r["head"] == last else None
        before.append((r[PART], carry))
        own = r["tail"]["v"]
        held = own if r["n"] > 1 or carry is None else carry if own is None else put(carry, own)
        last = r["tail"]["k"]
    kind = pieces.schema["__held"].dataType
    small = rows.sparkSession.createDataFrame(before, T.StructType([T.StructField(PART, T.IntegerType()), T.StructField("__carry", kind)]))
    group = Window.partitionBy(PART, *keys)
    upto = agg("__v").over(group.orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    carry = F.when(F.min("__at").over(group) == 0, F.col("__carry"))
    both = F.coalesce(upto, F.lit(0)) + F.coalesce(carry, F.lit(0)) if how == "sum" else (F.greatest if how == "max" else F.least)(upto, carry)
    return rows.join(F.broadcast(small), PART).withColumn(name, both.cast(kind)).drop("__v", "__carry")


def running_within(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, how: str = "sum") -> DataFrame:
    """``df`` with the running sum, maximum or minimum of ``value`` within each key in the given order."""
    return running(laid_out(df, [*keys, *order]), keys, value, name, how).drop(PART, "__at")


def running_max(df: DataFrame, value: str, order: list[str], lane: str, name: str) -> DataFrame:
    """``df`` with the greatest ``value`` of the row's lane up to the row, also where one lane holds all rows. Null lanes equal each other; a null value changes nothing."""
    return running_within(df, [lane], order, F.col(value), name, "max")


def numbered_within(df: DataFrame, keys: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """``df`` with row numbers from 1 within each key, also where one key holds all rows. The order must tell a key's rows apart for the numbers to be the same each time."""
    return running_within(df, keys, order, F.lit(1).cast("bigint"), name)
