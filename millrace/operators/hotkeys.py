"""Per-key results when a few keys hold most rows (problem 4).

Method: distributed exact selection. A value's rank is found by refining histograms: every task counts its rows
per (key, bin) before anything is shuffled, bins of all tasks add up, and each sought rank narrows to the bin it
falls in, until the bin holds one distinct value. Rows of a hot key are never brought together, and the driver sees
one row per rank sought.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.durable import durable
from millrace.operators.ordered import PART, laid_out

BINS = 1024
#: A key with more than one part in HOT_PARTS of the rows is hot, so there are at most HOT_PARTS hot keys; that bounds what is broadcast.
HOT_PARTS = 200
#: Keys with fewer rows than this are never hot.
HOT_LEAST = 50_000


@dataclass
class _Bracket:
    """The values lo..hi of one key, which hold ``rows`` rows; ranks: those sought, counted within the bracket from 1."""

    key: tuple
    lo: int
    hi: int
    rows: int
    ranks: dict[int, list]


def select_ranks(df: DataFrame, keys: list[str], value: str, brackets: list[_Bracket], bins: int = BINS, least_rows: int = 0) -> list[tuple[tuple, object, int, int]]:
    """Exact order statistics of a few keys: (key, tag, value, rows that have this value) for every rank sought.

    ``value`` is a bigint column without nulls whose greatest difference fits a bigint. A pass narrows every open
    bracket by a factor of ``bins`` and tightens it to the values that occur, so the passes grow as the logarithm
    of the distinct values. A row finds its bracket by hash joins: its key, if there are any, gives the first, bracket and bin give each
    that follows. What is broadcast and collected has a row per key, or per rank sought. Bins of fewer than
    ``least_rows`` rows are left.
    """
    spark = df.sparkSession
    kinds = {f.name: f.dataType for f in df.schema.fields}
    width = lambda b: (b.hi - b.lo) // bins + 1
    cell = F.expr(f"(`{value}` - __lo) div __width")
    place = [T.StructField(n, T.LongType()) for n in ("__b", "__lo", "__width")]
    if keys:
        first = spark.createDataFrame([(*b.key, i, b.lo, width(b)) for i, b in enumerate(brackets)], T.StructType([T.StructField(f"__k{i}", kinds[k]) for i, k in enumerate(keys)] + place))
        met = F.lit(True)
        for i, k in enumerate(keys):
            met = met & (F.col(k) == F.col(f"__k{i}"))
        rows = df.join(F.broadcast(first), met).select(value, "__b", cell.alias("__cell"))
    else:  # one bracket over all rows; its number 0 is written so that the planner doesn't see a constant, over which it can't hash
        (b,) = brackets
        rows = df.select(value, (F.col(value) - F.col(value)).alias("__b"), F.lit(b.lo).cast("bigint").alias("__lo"), F.lit(width(b)).cast("bigint").alias("__width")).select(value, "__b", cell.alias("__cell"))
    done: list[tuple[tuple, object, int, int]] = []
    open_ = dict(enumerate(brackets))
    named = len(brackets)
    while open_:
        sought = spark.createDataFrame([(i, r) for i, b in open_.items() for r in b.ranks], "__b bigint, rank bigint")
        counted = rows.groupBy("__b", "__cell").agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
        counted = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("__b").orderBy("__cell")))  # at most ``bins`` rows a bracket
        hits = counted.join(F.broadcast(sought), "__b").where("rank <= upto and rank > upto - n").collect()
        following: dict[int, _Bracket] = {}
        names: dict[tuple[int, int], int] = {}
        for r in hits:
            b, below = open_[r["__b"]], r["upto"] - r["n"]
            if r["n"] < least_rows:
                continue
            if r["lo"] == r["hi"]:
                done.extend((b.key, tag, r["lo"], r["n"]) for tag in b.ranks[r["rank"]])
                continue
            at = (r["__b"], r["__cell"])
            if at not in names:
                names[at], named = named, named + 1
                following[names[at]] = _Bracket(b.key, r["lo"], r["hi"], r["n"], {})
            following[names[at]].ranks[r["rank"] - below] = b.ranks[r["rank"]]
        open_ = following
        if open_:
            steps = [(*at, i, open_[i].lo, width(open_[i])) for at, i in names.items()]
            table = spark.createDataFrame(steps, T.StructType([T.StructField("__from", T.LongType()), T.StructField("__at", T.LongType()), *place]))
            rows = rows.withColumnRenamed("__b", "__was").join(F.broadcast(table), (F.col("__was") == F.col("__from")) & (F.col("__cell") == F.col("__at"))).select(value, "__b", cell.alias("__cell"))
    return done


def dominating_values(df: DataFrame, column: str, parts: int = 20) -> DataFrame:
    """The values of a string column that stand in at least one part in ``parts`` of all rows: ``key_value``, ``n_rows``, ``n_total``.

    Sorted by a hash, a value with that many rows covers at least one rank that is a multiple of the least such
    number, so at most ``parts`` ranks are selected; the candidates' rows are then counted by the value itself,
    which settles hash collisions. Nulls and empty values are no candidates but count in the total; repeated rows
    count each. An empty table gives no rows.
    """
    rows = df.select(F.col(column).cast("string").alias("key_value"))
    rows = rows.withColumn("h", F.when(F.col("key_value") != "", F.shiftrightunsigned(F.xxhash64("key_value"), 1)))
    stats = rows.agg(F.count(F.lit(1)).alias("total"), F.count("h").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")).first()
    hashed, total = rows.where("h is not null"), stats["total"]
    least = -(-total // parts)
    hashes: list[int] = []
    if stats["n"] and stats["n"] >= least:
        ranks = {r: [r] for r in range(least, stats["n"] + 1, least)}
        found = select_ranks(hashed, [], "h", [_Bracket((), stats["lo"], stats["hi"], stats["n"], ranks)], least_rows=least)
        hashes = sorted({v for _, _, v, _ in found})
    return (
        hashed.where(F.col("h").isin(hashes) if hashes else F.lit(False))
        .groupBy("key_value")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .where(F.col("n_rows") * parts >= total)
        .withColumn("n_total", F.lit(total).cast("bigint"))
    )


def _as_long(df: DataFrame, value: str) -> tuple[Column, Column, str]:
    """An order-keeping bigint of a decimal(<=18) or whole-number column, its inverse of ``__q`` and the type."""
    kind = df.schema[value].dataType
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        text = kind.simpleString()
        scale = kind.scale
        return (F.col(value) * F.lit(10**scale).cast("decimal(19,0)")).cast("bigint"), (F.col("__q").cast("decimal(38,0)") / F.lit(10**scale).cast("decimal(19,0)")).cast(text), text
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.col(value).cast("bigint"), F.col("__q").cast(kind), kind.simpleString()
    raise TypeError(f"exact selection is over decimals of up to 18 digits and whole numbers, not {kind.simpleString()}")


def key_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """Row count, number of values, total, least and greatest value per key, counted in each task before the shuffle.

    A null or empty key is a key of its own, given as it is. A hot key costs its reducer one row per task.
    """
    return df.groupBy(F.col(key).alias("key_value")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(value).alias("n_values"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("greatest")
    )


def _sorted_ranks(rows: DataFrame, probs: list[float]) -> DataFrame:
    """(key_value, prob, __q, n_values) from a sort over all partitions: a key may span several, none is gathered."""
    laid = laid_out(rows, ["key_value", "v"])
    pieces = laid.groupBy(PART, "key_value").agg(F.min("__at").alias("first"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("key_value")  # as many rows as the key has partitions
    pieces = pieces.withColumn("n_values", F.sum("n").over(w)).withColumn("before", F.sum("n").over(w.orderBy(PART)) - F.col("n"))
    wanted = pieces.withColumn("prob", F.explode(F.array(*(F.lit(float(p)) for p in probs)))).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("prob") * F.col("n_values"))))
    wanted = wanted.where("rank > before and rank <= before + n").select(PART, (F.col("first") + F.col("rank") - F.col("before") - 1).alias("__at"), "prob", "n_values")
    return laid.join(wanted, [PART, "__at"]).select("key_value", "prob", F.col("v").alias("__q"), "n_values")


def key_quantiles(df: DataFrame, key: str, value: str, probs: list[float], hot_least: int = HOT_LEAST, hot_parts: int = HOT_PARTS) -> DataFrame:
    """Exact quantiles per key: ``key_value``, ``prob``, ``quantile``, ``n_values``; the value of rank ceil(prob * n), at least 1.

    Keys of more rows than both ``hot_least`` and one part in ``hot_parts`` of the table go through rank selection
    and are at most ``hot_parts``. The other keys' rows are sorted over all partitions and the ranks read off there.
    Rows with a null key or value don't count, repeated rows count each, ties count each. An empty table gives no rows.
    """
    spark = df.sparkSession
    to_long, back, kind = _as_long(df, value)
    rows = df.select(F.col(key).cast("string").alias("key_value"), to_long.alias("v")).dropna()
    per_key = rows.groupBy("key_value").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    per_key = durable(per_key)
    bound = max(hot_least, (per_key.agg(F.sum("n")).first()[0] or 0) // hot_parts)
    hot = per_key.where(F.col("n") > bound).collect()  # at most hot_parts rows
    names = [r["key_value"] for r in hot]
    rank = lambda p, n: max(1, -int(-p * n // 1))

    brackets = []
    for r in hot:
        ranks: dict[int, list] = {}
        for p in probs:
            ranks.setdefault(rank(p, r["n"]), []).append((p, r["n"]))
        brackets.append(_Bracket((r["key_value"],), r["lo"], r["hi"], r["n"], ranks))
    chosen = select_ranks(rows.where(F.col("key_value").isin(names)), ["key_value"], "v", brackets) if hot else []
    of_hot = spark.createDataFrame([(k[0], p, v, n) for k, (p, n), v, _ in chosen], "key_value string, prob double, __q bigint, n_values bigint")

    cold = rows.where(~F.col("key_value").isin(names)) if names else rows
    of_cold = _sorted_ranks(cold, probs)
    return of_hot.unionByName(of_cold).select("key_value", "prob", back.alias("quantile"), "n_values")
