"""Content-based routing: static, selective, dynamic with a limit, tagged, merged, expiring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.durable import durable, shuffle_partitions
from millrace.operators.joins import salted_join
from millrace.operators.ordered import count_up, with_previous
from millrace.operators.topology import fan_in


def route_static(df: DataFrame, key: Column, routes: list[str]) -> DataFrame:
    """Adds ``route``; a key that is no route fails the query and names the routes there are."""
    if not routes:
        raise ValueError("at least one route is needed")
    known = ", ".join(routes)
    return df.withColumn("route", F.when(key.isin(*routes), key).otherwise(F.raise_error(F.concat(F.lit("no route "), F.coalesce(key.cast("string"), F.lit("null")), F.lit(f"; routes: {known}")))))


def tag_and_filter(df: DataFrame, key: Column, routes: list[str]) -> DataFrame:
    """Adds ``route`` and keeps the rows of the given routes; other rows vanish."""
    return df.withColumn("route", key).where(F.col("route").isin(*routes))


def route_dynamic(df: DataFrame, key: Column, most: int | None = None, settings: DataFrame | None = None, template: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Every key's rows through a flow of their own, made on first sight of the key from one template. Adds ``route``; more than ``most`` distinct keys fail.

    ``settings``: what a route is made with, a row per key in the column ``route``; a key that has none, and a null key,
    fail the query. ``template``: the flow of one route, written once for all: it gets the rows of all routes with ``route`` and
    their settings, and keeps them apart by ``route`` (``ordered.numbered_within`` and its kind, grouping, windows), so
    that any number of routes is one pass over the rows, and a hot route is many tasks.
    """
    rows = df.withColumn("route", key)
    if most is not None:
        seen = rows.select("route").where("route is not null").distinct().limit(most + 1).count()
        if seen > most:
            raise ValueError(f"more than {most} dynamic routes")
    if settings is not None:
        made = settings.withColumn("__made", F.lit(True))
        rows = salted_join(rows, made, ["route"])
        missing = F.raise_error(F.concat(F.lit("no settings for route "), F.coalesce(F.col("route").cast("string"), F.lit("null"))))
        rows = rows.withColumn("route", F.when(F.col("__made"), F.col("route")).otherwise(missing)).drop("__made")
    return template(rows) if template else rows


def merge_routes(df: DataFrame, routes: dict[str, Callable[[DataFrame], DataFrame]], route: str = "route", keep: bool = False) -> DataFrame:
    """Each route's rows through its own blocks, the results in one frame. A row whose route has no blocks, or is null, fails the query.

    ``keep``: the rows are computed once and kept for all branches; without it each branch works out its own rows,
    which for few branches over a scan is cheaper.
    """
    known = ", ".join(routes)
    unknown = F.raise_error(F.concat(F.lit("no route "), F.coalesce(F.col(route).cast("string"), F.lit("null")), F.lit(f"; routes: {known}")))
    rows = df.withColumn(route, F.when(F.col(route).isin(*routes), F.col(route)).otherwise(unknown))
    rows = durable(rows) if keep else rows
    return fan_in(*(f(rows.where(F.col(route) == name)) for name, f in routes.items()))


def expiring_sessions(df: DataFrame, key: str, ts: str, expiry_us: int) -> DataFrame:
    """(key, session_no, n, first_us, last_us): a route lives while its key's items come at most ``expiry_us`` apart, and is made anew after."""
    rows = df.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("__t"))
    rows = with_previous(rows, [key, "__t"], [key, "__t"])
    # a key's rows may lie in several partitions: a session is told by the row before, wherever that is
    fresh = F.col("__prev").isNull() | ~F.col(key).eqNullSafe(F.col("__prev")[key]) | F.coalesce(F.col("__t") - F.col("__prev")["__t"] > expiry_us, F.lit(True))
    sessions = count_up(rows, fresh, "__run").groupBy(key, "__run").agg(F.count(F.lit(1)).alias("n"), F.min("__t").alias("first_us"), F.max("__t").alias("last_us"))
    # numbered within the key: one row per session is left, not one per item
    w = Window.partitionBy(key).orderBy("__run")
    return sessions.withColumn("session_no", F.row_number().over(w).cast("bigint")).select(key, "session_no", "n", "first_us", "last_us")


def routed_epochs(df: DataFrame, route: str, epoch: str, routes: list[str] | DataFrame) -> DataFrame:
    """(epoch, route, n): every route sees every epoch, also one without rows for it. ``routes``: a list, or a frame with the column ``route`` of any number of rows."""
    counts = df.groupBy(epoch, route).agg(F.count(F.lit(1)).alias("n"))
    epochs = df.select(epoch).distinct()
    if isinstance(routes, DataFrame):
        # every epoch meets every route, as the result asks; each of the parts that the epochs fall into gets a copy of the routes
        parts = shuffle_partitions(df.sparkSession)
        of_part = routes.select(route).distinct().withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        grid = epochs.withColumn("__part", F.pmod(F.xxhash64(epoch), F.lit(parts)).cast("int")).join(of_part, "__part").drop("__part")
        met = F.col(f"g.{epoch}").eqNullSafe(F.col(f"c.{epoch}")) & F.col(f"g.{route}").eqNullSafe(F.col(f"c.{route}"))
        return grid.alias("g").join(counts.alias("c"), met, "left").select(f"g.{epoch}", f"g.{route}", F.coalesce("c.n", F.lit(0)).alias("n"))
    grid = epochs.withColumn(route, F.explode(F.array(*(F.lit(r) for r in routes))))
    return grid.join(counts, [epoch, route], "left").fillna({"n": 0})
