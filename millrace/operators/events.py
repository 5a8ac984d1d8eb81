"""The event log of runs: folds, rates, snapshots, pruning, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import with_previous

# Kinds of events and the snapshot period.
TELEMETRY = ("BlockMetricsEvent", "EdgeProgressEvent", "ChannelStatsEvent")
STRUCTURAL = ("FlowStartedEvent", "FlowCompletedEvent", "FlowGraphDefinedEvent", "BlockStartedEvent", "BlockCompletedEvent")
SNAPSHOT_KINDS = ("FlowStartedEvent", "FlowCompletedEvent")
SNAPSHOT_EVERY = 100


def fold_latest(events: DataFrame, keys: list[str], event_id: str, latest: list[str], counted: str | None = None, up_to: int | None = None) -> DataFrame:
    """Per key the last values by event id, the first and last id and the number of events, up to an id if given; partial per task."""
    rows = events if up_to is None else events.where(F.col(event_id) <= up_to)
    extra = [F.min(counted).alias(f"min_{counted}"), F.max(counted).alias(f"max_{counted}")] if counted else []
    return rows.groupBy(*keys).agg(*(F.max_by(c, event_id).alias(c) for c in latest), F.min(event_id).alias("first_id"), F.max(event_id).alias("last_id"), F.count(F.lit(1)).alias("n_events"), *extra)


def edge_rates(samples: DataFrame, edge: list[str], ts_us: str, items: str) -> DataFrame:
    """``samples`` with ``rate``, items per second since the edge's sample before; kept only where time passed and the rate is above zero.

    The samples are sorted over all partitions, so an edge of any number of samples makes no large task.
    """
    rows = with_previous(samples, [*edge, ts_us, items], [*edge, ts_us])
    prev = F.col("__prev")
    same = F.lit(True)
    for e in edge:
        same = same & F.col(e).eqNullSafe(prev[e])
    seconds = F.when(prev.isNotNull() & same, (F.col(ts_us) - prev[ts_us]) / F.lit(1e6))
    rows = rows.withColumn("__s", seconds).where("__s > 0").withColumn("rate", (F.col(items) - prev[items]) / F.col("__s"))
    return rows.where("rate > 0").select(*samples.columns, "rate")


def snapshot_points(events: DataFrame, event_id: str, kind: str, kinds: tuple[str, ...] = SNAPSHOT_KINDS, every: int = SNAPSHOT_EVERY) -> DataFrame:
    """The events at which a snapshot is taken: starts, completions and every 100th id."""
    return events.where(F.col(kind).isin(*kinds) | (F.col(event_id) % every == 0))


def prune_telemetry(events: DataFrame, run: str, kind: str, completed: str, telemetry: tuple[str, ...] = TELEMETRY) -> DataFrame:
    """The events without the telemetry of completed runs."""
    ended = events.where(F.col(kind) == completed).select(run).distinct().withColumn("__ended", F.lit(True))
    return events.join(ended, run, "left").where(F.col("__ended").isNull() | ~F.col(kind).isin(*telemetry)).drop("__ended")


def audit_split(events: DataFrame, kind: str, structural: tuple[str, ...] = STRUCTURAL) -> DataFrame:
    """Adds ``is_structural``: whether an event belongs to the audit trail rather than to telemetry."""
    return events.withColumn("is_structural", F.coalesce(F.col(kind).isin(*structural), F.lit(False)))


def state_query(events: DataFrame, snapshots: DataFrame, run: str, event_id: str, as_of: str, kind: str) -> DataFrame:
    """What a viewer of a run gets: events after its snapshot and all structural ones, each once, with ``part`` telling which."""
    latest = snapshots.groupBy(run).agg(F.max(as_of).alias("__as_of"))
    rows = events.join(latest, run, "left")
    later = F.col("__as_of").isNull() | (F.col(event_id) > F.col("__as_of"))
    return rows.withColumn("part", F.when(later, "delta").when(F.col(kind).isin(*STRUCTURAL), "audit")).where("part is not null").drop("__as_of")


def missed_events(events: DataFrame, event_id: str, after: int, run: str | None = None, run_id=None) -> DataFrame:
    """Events after an id, in order; of one run if given."""
    rows = events.where(F.col(event_id) > after)
    if run:
        rows = rows.where(F.col(run) == run_id)
    return rows.orderBy(event_id)


def list_page(df: DataFrame, order: list, page: int = 1, page_size: int = 50) -> DataFrame:
    """One page, newest first: pages count from 1, the size is held within 1 to 200."""
    page, size = max(1, page), min(200, max(1, page_size))
    return df.orderBy(*order).offset((page - 1) * size).limit(size)
