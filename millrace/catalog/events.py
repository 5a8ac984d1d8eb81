"""Queries on the event log of runs and its telemetry, and on channel readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import events as ev
from millrace.operators import joins
from millrace.operators.ordered import running_within
from millrace.sources.tables import micros, table


def _log(spark, d):
    """The flow events, each delivery once: repeated deliveries are equal rows."""
    return table(spark, d, "flow_event").select("id", "flow_run_id", "event_type", micros("occurred_at").alias("us"), "correlation_id").distinct()


def _snapshots(spark, d):
    return table(spark, d, "flow_snapshot").select("flow_run_id", "as_of_event_id")


def event_fold_latest(spark, d):
    """Per run the last event's type and time, by id."""
    return ev.fold_latest(_log(spark, d), ["flow_run_id"], "id", ["event_type", "us"])


def snapshot_fold(spark, d):
    """The same from the events up to the last one that any snapshot holds."""
    last = _snapshots(spark, d).agg(F.max("as_of_event_id")).first()[0]
    return ev.fold_latest(_log(spark, d), ["flow_run_id"], "id", ["event_type"], up_to=last)


def edge_rates(spark, d):
    """Items per second between a channel's samples, with the running sum of its counts as items."""
    edge = ["flow_run_id", "source_block", "target_block"]
    rows = table(spark, d, "channel_stats").select(*edge, micros("timestamp").alias("us"), "current_count").dropna().groupBy(*edge, "us").agg(F.max("current_count").alias("n"))
    rows = running_within(rows, edge, ["us"], F.col("n"), "items")
    return ev.edge_rates(rows, edge, "us", "items").select(*edge, "us", "rate")


def channel_levels(spark, d):
    """Per channel of a run the last, least and greatest level."""
    rows = table(spark, d, "channel_stats").select("flow_run_id", "source_block", "target_block", micros("timestamp").alias("us"), "current_count").dropna().distinct()
    return ev.fold_latest(rows, ["flow_run_id", "source_block", "target_block"], "us", [], counted="current_count")


def snapshot_points(spark, d):
    """Starts, completions and every hundredth id."""
    return ev.snapshot_points(_log(spark, d), "id", "event_type").select("id", "flow_run_id")


def prune_telemetry(spark, d):
    """Metrics of completed runs are dropped; what is left by type."""
    return ev.prune_telemetry(_log(spark, d), "flow_run_id", "event_type", "FlowCompletedEvent").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def audit_split(spark, d):
    """Structural events and telemetry."""
    return ev.audit_split(_log(spark, d), "event_type").groupBy("event_type", "is_structural").agg(F.count(F.lit(1)).alias("n"))


def state_query(spark, d):
    """What a viewer of each run gets beyond its snapshot."""
    return ev.state_query(_log(spark, d), _snapshots(spark, d), "flow_run_id", "id", "as_of_event_id", "event_type").select("id", "flow_run_id", "part")


def event_delta(spark, d):
    """H4: events that the latest snapshot of their run doesn't hold."""
    return joins.events_after_snapshot(_log(spark, d), _snapshots(spark, d), "flow_run_id", "id", "as_of_event_id").select("id", "flow_run_id")


def missed_events(spark, d):
    """Events after the first, in order."""
    return ev.missed_events(_log(spark, d), "id", 1).select("id", "event_type")


def flow_list_page(spark, d):
    """The second page of runs, newest first; a size over 200 is held to 200."""
    runs = table(spark, d, "flow_summary").groupBy("flow_run_id").agg(F.max(micros("started_at")).alias("us"))
    return ev.list_page(runs, [F.desc_nulls_last("us"), F.asc("flow_run_id")], 2, 500)


def attempts(spark, d):
    """Runs and attempts per correlation id; a standalone run is its own."""
    runs = table(spark, d, "flow_summary").select(F.coalesce("correlation_id", "flow_run_id").alias("work_item"), "flow_run_id", "attempt_number", "status").distinct()
    return runs.groupBy("work_item").agg(F.countDistinct("flow_run_id").alias("n_runs"), F.max("attempt_number").alias("last_attempt"), F.count_if(F.col("status") == "Failed").alias("n_failed"))


QUERIES = {f.__name__: f for f in (event_fold_latest, snapshot_fold, edge_rates, channel_levels, snapshot_points, prune_telemetry, audit_split, state_query, event_delta, missed_events, flow_list_page, attempts)}

_LOG = "WITH l AS (SELECT DISTINCT id, flow_run_id, event_type, epoch_us(occurred_at) AS us, correlation_id FROM flow_event), s AS (SELECT flow_run_id, max(as_of_event_id) AS a FROM flow_snapshot GROUP BY 1)"
_STRUCTURAL = "event_type IN ('FlowStartedEvent', 'FlowCompletedEvent', 'FlowGraphDefinedEvent', 'BlockStartedEvent', 'BlockCompletedEvent')"
_TELEMETRY = "event_type IN ('BlockMetricsEvent', 'EdgeProgressEvent', 'ChannelStatsEvent')"
_CHANNEL = "flow_run_id IS NOT NULL AND source_block IS NOT NULL AND target_block IS NOT NULL AND \"timestamp\" IS NOT NULL AND current_count IS NOT NULL"
ORACLE = {
    "event_fold_latest": _LOG + " SELECT flow_run_id, arg_max(event_type, id) AS event_type, arg_max(us, id) AS us, min(id) AS first_id, max(id) AS last_id, count(*) AS n_events FROM l GROUP BY 1",
    "snapshot_fold": _LOG + " SELECT flow_run_id, arg_max(event_type, id) AS event_type, min(id) AS first_id, max(id) AS last_id, count(*) AS n_events FROM l WHERE id <= (SELECT max(as_of_event_id) FROM flow_snapshot) GROUP BY 1",
    "edge_rates": f"""WITH r AS (SELECT flow_run_id, source_block, target_block, epoch_us("timestamp") AS us, max(current_count) AS n FROM channel_stats WHERE {_CHANNEL} GROUP BY ALL),
i AS (SELECT *, sum(n) OVER (PARTITION BY flow_run_id, source_block, target_block ORDER BY us ROWS UNBOUNDED PRECEDING) AS items FROM r),
x AS (SELECT *, (us - lag(us) OVER w) / 1e6 AS dt, items - lag(items) OVER w AS dn FROM i WINDOW w AS (PARTITION BY flow_run_id, source_block, target_block ORDER BY us))
SELECT flow_run_id, source_block, target_block, us, dn / dt AS rate FROM x WHERE dt > 0 AND dn / dt > 0""",
    "channel_levels": f"""WITH r AS (SELECT DISTINCT flow_run_id, source_block, target_block, epoch_us("timestamp") AS us, current_count FROM channel_stats WHERE {_CHANNEL})
SELECT flow_run_id, source_block, target_block, min(us) AS first_id, max(us) AS last_id, count(*) AS n_events, min(current_count) AS min_current_count, max(current_count) AS max_current_count FROM r GROUP BY 1, 2, 3""",
    "snapshot_points": _LOG + " SELECT id, flow_run_id FROM l WHERE event_type IN ('FlowStartedEvent', 'FlowCompletedEvent') OR id % 100 = 0",
    "prune_telemetry": _LOG + f" SELECT event_type, count(*) AS n FROM l WHERE NOT ({_TELEMETRY} AND flow_run_id IN (SELECT flow_run_id FROM l WHERE event_type = 'FlowCompletedEvent' AND flow_run_id IS NOT NULL)) GROUP BY 1",
    "audit_split": _LOG + f" SELECT event_type, coalesce({_STRUCTURAL}, false) AS is_structural, count(*) AS n FROM l GROUP BY 1, 2",
    "state_query": _LOG + f" SELECT id, flow_run_id, CASE WHEN a IS NULL OR id > a THEN 'delta' ELSE 'audit' END AS part FROM l LEFT JOIN s USING (flow_run_id) WHERE a IS NULL OR id > a OR {_STRUCTURAL}",
    "event_delta": _LOG + " SELECT id, flow_run_id FROM l LEFT JOIN s USING (flow_run_id) WHERE a IS NULL OR id > a",
    "missed_events": _LOG + " SELECT id, event_type FROM l WHERE id > 1",
    "flow_list_page": "SELECT flow_run_id, max(epoch_us(started_at)) AS us FROM flow_summary GROUP BY 1 ORDER BY us DESC NULLS LAST, flow_run_id LIMIT 200 OFFSET 200",
    "attempts": """WITH r AS (SELECT DISTINCT coalesce(correlation_id, flow_run_id) AS work_item, flow_run_id, attempt_number, status FROM flow_summary)
SELECT work_item, count(DISTINCT flow_run_id) AS n_runs, max(attempt_number) AS last_attempt, count(*) FILTER (status = 'Failed') AS n_failed FROM r GROUP BY 1""",
}
