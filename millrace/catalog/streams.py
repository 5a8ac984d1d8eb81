"""Streaming twins of batch queries, over all files there are, and round trips through sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.sources.readers import producer_source, read_arrow
from millrace.sources.sinks import VersionLog, event_sink, read_events, write_arrow, write_parquet
from millrace.sources.tables import table
from millrace.streaming import runs


def _stream(spark, d, name="events"):
    # a pattern that matches the table alone, be it a file or a folder: a stream's plain path must be a folder
    return runs.read_files(spark, f"{d}/{name}.parque[t]", table(spark, d, name).schema)


def _folders(spark, name):
    base = runs.shared_folder(spark, name)
    return f"{base}/out", f"{base}/checkpoint"


def stream_epoch_totals(spark, d):
    """Each micro-batch is an epoch, written once by its id; totals per type over all epochs."""
    out, checkpoint = _folders(spark, "epoch-totals")
    per_epoch = lambda df, epoch: df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    runs.run_epochs(_stream(spark, d).select("event_type", "value"), out, checkpoint, per_epoch)
    return spark.read.parquet(out).groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,2)").alias("total"))


def stream_window_counts(spark, d):
    """Counts per type and day under a watermark, the last state of each."""
    out, checkpoint = _folders(spark, "window-counts")
    stream = runs.window_counts(_stream(spark, d).select("ts", "event_type"), "ts", "1 day", ["event_type"], "40 days")
    runs.run_epochs(stream, out, checkpoint, mode="update")
    return spark.read.parquet(out).groupBy("window_start", "event_type").agg(F.max_by("n", "epoch").alias("n"))


def _late_events(spark, d):
    """A folder of five files, made one after another: two halves of the events in time, two small ones of the last day, and last the late ones, every tenth event."""
    path = runs.shared_folder(spark, "late-events")
    e = table(spark, d, "events").select("event_id", "ts", "event_type")
    ends = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    half, last_day = ends["a"] + (ends["b"] - ends["a"]) / 2, F.col("ts") >= F.lit(ends["b"]).cast("timestamp_ntz") - F.expr("interval 1 day")
    kind, top = F.col("event_id") % 10, F.col("ts") == F.lit(ends["b"])
    late = (kind == 0) & ~top
    small = [~top & last_day & (kind == k) for k in (1, 2)]
    first = ~late & ~small[0] & ~small[1]
    for part in (first & (F.col("ts") < F.lit(half)), first & (F.col("ts") >= F.lit(half)), *small, late):
        e.where(part).coalesce(1).write.mode("append").parquet(path)  # an epoch is a file here
    return path, e.schema


def stream_late_rows(spark, d):
    """Several epochs, windows of four hours every two, and late rows: those whose window has ended two days before the latest time are dropped."""
    path, schema = _late_events(spark, d)
    out, checkpoint = _folders(spark, "late-rows")
    stream = runs.window_counts(runs.read_epoch_files(spark, path, schema).select("ts", "event_type"), "ts", "4 hours", ["event_type"], "2 days", "2 hours")
    runs.run_epochs(stream, out, checkpoint, mode="update")
    return spark.read.parquet(out).groupBy("window_start", "event_type").agg(F.max_by("n", "epoch").alias("n"))


def stream_state_over_epochs(spark, d):
    """Counts per type kept as state over several epochs; each type's last count and the epochs that had rows of it."""
    path, schema = _late_events(spark, d)
    out, checkpoint = _folders(spark, "state-over-epochs")
    runs.run_epochs(runs.running_counts(runs.read_epoch_files(spark, path, schema), "event_type", "string"), out, checkpoint, mode="update")
    rows = spark.read.parquet(out).groupBy("event_type").agg(F.max("n").alias("n"), F.countDistinct("epoch").alias("n_epochs"))
    return rows.select("event_type", "n", (F.col("n_epochs") > 1).alias("several"))


def stream_policy(spark, d):
    """Each micro-batch cut into epochs of a thousand rows by the configured policy."""
    from millrace.operators.epochs import EpochPolicy
    from millrace.streaming.epochs import EpochConfig, run_configured

    out, checkpoint = _folders(spark, "policy")
    config = EpochConfig(policy=EpochPolicy.by_count(1000), order=["event_id"])
    config.add_processor("sizes", lambda df: df.groupBy("epoch_seq").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id")))
    run_configured(_stream(spark, d).select("event_id"), out, checkpoint, config)
    return spark.read.parquet(f"{out}/sizes").select("epoch_seq", "n", "first_id")


def change_feed(spark, d):
    """A10: a log with a change feed is read by it; the strategy tells."""
    log = VersionLog(spark, runs.shared_folder(spark, "change-feed"), feed=True)
    rows = table(spark, d, "events").select("event_id", "event_type")
    log.append(rows.where("event_type = 'click'"))
    log.append(rows.where("event_type = 'view'"))
    return log.changes(1).select("event_id", "event_type", F.col("commit_version").cast("bigint").alias("commit_version"), "strategy")


def arrow_round_trip(spark, d):
    """Written as Arrow IPC files by the tasks, and read again."""
    path = runs.shared_folder(spark, "arrow").removeprefix("file:")
    write_arrow(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return read_arrow(spark, path)


def event_log_sink(spark, d):
    """Events appended in two lots, snapshots by policy, telemetry of completed runs pruned when read."""
    base = runs.shared_folder(spark, "event-sink")
    log, snaps = VersionLog(spark, f"{base}/log"), VersionLog(spark, f"{base}/snapshots")
    events = table(spark, d, "flow_event").select("id", "flow_run_id", "event_type").distinct()
    fold = lambda df: df.groupBy("flow_run_id").agg(F.max("id").alias("as_of"), F.count(F.lit(1)).alias("n"))
    for part in ("id % 2 = 0", "id % 2 = 1"):
        event_sink(events.where(part), log, snaps, "flow_run_id", "id", "event_type", fold)
    kept = read_events(log, "flow_run_id", "event_type", "FlowCompletedEvent").groupBy("flow_run_id").agg(F.count(F.lit(1)).alias("n_kept"))
    latest = snaps.read().groupBy("flow_run_id").agg(F.max("as_of").alias("as_of"))
    return kept.join(latest, "flow_run_id", "left")


def stream_running_counts(spark, d):
    """L15, M-5: events per user kept as state, the last count of each."""
    out, checkpoint = _folders(spark, "running-counts")
    runs.run_epochs(runs.running_counts(_stream(spark, d), "user_id"), out, checkpoint, mode="update")
    return spark.read.parquet(out).groupBy("user_id").agg(F.max("n").alias("n"))


def stream_restart(spark, d):
    """M-4, M-5, M-6: as many ids as there are events from a stream with an offset; each run goes on after the checkpoint of the one before."""
    out, checkpoint = _folders(spark, "restart")
    n = table(spark, d, "events").count()
    for share in (2, 1, 1):  # half of them are there at first, then all, then nothing new
        spark.dataSource.register(runs.counting_source("millrace_ids", lambda upto=-(-n // share): upto, 100_000))
        runs.run_epochs(spark.readStream.format("millrace_ids").load(), out, checkpoint)
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_distinct"), F.max("id").alias("last_id"))


def version_log(spark, d):
    """Two appends and an empty one; what came after the first version."""
    log = VersionLog(spark, runs.shared_folder(spark, "version-log"))
    rows = table(spark, d, "events").select("event_id", "event_type")
    log.append(rows.where("event_type = 'click'"))
    log.append(rows.where("event_type != 'click'"))
    log.append(rows.limit(0))
    return log.changes(1, 9).select("event_id", "event_type", F.col("commit_version").cast("bigint").alias("commit_version"), "strategy")


def parquet_round_trip(spark, d):
    """Written as Parquet by type and read again."""
    path = runs.shared_folder(spark, "parquet")
    write_parquet(table(spark, d, "events").select("event_id", "event_type"), path, partition_by=("event_type",))
    return spark.read.parquet(path).groupBy(F.col("event_type").cast("string").alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


def _numbers(first: int):
    return lambda: ((i,) for i in range(first, first + 100))


def producers(spark, d):
    """Three producers as one source, a partition for each."""
    spark.dataSource.register(producer_source("millrace_numbers", "id bigint", [_numbers(0), _numbers(100), _numbers(200)]))
    return spark.read.format("millrace_numbers").load().agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.max("id").alias("greatest"), F.sum("id").alias("total"))


QUERIES = {f.__name__: f for f in (stream_epoch_totals, stream_late_rows, stream_state_over_epochs, stream_policy, change_feed, arrow_round_trip, event_log_sink, stream_window_counts, stream_running_counts, stream_restart, version_log, parquet_round_trip, producers)}
ORACLE = {
    "stream_late_rows": """WITH e AS (SELECT ts, event_type, event_id % 10 = 0 AND ts <> (SELECT max(ts) FROM events) AS late FROM events),
w AS (SELECT event_type, late, time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 2 HOUR AS s FROM e, range(2) r(k)),
m AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 DAY AS mark FROM events)
SELECT s AS window_start, event_type, count(*) AS n FROM w, m WHERE NOT late OR s + INTERVAL 4 HOUR > mark GROUP BY 1, 2""",
    "stream_state_over_epochs": "SELECT event_type, count(*) AS n, true AS several FROM events GROUP BY 1",
    "stream_policy": "WITH n AS (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 1000 + 1 AS epoch_seq FROM events) SELECT epoch_seq, count(*) AS n, min(event_id) AS first_id FROM n GROUP BY 1",
    "change_feed": "SELECT event_id, event_type, 2::BIGINT AS commit_version, 'ChangeDataFeed' AS strategy FROM events WHERE event_type = 'view'",
    "arrow_round_trip": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
    "event_log_sink": """WITH e AS (SELECT DISTINCT id, flow_run_id, event_type FROM flow_event), done AS (SELECT DISTINCT flow_run_id FROM e WHERE event_type = 'FlowCompletedEvent'),
k AS (SELECT flow_run_id, count(*) AS n_kept FROM e WHERE NOT (event_type IN ('BlockMetricsEvent', 'EdgeProgressEvent', 'ChannelStatsEvent') AND flow_run_id IN (FROM done)) GROUP BY 1),
p AS (SELECT flow_run_id, id % 2 AS lot FROM e WHERE event_type IN ('FlowStartedEvent', 'FlowCompletedEvent') OR id % 100 = 0),
s AS (SELECT p.flow_run_id, max(e.id) AS as_of FROM p JOIN e ON e.flow_run_id = p.flow_run_id AND (e.id % 2 = 0 OR p.lot = 1) GROUP BY 1)
SELECT k.flow_run_id, n_kept, as_of FROM k LEFT JOIN s ON s.flow_run_id = k.flow_run_id""",
    "stream_epoch_totals": "SELECT event_type, count(*)::BIGINT AS n, sum(value::DECIMAL(18,2))::DECIMAL(38,2) AS total FROM events GROUP BY 1",
    "stream_window_counts": "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_running_counts": "SELECT user_id, count(*) AS n FROM events GROUP BY 1",
    "stream_restart": "SELECT count(*) AS n, count(*) AS n_distinct, count(*) AS last_id FROM events",
    "version_log": "SELECT event_id, event_type, 2::BIGINT AS commit_version, 'VersionDiffFallback' AS strategy FROM events WHERE event_type <> 'click'",
    "parquet_round_trip": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "producers": "SELECT 300::BIGINT AS n, 0::BIGINT AS least, 299::BIGINT AS greatest, 44850::BIGINT AS total",
}
