"""Queries on epochs, vector clocks, watermarks and checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import vectors
from millrace.operators import epochs
from millrace.sources.tables import micros, table


def segment_by_key(spark, d):
    """Contiguous runs of one event type; their sizes."""
    rows = epochs.segment_by_key(table(spark, d, "events").select("event_id", "event_type"), "event_type", ["event_id"])
    return rows.groupBy("epoch_seq", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def segment_by_day(spark, d):
    """L1: runs of one day."""
    rows = epochs.segment_by_key(table(spark, d, "events").select("event_id", F.to_date("ts").alias("day")), "day", ["event_id"])
    return rows.groupBy("epoch_seq").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def segment_by_clock(spark, d):
    """L2: events under the vector of the last signup before them."""
    e = table(spark, d, "events").select("event_id", micros("ts").alias("us"), "event_type")
    clock = e.where("event_type = 'signup'").select(F.col("us").alias("tick_us"), F.create_map(F.lit("signup"), F.col("event_id")).alias("vector"))
    rows = epochs.segment_by_clock(e, clock, "us", "tick_us", "vector")
    return rows.groupBy(F.try_element_at("epoch", F.lit("signup")).alias("signup_id")).agg(F.count(F.lit(1)).alias("n"))


def single_epoch(spark, d):
    """All events in epoch 1 of one source."""
    return epochs.single_epoch(table(spark, d, "events").select("event_id"), "events").groupBy(vectors.text(F.col("epoch")).alias("epoch")).agg(F.count(F.lit(1)).alias("n"))


def cut_by_policy(spark, d):
    """L4: an epoch ends after 40 events or six hours."""
    rows = table(spark, d, "events").select("event_id", micros("ts").alias("us"))
    return epochs.cut_epochs(rows, epochs.EpochPolicy.by_count_or_time(40, 21_600_000_000), ["event_id"], "us").groupBy("epoch_seq").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def _vectors(spark, d):
    """Per user the vector of events per type, and that of clicks and views alone."""
    e = table(spark, d, "events").select("user_id", "event_type").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct("event_type", "n")
    return e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(entry)).alias("v"), F.map_from_entries(F.collect_list(F.when(F.col("event_type") < "p", entry))).alias("part"))


def epoch_vector_merge(spark, d):
    """A user's vector merged with a fixed one, exploded."""
    other = F.create_map(F.lit("click"), F.lit(12).cast("bigint"), F.lit("other"), F.lit(3).cast("bigint"))
    return _vectors(spark, d).select("user_id", F.explode(vectors.merge(F.col("v"), other)).alias("source", "seq"))


def vector_subsumes(spark, d):
    """K4: comparisons of a user's vector with its part and with a fixed one."""
    other = F.create_map(F.lit("click"), F.lit(12).cast("bigint"))
    v, p = F.col("v"), F.col("part")
    return _vectors(spark, d).select("user_id", vectors.subsumes(v, p).alias("subsumes_part"), vectors.at_most(p, v).alias("part_at_most"), vectors.subsumes(v, other).alias("subsumes_fixed"), vectors.total(v).alias("total"), vectors.sequence(v, "nothing").alias("missing"))


def vector_ancestor(spark, d):
    """H5: of a few known epochs the most specific that each user's vector is beyond."""
    known = spark.createDataFrame([(1, {"click": 5}), (2, {"click": 10}), (3, {"click": 5, "view": 5}), (4, {"view": 500})], "user_id bigint, v map<string,bigint>")
    return epochs.most_specific_ancestor(_vectors(spark, d).select("user_id", "v"), known, "user_id", "v")


def _progress(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("block"), (F.col("user_id") % 4).cast("string").alias("source"), F.col("event_id").alias("seq"))
    return e.withColumn("status", F.when(F.col("seq") % 7 == 0, "started").otherwise("completed"))


def block_progress(spark, d):
    """The greatest completed sequence per block and source."""
    return epochs.highest_completed(_progress(spark, d))


def global_watermark(spark, d):
    """The least of these per source."""
    return epochs.global_watermark(_progress(spark, d))


def progress_cleared(spark, d):
    """What is left once epochs up to the watermark are cleared."""
    left = epochs.clear_completed(_progress(spark, d), epochs.global_watermark(_progress(spark, d)))
    return left.groupBy("block").agg(F.count(F.lit(1)).alias("n"))


def aligned_epochs(spark, d):
    """Per hundred events an epoch that its sources share; how many took part."""
    e = table(spark, d, "events").select(F.col("event_type").alias("source"), F.expr("event_id div 100").alias("seq")).distinct()
    return epochs.align_sources(e).select("seq", "n_sources", F.cardinality("vector").cast("bigint").alias("n_entries"))


def epoch_barrier(spark, d):
    """Epochs of each event type, one per hundred of its events; made when all types have come as far, held beyond, and all held where a sixth source is awaited that never comes."""
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    e = e.select("source", F.explode(F.sequence(F.lit(1).cast("bigint"), F.expr("n div 100"))).alias("seq"))
    types = [r[0] for r in table(spark, d, "events").select("event_type").distinct().collect()]
    all_come = epochs.barrier(e, types).select("seq", "n_sources", "made", F.lit("all").alias("awaited"))
    return all_come.unionByName(epochs.barrier(e, [*types, "audit"]).select("seq", "n_sources", "made", F.lit("one more").alias("awaited")))


def checkpoint_every_n(spark, d):
    """M-1: every fifth day segment."""
    rows = epochs.segment_by_key(table(spark, d, "events").select("event_id", F.to_date("ts").alias("day")), "day", ["event_id"]).groupBy("epoch_seq").agg(F.max("event_id").alias("last_id"))
    return epochs.every_n(rows, "epoch_seq", 5)


def checkpoint_time_based(spark, d):
    """M-2: hour epochs, a checkpoint at least ten hours after the last."""
    rows = table(spark, d, "events").groupBy(F.expr("unix_micros(cast(ts as timestamp)) div 3600000000").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return epochs.time_based(rows, "hour", 10)


def checkpoint_states(spark, d):
    """M-3, M-4: per day a checkpoint with a state per block, and the last of them."""
    e = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.max("event_id").alias("m"))
    made = epochs.checkpoint_object(e.withColumn("state", F.col("m").cast("string")), ["day"], "event_type", "state")
    last = epochs.latest_checkpoint(made.select("day", F.to_json("states").alias("states")), "day").select("day", F.explode(F.from_json("states", "map<string,string>")).alias("block", "state"))
    return last


QUERIES = {
    f.__name__: f
    for f in (segment_by_key, segment_by_day, segment_by_clock, single_epoch, cut_by_policy, epoch_vector_merge, vector_subsumes, vector_ancestor, block_progress, global_watermark, progress_cleared, aligned_epochs, epoch_barrier, checkpoint_every_n, checkpoint_time_based, checkpoint_states)
}

_COUNTS = "WITH c AS (SELECT user_id, event_type AS source, count(*) AS seq FROM events GROUP BY 1, 2)"
_PROGRESS = "WITH p AS (SELECT event_type AS block, (user_id % 4)::VARCHAR AS source, event_id AS seq, event_id % 7 <> 0 AS done FROM events), h AS (SELECT block, source, max(seq) AS seq FROM p WHERE done GROUP BY 1, 2)"
_RUNS = "WITH c AS (SELECT event_id, {key} AS k, CASE WHEN {key} IS DISTINCT FROM lag({key}) OVER (ORDER BY event_id) THEN 1 ELSE 0 END AS x FROM events), e AS (SELECT event_id, k, sum(x) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS epoch_seq FROM c)"
ORACLE = {
    "segment_by_key": _RUNS.format(key="event_type") + " SELECT epoch_seq, k AS event_type, count(*) AS n, min(event_id) AS first_id FROM e GROUP BY 1, 2",
    "segment_by_day": _RUNS.format(key="ts::DATE") + " SELECT epoch_seq, count(*) AS n, min(event_id) AS first_id FROM e GROUP BY 1",
    "segment_by_clock": "WITH s AS (SELECT max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS signup_id FROM events) SELECT signup_id, count(*) AS n FROM s GROUP BY 1",
    "single_epoch": "SELECT 'EpochVector[events=1]' AS epoch, count(*) AS n FROM events",
    "cut_by_policy": """WITH t AS (SELECT event_id, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 21600000000 AS tick FROM events),
c AS (SELECT event_id, tick, (row_number() OVER (PARTITION BY tick ORDER BY event_id) - 1) // 40 AS chunk FROM t), e AS (SELECT event_id, dense_rank() OVER (ORDER BY tick, chunk) AS epoch_seq FROM c)
SELECT epoch_seq, count(*) AS n, min(event_id) AS first_id FROM e GROUP BY 1""",
    "epoch_vector_merge": _COUNTS + ", o AS (SELECT DISTINCT user_id, s.source, s.seq FROM c, (VALUES ('click', 12), ('other', 3)) s(source, seq)) SELECT user_id, source, max(seq)::BIGINT AS seq FROM (SELECT * FROM c UNION ALL SELECT * FROM o) GROUP BY 1, 2",
    "vector_subsumes": _COUNTS + " SELECT user_id, true AS subsumes_part, true AS part_at_most, coalesce(max(CASE WHEN source = 'click' THEN seq END), -1) >= 12 AS subsumes_fixed, sum(seq)::BIGINT AS total, -1::BIGINT AS missing FROM c GROUP BY user_id",
    "vector_ancestor": _COUNTS + """, v AS (SELECT user_id, coalesce(max(CASE WHEN source = 'click' THEN seq END), -1) AS c, coalesce(max(CASE WHEN source = 'view' THEN seq END), -1) AS w, count(*) AS k FROM c GROUP BY user_id)
SELECT user_id, (CASE WHEN c >= 5 AND w >= 5 AND NOT (k = 2 AND c = 5 AND w = 5) THEN 3 WHEN w >= 500 AND NOT (k = 1 AND w = 500) THEN 4 WHEN c >= 10 AND NOT (k = 1 AND c = 10) THEN 2 WHEN c >= 5 AND NOT (k = 1 AND c = 5) THEN 1 END)::BIGINT AS ancestor FROM v""",
    "block_progress": _PROGRESS + " SELECT block, source, seq FROM h",
    "global_watermark": _PROGRESS + " SELECT source, min(seq) AS seq FROM h GROUP BY 1",
    "progress_cleared": _PROGRESS + ", w AS (SELECT source, min(seq) AS m FROM h GROUP BY 1) SELECT block, count(*) AS n FROM p LEFT JOIN w USING (source) WHERE m IS NULL OR seq > m OR NOT done GROUP BY 1",
    "aligned_epochs": "SELECT event_id // 100 AS seq, count(DISTINCT event_type) AS n_sources, count(DISTINCT event_type) AS n_entries FROM events GROUP BY 1",
    "epoch_barrier": """WITH c AS (SELECT event_type, count(*) // 100 AS n FROM events GROUP BY 1), s AS (SELECT event_type, unnest(range(1, n + 1)) AS seq FROM c),
a AS (SELECT seq, count(*) AS n_sources FROM s GROUP BY 1) SELECT seq, n_sources, seq <= (SELECT min(n) FROM c) AS made, 'all' AS awaited FROM a UNION ALL SELECT seq, n_sources, false, 'one more' FROM a""",
    "checkpoint_every_n": _RUNS.format(key="ts::DATE") + " SELECT epoch_seq, max(event_id) AS last_id, epoch_seq % 5 = 0 AS checkpoint FROM e GROUP BY 1",
    "checkpoint_time_based": """WITH RECURSIVE h AS (SELECT epoch_us(ts) // 3600000000 AS hour, count(*) AS n FROM events GROUP BY 1), i AS (SELECT *, row_number() OVER (ORDER BY hour) AS r FROM h),
g AS (SELECT r, hour, n, hour AS last, true AS checkpoint FROM i WHERE r = 1 UNION ALL SELECT i.r, i.hour, i.n, CASE WHEN i.hour - g.last >= 10 THEN i.hour ELSE g.last END, i.hour - g.last >= 10 FROM g JOIN i ON i.r = g.r + 1)
SELECT hour, n, checkpoint FROM g""",
    "checkpoint_states": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS block, max(event_id)::VARCHAR AS state FROM events WHERE ts::DATE = (SELECT max(ts::DATE) FROM events) GROUP BY 1, 2",
}
