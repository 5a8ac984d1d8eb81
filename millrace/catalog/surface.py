"""Queries on the extension surface, file formats, the checkpoint store, and what other engines offer besides."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.catalog.problems import NESTED
from millrace.functions import scalars
from millrace.operators import functions, topology
from millrace.operators.durable import durable
from millrace.operators.epochs import single_epoch
from millrace.operators.shred import Shape, entity_table, shred
from millrace.plans.graph import Block, Edge, Graph
from millrace.sources import readers, sinks
from millrace.sources.checkpoints import CheckpointStore
from millrace.sources.tables import table
from millrace.streaming import runs
from millrace.streaming.epochs import EpochConfig, Progress, run_configured, run_flows


def map_batches(spark, d):
    """A stream transformer that drops small values and doubles the others."""
    rows = table(spark, d, "events").select("event_id", "value")
    return functions.map_batches(rows, lambda p: p[p["value"] >= 10].assign(value=lambda x: x["value"] * 2), "event_id bigint, value double")


def epoch_actor(spark, d):
    """C4: the same within epochs, whose tag is kept."""
    rows = table(spark, d, "events").select("event_id", F.expr("event_id div 1000").alias("epoch"))
    out = functions.map_epochs(rows, "epoch", lambda p: p[p["event_id"] % 2 == 0].copy(), "event_id bigint")
    return out.groupBy("epoch").agg(F.count(F.lit(1)).alias("n"))


def scalar_function(spark, d):
    """A scalar function over Arrow batches."""
    half = functions.scalar(lambda s: s // 2, "bigint")
    return table(spark, d, "orders").select("o_orderkey", half("o_custkey").alias("half"))


def grouped_function(spark, d):
    """A user aggregate per type. Arrow's greatest value leaves NaN out, so a state says whether there was one."""
    states = table(spark, d, "events").select("event_type", F.col("value").alias("high"), F.col("value").alias("low"), F.isnan("value").alias("nan"))

    def merge(t: pa.Table) -> pa.Table:
        found = t.group_by("event_type").aggregate([("high", "max"), ("low", "min"), ("nan", "any")])
        return found.select(["event_type", "high_max", "low_min", "nan_any"]).rename_columns(t.column_names)

    def spread(t: pa.Table) -> pa.Table:
        return pa.table({"event_type": t["event_type"], "spread": pc.if_else(t["nan"], float("nan"), pc.subtract(t["high"], t["low"]))})

    return functions.folded(states, ["event_type"], merge, spread, "event_type string, spread double")


def epoch_streams(spark, d):
    """Rows that carry a vector as their epoch."""
    rows = single_epoch(table(spark, d, "events").select("event_id", "event_type"), "events")
    return rows.where(F.col("epoch")["events"] == 1).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def csv_round_trip(spark, d):
    """Parts written as CSV and read under a schema."""
    path = runs.shared_folder(spark, "csv")
    table(spark, d, "part").select("p_partkey", "p_name", "p_size").write.csv(path, header=True)
    return readers.read_csv(spark, path, "p_partkey bigint, p_name string, p_size int")


def json_ingest(spark, d):
    """Nested JSON lines under a schema, flattened on both levels."""
    path = runs.shared_folder(spark, "json")
    line = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    journals = line.groupBy("l_orderkey", "l_suppkey").agg(F.collect_list(F.struct("l_partkey")).alias("entries"))
    journals.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_suppkey", "entries")).alias("journals")).write.json(path)
    nested = readers.read_json(spark, path, "l_orderkey bigint, journals array<struct<l_suppkey:bigint,entries:array<struct<l_partkey:bigint>>>>")
    flat = nested.select("l_orderkey", F.inline("journals")).select("l_orderkey", "l_suppkey", F.inline("entries"))
    return flat.groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_partkey").alias("least_part"))


def input_channel(spark, d):
    """A4: rows pushed from outside beside those of a table."""
    pushed = readers.from_rows(spark, ((-i, "pushed") for i in range(1, 6)), "event_id bigint, event_type string")
    return topology.fan_in(table(spark, d, "events").select("event_id", "event_type"), pushed)


def checkpoint_store(spark, d):
    """M-4, M-6: checkpoints saved, replaced, deleted; the latest is found by time."""
    store = CheckpointStore(spark, runs.shared_folder(spark, "checkpoints"))
    last = table(spark, d, "events").agg(F.max("event_id")).first()[0]
    for name, at, seq in (("c1", 10, 1), ("c2", 30, last), ("c3", 20, 3), ("c1", 15, 2)):
        store.save(name, {"events": seq}, at, {"counter": str(seq)})
    store.delete("c3")
    newest = store.latest()["checkpoint_id"]
    return store.all().select("checkpoint_id", F.col("vector")["events"].alias("seq"), "at_us", F.col("states")["counter"].alias("counter"), (F.col("checkpoint_id") == newest).alias("is_latest"))


def stream_processors(spark, d):
    """Two processors of each epoch under hooks and a checkpoint strategy."""
    base = runs.shared_folder(spark, "processors")
    log: list[str] = []
    config = EpochConfig(checkpoint=lambda n: n % 1 == 0)
    config.hooks.on_begin = lambda e: log.append(f"begin {e}")
    config.hooks.on_commit = lambda e: log.append(f"commit {e}")
    config.add_processor("count", lambda df: df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))
    config.add_processor("last", lambda df: df.groupBy("event_type").agg(F.max("event_id").alias("last_id")))
    stream = runs.read_files(spark, f"{d}/events.parque[t]", table(spark, d, "events").schema)
    done = run_configured(stream, f"{base}/out", f"{base}/ck", config)
    count = spark.read.parquet(f"{base}/out/count").groupBy("event_type").agg(F.sum("n").alias("n"))
    last = spark.read.parquet(f"{base}/out/last").groupBy("event_type").agg(F.max("last_id").alias("last_id"))
    hooked = len(log) == 2 * len(done["committed"]) == 2 * len(done["checkpointed"])
    return count.join(last, "event_type").withColumn("hooked", F.lit(hooked))


def top_per_group(spark, d):
    """J5, I6, an addition: the three costliest orders per priority; tasks keep three each before the shuffle."""
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice").withColumn("place", F.row_number().over(w)).where("place <= 3")


def block_seconds(spark, d):
    """K3: seconds from a block's start to its end, by state."""
    rows = table(spark, d, "block_snapshot").select("state", scalars.seconds_between(F.col("start_time"), F.col("end_time")).alias("s"))
    return rows.groupBy("state").agg(F.count("s").alias("n"), F.min("s").alias("least"), F.max("s").alias("greatest"))


def observed_metrics(spark, d):
    """What an observation saw while the rows passed, as one row."""
    rows, seen = sinks.observed(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "orders", n=F.count(F.lit(1)), last_key=F.max("o_orderkey"))
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["n"], seen.get["last_key"])], "n bigint, last_key bigint")


def _graph_parts(spark, d):
    """The blocks and edges of every graph defined in the events."""
    shape = Shape({"blocks": ("blockname",), "edges": ("sourceblock", "targetblock")}, frozenset({"edges"}), scalars=frozenset({"blockname", "sourceblock", "targetblock"}))
    nodes = shred(table(spark, d, "flow_event").where("event_type = 'FlowGraphDefinedEvent'"), "id", "payload", shape)
    return entity_table(nodes, {"blocks": "block", "edges": "edge"}, {"name": ("blockName",), "source": ("sourceBlock",), "target": ("targetBlock",)})


def competing_workers(spark, d):
    """B1: every order to exactly one of the workers that compete for partitions; what they added up."""
    n, keys = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def work(rows):
        for r in rows:
            n.add(1)
            keys.add(r["o_orderkey"])

    sinks.for_each_part(table(spark, d, "orders").select("o_orderkey"), work)
    return spark.createDataFrame([(n.value, keys.value)], "n bigint, total bigint")


def output_rows(spark, d):
    """B2: the rows of a result handed to the caller one after another: events per type and user group."""
    counts = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 10).alias("user_group")).agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([tuple(r) for r in sinks.rows_of(counts)], "event_type string, user_group bigint, n bigint")


def stream_progress(spark, d):
    """What a listener is told while a stream runs: it started, its epochs with their rows and a rate, it ended."""
    import time

    told = Progress()
    spark.streams.addListener(told)
    try:
        base = runs.shared_folder(spark, "progress")
        stream = runs.read_files(spark, f"{d}/events.parque[t]", table(spark, d, "events").schema)
        runs.run_epochs(stream.select("event_id"), f"{base}/out", f"{base}/ck")
        for _ in range(100):  # the listener is told a little later
            if told.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(told)
    rows = sum(n for _, _, n, _ in told.epochs)
    rated = all(rate > 0 for _, _, n, rate in told.epochs if n)
    return spark.createDataFrame([(len(told.started), len(told.ended), rows, rated)], "n_started bigint, n_ended bigint, n_rows bigint, rated boolean")


def throttled_flows(spark, d):
    """Five flows, at most two at a time."""
    names = ["orders", "events", "part", "customer", "supplier"]
    done, most = run_flows({n: (lambda n=n: table(spark, d, n).count()) for n in names}, 2, spark)
    return spark.createDataFrame([(n, done[n], most <= 2) for n in names], "flow string, n bigint, held_back boolean")


def graph_order(spark, d):
    """The blocks of every graph defined in the events, in the order in which they can run; a block on or behind a cycle has no place."""
    parts = _graph_parts(spark, d)

    # a block is named by its key in a map if it holds no name itself
    name = F.coalesce("name", F.when(F.col("kind") == "block", F.col("map_key"))).alias("name")
    graphs = parts.groupBy("record_id", "doc").agg(F.array_sort(F.collect_list(F.struct("ordinal", "node", "kind", name, "source", "target"))).alias("parts"))

    def ordered(batches):
        for pdf in batches:
            rows = []
            for record, own in zip(pdf["record_id"], pdf["parts"]):
                names = [*dict.fromkeys(x["name"] for x in own if x["kind"] == "block" and x["name"] is not None)]
                order = Graph([Block(n) for n in names], [Edge(x["source"], x["target"]) for x in own if x["kind"] == "edge"]).order()
                rows += [*((record, i, n) for i, n in enumerate(order, 1)), *((record, None, n) for n in names if n not in {*order})]
            yield pd.DataFrame({"record_id": [r[0] for r in rows], "place": pd.array([r[1] for r in rows], "Int64"), "block": [r[2] for r in rows]})

    return graphs.select("record_id", "parts").mapInPandas(ordered, "record_id string, place bigint, block string")


def graph_sound(spark, d):
    """Per graph the blocks, those that ``graph_order`` gives a place, and the edges against that order: there must be none."""
    order = durable(graph_order(spark, d).distinct())
    edges = _graph_parts(spark, d).where("kind = 'edge'").select("record_id", "source", "target").distinct()
    ends = [order.select("record_id", F.col("block").alias(end), F.col("place").alias(f"{end}_place")) for end in ("source", "target")]
    wrong = F.col("target_place").isNotNull() & (F.col("source_place").isNull() | (F.col("source_place") >= F.col("target_place")))
    broken = edges.join(ends[0], ["record_id", "source"]).join(ends[1], ["record_id", "target"]).where(wrong).groupBy("record_id").agg(F.count(F.lit(1)).alias("n"))
    counts = order.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.count("place").alias("n_placed"), F.coalesce(F.max("place"), F.lit(0)).alias("last"))
    bad = F.coalesce("n", F.lit(0)) + F.when(F.col("last") != F.col("n_placed"), 1).otherwise(0)
    return counts.join(broken, "record_id", "left").select("record_id", "n_blocks", "n_placed", bad.cast("bigint").alias("n_broken"))


def stream_tenants(spark, d):
    """A stream over a versioned log; the tenant is a partition column, the cursor is the checkpoint."""
    log = sinks.VersionLog(spark, runs.shared_folder(spark, "tenants"))
    rows = table(spark, d, "events").select("event_id", "event_type", (F.col("user_id") % 3).alias("tenant"))
    log.append(rows.where("event_type = 'click'"))
    log.append(rows.where("event_type != 'click'"))
    base = runs.shared_folder(spark, "tenants-read")
    stream = runs.read_files(spark, log.path, "event_id bigint, event_type string, tenant bigint, commit_version int").where("tenant = 1")
    runs.run_epochs(stream, f"{base}/out", f"{base}/ck")
    return spark.read.parquet(f"{base}/out").groupBy(F.col("commit_version").cast("bigint").alias("commit_version")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (block_seconds, observed_metrics, competing_workers, output_rows, stream_progress, throttled_flows, graph_order, graph_sound, stream_tenants, map_batches, epoch_actor, scalar_function, grouped_function, epoch_streams, csv_round_trip, json_ingest, input_channel, checkpoint_store, stream_processors, top_per_group)}
ORACLE = {
    "competing_workers": "SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM orders",
    "output_rows": "SELECT event_type, user_id % 10 AS user_group, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_progress": "SELECT 1::BIGINT AS n_started, 1::BIGINT AS n_ended, count(*) AS n_rows, true AS rated FROM events",
    "throttled_flows": "SELECT 'orders' AS flow, count(*) AS n, true AS held_back FROM orders UNION ALL SELECT 'events', count(*), true FROM events UNION ALL SELECT 'part', count(*), true FROM part UNION ALL SELECT 'customer', count(*), true FROM customer UNION ALL SELECT 'supplier', count(*), true FROM supplier",
    "graph_sound": NESTED
    + """, g AS (SELECT DISTINCT id::VARCHAR AS record_id FROM flow_event WHERE event_type = 'FlowGraphDefinedEvent'),
p AS (SELECT d.record_id, k.* FROM keyed k JOIN docs d ON d.doc = k.doc JOIN g ON g.record_id = d.record_id WHERE d.record_table = 'flow_event' AND k.kind IN ('block', 'edge')),
b AS (SELECT DISTINCT record_id, coalesce(block, map_key) AS name FROM p WHERE kind = 'block' AND coalesce(block, map_key) IS NOT NULL),
e AS (SELECT DISTINCT p.record_id, p.source, p.target FROM p JOIN b s ON s.record_id = p.record_id AND s.name = p.source JOIN b t ON t.record_id = p.record_id AND t.name = p.target WHERE p.kind = 'edge'),
reach AS (SELECT * FROM e UNION SELECT r.record_id, r.source, e.target FROM reach r JOIN e ON e.record_id = r.record_id AND e.source = r.target),
held AS (SELECT DISTINCT r.record_id, r.target AS name FROM reach r JOIN (SELECT record_id, source FROM reach WHERE source = target) c ON c.record_id = r.record_id AND c.source = r.source)
SELECT b.record_id, count(*) AS n_blocks, count(*) - count(held.name) AS n_placed, 0::BIGINT AS n_broken FROM b LEFT JOIN held ON held.record_id = b.record_id AND held.name = b.name GROUP BY 1""",
    "block_seconds": "WITH b AS (SELECT state, (epoch_us(end_time) - epoch_us(start_time)) / 1e6 AS s FROM block_snapshot) SELECT state, count(s) AS n, min(s) AS least, max(s) AS greatest FROM b GROUP BY 1",
    "observed_metrics": "SELECT count(*) AS n, max(o_orderkey) AS last_key FROM orders",
    "stream_tenants": "SELECT CASE WHEN event_type = 'click' THEN 1 ELSE 2 END::BIGINT AS commit_version, count(*) AS n FROM events WHERE user_id % 3 = 1 GROUP BY 1",
    "map_batches": "SELECT event_id, value * 2 AS value FROM events WHERE value >= 10",
    "epoch_actor": "SELECT event_id // 1000 AS epoch, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1",
    "scalar_function": "SELECT o_orderkey, o_custkey // 2 AS half FROM orders",
    "grouped_function": "SELECT event_type, max(value) - min(value) AS spread FROM events GROUP BY 1",
    "epoch_streams": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "csv_round_trip": "SELECT p_partkey, p_name, p_size FROM part",
    "json_ingest": "SELECT l_orderkey, l_suppkey, count(*) AS n, min(l_partkey) AS least_part FROM lineitem GROUP BY 1, 2",
    "input_channel": "SELECT event_id, event_type FROM events UNION ALL SELECT -i, 'pushed' FROM range(1, 6) r(i)",
    "checkpoint_store": "SELECT 'c1' AS checkpoint_id, 2::BIGINT AS seq, 15::BIGINT AS at_us, '2' AS counter, false AS is_latest UNION ALL SELECT 'c2', max(event_id), 30, max(event_id)::VARCHAR, true FROM events",
    "stream_processors": "SELECT event_type, count(*)::BIGINT AS n, max(event_id) AS last_id, true AS hooked FROM events GROUP BY 1",
    "top_per_group": "SELECT o_orderpriority, o_orderkey, o_totalprice, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3",
}
