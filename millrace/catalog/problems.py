"""Queries p1_, p2_, p4_ and p5_: the general operators for pipeline data over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.durable import durable
from millrace.operators.grid import regular_grid
from millrace.operators.hotkeys import dominating_values, key_quantiles, key_totals
from millrace.operators.intervals import merge_intervals
from millrace.operators.shred import Shape, entity_table, shred, with_owner
from millrace.sources.tables import micros, table

SLOT_US = 10_000_000
GAP_LIMIT_US = 60_000_000


def _all_intervals(spark: SparkSession, d: str) -> DataFrame:
    work = table(spark, d, "flow_summary").select(F.lit("work_item").alias("entity_kind"), F.col("correlation_id").alias("entity_key"), micros("started_at").alias("s"), micros("completed_at").alias("e"))
    run = table(spark, d, "block_snapshot").select(F.lit("run").alias("entity_kind"), F.col("flow_run_id").alias("entity_key"), micros("start_time").alias("s"), micros("end_time").alias("e"))
    return work.unionByName(run)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Periods and gaps of work items (flow_summary) and runs (block_snapshot)."""
    return merge_intervals(_all_intervals(spark, d), ["entity_kind", "entity_key"], "s", "e").select("entity_kind", "entity_key", "span_kind", "start_us", "end_us")


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per entity: the number of periods and gaps, the time covered and the time idle."""
    spans = merge_intervals(_all_intervals(spark, d), ["entity_kind", "entity_key"], "s", "e")
    length, period = F.col("end_us") - F.col("start_us"), F.col("span_kind") == "period"
    return spans.groupBy("entity_kind", "entity_key").agg(
        F.count_if(period).alias("n_periods"), F.count_if(~period).alias("n_gaps"), F.sum(F.when(period, length).otherwise(0)).alias("covered_us"), F.sum(F.when(period, 0).otherwise(length)).alias("idle_us")
    )


_EVENT_SHAPE = {"blocks": ("blockname",), "edges": ("sourceblock", "targetblock"), "batches": ("batchid",), "journals": ("journalid",), "entries": ("entryid",)}
_SNAPSHOT_SHAPE = {"blocks": ("blockname",), "channels": ("sourceblock", "targetblock")}
_LISTS = frozenset({"edges", "batches", "journals", "entries"})
_TEXTS = frozenset({"triggerparamsjson"})


def _shredded(spark: SparkSession, d: str, kind: str, scalars: set[str] | None) -> DataFrame:
    keep = frozenset(scalars) if scalars is not None else None
    if kind == "flow_event":
        return shred(table(spark, d, "flow_event"), "id", "payload", Shape(_EVENT_SHAPE, _LISTS, _TEXTS, keep))
    return shred(table(spark, d, "flow_snapshot"), "flow_run_id", "snapshot_json", Shape(_SNAPSHOT_SHAPE, frozenset(), frozenset(), keep))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every object below blocks, edges, channels, batches, journals and entries, with its key and its parent's."""
    names = {x for shape in (_EVENT_SHAPE, _SNAPSHOT_SHAPE) for labels in shape.values() for x in labels}
    kinds = {"blocks": "block", "edges": "edge", "batches": "batch", "journals": "journal", "entries": "entry"}
    keys = {"block": ("blockName",), "source": ("sourceBlock",), "target": ("targetBlock",), "batch": ("batchId",), "journal": ("journalId",), "entry": ("entryId",)}
    link = F.concat(F.coalesce("source", F.lit("")), F.lit(">"), F.coalesce("target", F.lit("")))

    events = entity_table(_shredded(spark, d, "flow_event", names), kinds, keys)
    own = (
        F.when(F.col("kind") == "block", F.coalesce("block", "map_key"))
        .when(F.col("kind") == "edge", link)
        .when(F.col("kind") == "batch", F.col("batch"))
        .when(F.col("kind") == "journal", F.col("journal"))
        .otherwise(F.col("entry"))
    )
    # read four times below: kept, so that the documents are parsed once
    events = durable(events.select("record_id", "doc", "node", "owner", "kind", F.coalesce(own, F.lit("")).alias("node_key")))
    journals = with_owner(events.where("kind = 'journal'"), events.where("kind = 'batch'"), "node_key", "parent_key")
    under = journals.withColumn("path", F.concat_ws("/", F.coalesce("parent_key", F.lit("")), "node_key"))
    entries = with_owner(events.where("kind = 'entry'"), under, "path", "parent_key")
    flat = events.where("kind in ('block', 'edge', 'batch')").withColumn("parent_key", F.lit(""))
    columns = ["record_id", "kind", "parent_key", "node_key"]
    of_events = flat.select(*columns).unionByName(journals.select(*columns)).unionByName(entries.select(*columns)).withColumn("record_table", F.lit("flow_event"))

    snaps = entity_table(_shredded(spark, d, "flow_snapshot", names), {"blocks": "block", "channels": "channel"}, {k: keys[k] for k in ("block", "source", "target")})
    named = F.when(F.col("kind") == "block", F.coalesce("block", "map_key", F.lit(""))).otherwise(link)
    of_snaps = snaps.select("record_id", "kind", F.lit("").alias("parent_key"), named.alias("node_key"), F.lit("flow_snapshot").alias("record_table"))
    both = of_events.unionByName(of_snaps)
    return both.select("record_table", "record_id", F.col("kind").alias("node_kind"), F.coalesce("parent_key", F.lit("")).alias("parent_key"), "node_key").distinct()


def p2_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The whole adjacency tables, with every scalar: per record the nodes by kind. A map counts as an object."""
    both = _shredded(spark, d, "flow_event", None).withColumn("record_table", F.lit("flow_event")).unionByName(_shredded(spark, d, "flow_snapshot", None).withColumn("record_table", F.lit("flow_snapshot")))
    # copies of a record have equal nodes
    once = both.groupBy("record_table", "record_id", "doc", "node").agg(F.first("kind").alias("kind"))
    return once.groupBy("record_table", "record_id").agg(F.count_if(F.col("kind").isin("object", "map")).alias("n_objects"), F.count_if(F.col("kind") == "scalar").alias("n_scalars"))


def p2_entries(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of journal entries, linked to batch and journal."""
    nodes = _shredded(spark, d, "flow_event", {"batchid", "journalid", "journaltype", "entryid", "account", "amount"})
    kinds = {"batches": "batch", "journals": "journal", "entries": "entry"}
    table_ = entity_table(nodes, kinds, {"batch_id": ("batchId",), "journal_id": ("journalId",), "journal_type": ("journalType",), "entry_id": ("entryId",), "account": ("account",), "amount": ("amount",)})
    journals = with_owner(table_.where("kind = 'journal'").drop("batch_id"), table_.where("kind = 'batch'"), "batch_id", "batch_id")
    entries = table_.where("kind = 'entry'").select("record_id", "doc", "node", "owner", "ordinal", "entry_id", "account", "amount")
    above = journals.select("record_id", "doc", F.col("node").alias("owner"), "batch_id", "journal_id", "journal_type")
    joined = entries.join(above, ["record_id", "doc", "owner"], "left")
    return joined.select(F.col("record_id").cast("bigint").alias("event_id"), "batch_id", "journal_id", "journal_type", "entry_id", "ordinal", "account", F.expr("try_cast(amount as decimal(18,2))").alias("amount")).distinct()


def p2_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of the snapshots' blocks."""
    nodes = _shredded(spark, d, "flow_snapshot", {"blockname", "blocktype", "state", "itemsconsumed", "itemsproduced", "issource"})
    blocks = entity_table(nodes, {"blocks": "block"}, {"block_name": ("blockName",), "block_type": ("blockType",), "state": ("state",), "consumed": ("itemsConsumed",), "produced": ("itemsProduced",)})
    return blocks.select(F.col("record_id").alias("flow_run_id"), F.coalesce("block_name", "map_key").alias("block_name"), "block_type", "state", F.expr("try_cast(consumed as bigint)").alias("items_consumed"), F.expr("try_cast(produced as bigint)").alias("items_produced")).distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The customers and lanes that stand in at least one twentieth of their table's rows."""
    one = dominating_values(table(spark, d, "invoice"), "customer").select(F.lit("customer").alias("field"), "key_value")
    return one.unionByName(dominating_values(table(spark, d, "payment"), "processor_lane").select(F.lit("processor_lane").alias("field"), "key_value"))


def p4_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows and amounts per customer and per lane, as delivered (repeated deliveries count)."""
    one = key_totals(table(spark, d, "invoice"), "customer", "amount").withColumn("field", F.lit("customer"))
    return one.unionByName(key_totals(table(spark, d, "payment"), "processor_lane", "gross_amount").withColumn("field", F.lit("processor_lane")))


def p4_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quartiles of the amounts per customer and per lane."""
    probs = [0.25, 0.5, 0.75]
    one = key_quantiles(table(spark, d, "invoice"), "customer", "amount", probs).withColumn("field", F.lit("customer"))
    return one.unionByName(key_quantiles(table(spark, d, "payment"), "processor_lane", "gross_amount", probs).withColumn("field", F.lit("processor_lane")))


_SERIES = ["flow_run_id", "source_block", "target_block"]


def _readings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "channel_stats").select(*_SERIES, micros("timestamp").alias("at_us"), "current_count")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The ten-second slots without a reading between a series' first and last reading."""
    return regular_grid(_readings(spark, d), _SERIES, "at_us", "current_count", SLOT_US, GAP_LIMIT_US).where("status != 'observed'").select(*_SERIES, "slot_us")


def p5_grid(spark: SparkSession, d: str) -> DataFrame:
    """The whole grid: observed slots, slots filled by interpolation, slots marked as gaps."""
    return regular_grid(_readings(spark, d), _SERIES, "at_us", "current_count", SLOT_US, GAP_LIMIT_US)


QUERIES = {f.__name__: f for f in (p1_found, p1_coverage, p2_found, p2_nodes, p2_entries, p2_blocks, p4_found, p4_totals, p4_quantiles, p5_found, p5_grid)}

_P1_SPANS = """
WITH rows_ AS (
  SELECT 'work_item' AS entity_kind, correlation_id AS entity_key, epoch_us(started_at) AS s, epoch_us(completed_at) AS e FROM flow_summary
  UNION ALL SELECT 'run', flow_run_id, epoch_us(start_time), epoch_us(end_time) FROM block_snapshot
), ok AS (SELECT * FROM rows_ WHERE entity_key IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL AND e >= s),
high AS (SELECT *, max(e) OVER (PARTITION BY entity_kind, entity_key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ok),
marked AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY entity_kind, entity_key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM high),
periods AS (SELECT entity_kind, entity_key, island, min(s) AS start_us, max(e) AS end_us FROM marked GROUP BY ALL),
following AS (SELECT *, lead(start_us) OVER (PARTITION BY entity_kind, entity_key ORDER BY island) AS next_us FROM periods),
spans AS (SELECT entity_kind, entity_key, 'period' AS span_kind, start_us, end_us FROM periods
  UNION ALL SELECT entity_kind, entity_key, 'gap', end_us, next_us FROM following WHERE next_us IS NOT NULL)
"""
_P5_GRID = """
WITH r AS (SELECT DISTINCT flow_run_id, source_block, target_block, epoch_us("timestamp") AS t, current_count::DOUBLE AS v FROM channel_stats
  WHERE flow_run_id IS NOT NULL AND source_block IS NOT NULL AND target_block IS NOT NULL AND current_count IS NOT NULL AND "timestamp" IS NOT NULL),
counts AS (SELECT flow_run_id, source_block, target_block, (epoch_us("timestamp") // 10000000) * 10000000 AS slot_us, count(*) AS n FROM channel_stats
  WHERE flow_run_id IS NOT NULL AND source_block IS NOT NULL AND target_block IS NOT NULL AND current_count IS NOT NULL AND "timestamp" IS NOT NULL GROUP BY ALL),
s AS (SELECT flow_run_id, source_block, target_block, (t // 10000000) * 10000000 AS slot_us, min({'t': t, 'v': v}) AS f, max({'t': t, 'v': v}) AS l FROM r GROUP BY ALL),
p AS (SELECT *, lead(slot_us) OVER w AS next_us, lead(f) OVER w AS nf FROM s WINDOW w AS (PARTITION BY flow_run_id, source_block, target_block ORDER BY slot_us)),
missing AS (SELECT *, unnest(generate_series(slot_us + 10000000, next_us - 10000000, 10000000)) AS at_us FROM p WHERE next_us > slot_us + 10000000)
"""
NESTED = r"""
WITH RECURSIVE raw AS (SELECT DISTINCT 'flow_event' AS record_table, id::VARCHAR AS record_id, payload AS t FROM flow_event WHERE id IS NOT NULL AND payload IS NOT NULL
  UNION ALL SELECT DISTINCT 'flow_snapshot', flow_run_id, snapshot_json FROM flow_snapshot WHERE flow_run_id IS NOT NULL AND snapshot_json IS NOT NULL),
good AS (SELECT record_table, record_id, t FROM raw WHERE json_valid(t)),
-- JSON text inside JSON strings
open_ AS (SELECT record_table, record_id, t FROM good
  UNION ALL SELECT record_table, record_id, t FROM (SELECT record_table, record_id, json_extract_string(t, '$') AS t FROM open_ WHERE json_type(t) = 'VARCHAR') WHERE json_valid(t)),
docs AS (SELECT row_number() OVER () AS doc, record_table, record_id, t FROM open_ WHERE json_type(t) IN ('OBJECT', 'ARRAY')),
outer_ AS (SELECT doc, 0 AS tree, x.id AS node, x.parent, x.key, x.type, x.value, x.atom FROM docs, json_tree(docs.t) x),
texts AS (SELECT doc, node AS tree, parent AS above, json_extract_string(value, '$') AS t FROM outer_ WHERE lower(key) = 'triggerparamsjson' AND type = 'VARCHAR'),
inner_ AS (SELECT doc, tree, x.id AS node, x.parent, x.key, x.type, x.value, x.atom FROM (SELECT * FROM texts WHERE json_valid(t)) i, json_tree(i.t) x),
n AS (SELECT * FROM outer_ UNION ALL SELECT * FROM inner_),
kinds AS (SELECT * FROM (VALUES ('flow_event', 'blocks', 'block'), ('flow_event', 'edges', 'edge'), ('flow_event', 'batches', 'batch'), ('flow_event', 'journals', 'journal'), ('flow_event', 'entries', 'entry'), ('flow_snapshot', 'blocks', 'block'), ('flow_snapshot', 'channels', 'channel')) k(record_table, label, kind)),
named AS (SELECT doc, tree, parent, max(json_extract_string(value, '$')) FILTER (lower(key) = 'blockname') AS block, max(json_extract_string(value, '$')) FILTER (lower(key) = 'sourceblock') AS source, max(json_extract_string(value, '$')) FILTER (lower(key) = 'targetblock') AS target,
  max(json_extract_string(value, '$')) FILTER (lower(key) = 'batchid') AS batch, max(json_extract_string(value, '$')) FILTER (lower(key) = 'journalid') AS journal, max(json_extract_string(value, '$')) FILTER (lower(key) = 'entryid') AS entry, max(json_extract_string(value, '$')) FILTER (lower(key) = 'journaltype') AS journal_type, max(json_extract_string(value, '$')) FILTER (lower(key) = 'account') AS account, max(json_extract_string(value, '$')) FILTER (lower(key) = 'amount') AS amount, max(json_extract_string(value, '$')) FILTER (lower(key) = 'blocktype') AS block_type, max(json_extract_string(value, '$')) FILTER (lower(key) = 'state') AS state, max(json_extract_string(value, '$')) FILTER (lower(key) = 'itemsconsumed') AS consumed, max(json_extract_string(value, '$')) FILTER (lower(key) = 'itemsproduced') AS produced
  FROM n WHERE type NOT IN ('OBJECT', 'ARRAY', 'NULL') GROUP BY doc, tree, parent),
boxes AS (SELECT n.doc, n.tree, n.node, n.parent, n.type, k.kind, m.block, m.source, m.target FROM n JOIN docs d ON d.doc = n.doc JOIN kinds k ON k.record_table = d.record_table AND k.label = lower(n.key)
  LEFT JOIN named m ON m.doc = n.doc AND m.tree = n.tree AND m.parent = n.node WHERE n.type IN ('OBJECT', 'ARRAY')),
single AS (SELECT doc, tree, node, kind, NULL AS map_key, 0 AS ordinal, parent AS above FROM boxes WHERE type = 'OBJECT' AND (kind IN ('edge', 'batch', 'journal', 'entry') OR (kind = 'block' AND block IS NOT NULL) OR (kind = 'channel' AND (source IS NOT NULL OR target IS NOT NULL)))),
many AS (SELECT n.doc, n.tree, n.node, b.kind, CASE WHEN b.type = 'OBJECT' THEN n.key END AS map_key, CASE WHEN b.type = 'ARRAY' THEN n.key::INT END AS ordinal, b.parent AS above FROM boxes b JOIN n ON n.doc = b.doc AND n.tree = b.tree AND n.parent = b.node
  WHERE n.type = 'OBJECT' AND NOT EXISTS (FROM single s WHERE s.doc = b.doc AND s.tree = b.tree AND s.node = b.node)),
found AS (SELECT f.*, m.block, m.source, m.target, m.batch, m.journal, m.entry, m.journal_type, m.account, m.amount, m.block_type, m.state, m.consumed, m.produced FROM (SELECT * FROM single UNION ALL SELECT * FROM many) f LEFT JOIN named m ON m.doc = f.doc AND m.tree = f.tree AND m.parent = f.node),
keyed AS (SELECT *, coalesce(CASE kind WHEN 'block' THEN coalesce(block, map_key) WHEN 'batch' THEN batch WHEN 'journal' THEN journal WHEN 'entry' THEN entry ELSE coalesce(source, '') || '>' || coalesce(target, '') END, '') AS node_key FROM found)
"""
ORACLE = {
    "p1_found": _P1_SPANS + "SELECT entity_kind, entity_key, span_kind, start_us, end_us FROM spans",
    "p1_coverage": _P1_SPANS
    + """SELECT entity_kind, entity_key, count(*) FILTER (span_kind = 'period') AS n_periods, count(*) FILTER (span_kind = 'gap') AS n_gaps,
  coalesce(sum(end_us - start_us) FILTER (span_kind = 'period'), 0)::BIGINT AS covered_us, coalesce(sum(end_us - start_us) FILTER (span_kind = 'gap'), 0)::BIGINT AS idle_us FROM spans GROUP BY ALL""",
    "p2_found": NESTED + """, journals AS (SELECT j.doc, j.tree, j.node, b.node_key AS batch_key, j.node_key FROM keyed j LEFT JOIN keyed b ON b.doc = j.doc AND b.tree = j.tree AND b.node = j.above AND b.kind = 'batch' WHERE j.kind = 'journal')
SELECT DISTINCT d.record_table, d.record_id, k.kind AS node_kind, CASE k.kind WHEN 'journal' THEN coalesce(j.batch_key, '') WHEN 'entry' THEN coalesce(coalesce(o.batch_key, '') || '/' || o.node_key, '') ELSE '' END AS parent_key, k.node_key
FROM keyed k JOIN docs d ON d.doc = k.doc LEFT JOIN journals j ON j.doc = k.doc AND j.tree = k.tree AND j.node = k.node LEFT JOIN journals o ON o.doc = k.doc AND o.tree = k.tree AND o.node = k.above""",
    "p2_nodes": NESTED
    + """, a AS (SELECT d.record_table, d.record_id, n.type FROM n JOIN docs d ON d.doc = n.doc LEFT JOIN texts t ON t.doc = n.doc AND n.tree = 0 AND t.tree = n.node AND json_valid(t.t) AND json_type(t.t) <> 'NULL'
  WHERE t.doc IS NULL OR d.record_table <> 'flow_event')
SELECT record_table, record_id, count(*) FILTER (type = 'OBJECT') AS n_objects, count(*) FILTER (type NOT IN ('OBJECT', 'ARRAY')) AS n_scalars FROM a GROUP BY 1, 2""",
    "p2_entries": NESTED
    + """SELECT DISTINCT d.record_id::BIGINT AS event_id, b.batch AS batch_id, j.journal AS journal_id, j.journal_type, e.entry AS entry_id, e.ordinal, e.account, try_cast(e.amount AS DECIMAL(18,2)) AS amount
  FROM keyed e JOIN docs d ON d.doc = e.doc LEFT JOIN keyed j ON j.doc = e.doc AND j.tree = e.tree AND j.node = e.above AND j.kind = 'journal'
  LEFT JOIN keyed b ON b.doc = j.doc AND b.tree = j.tree AND b.node = j.above AND b.kind = 'batch' WHERE e.kind = 'entry' AND d.record_table = 'flow_event'""",
    "p2_blocks": NESTED
    + """SELECT DISTINCT d.record_id AS flow_run_id, coalesce(block, map_key) AS block_name, block_type, state, try_cast(consumed AS BIGINT) AS items_consumed, try_cast(produced AS BIGINT) AS items_produced
  FROM keyed k JOIN docs d ON d.doc = k.doc WHERE k.kind = 'block' AND d.record_table = 'flow_snapshot'""",
    "p4_found": """SELECT 'customer' AS field, customer AS key_value FROM invoice WHERE customer <> '' GROUP BY customer HAVING count(*) * 20 >= (SELECT count(*) FROM invoice)
  UNION ALL SELECT 'processor_lane', processor_lane FROM payment WHERE processor_lane <> '' GROUP BY processor_lane HAVING count(*) * 20 >= (SELECT count(*) FROM payment)""",
    "p4_totals": """SELECT 'customer' AS field, customer AS key_value, count(*) AS n_rows, count(amount) AS n_values, sum(amount)::DECIMAL(28,2) AS total, min(amount) AS least, max(amount) AS greatest FROM invoice GROUP BY customer
  UNION ALL SELECT 'processor_lane', processor_lane, count(*), count(gross_amount), sum(gross_amount)::DECIMAL(28,2), min(gross_amount), max(gross_amount) FROM payment GROUP BY processor_lane""",
    "p4_quantiles": """SELECT 'customer' AS field, customer AS key_value, p AS prob, (list(amount ORDER BY amount))[greatest(1, ceil(p * count(*)))::INT] AS quantile, count(*) AS n_values
  FROM invoice, (SELECT unnest([0.25::DOUBLE, 0.5, 0.75]) AS p) WHERE customer IS NOT NULL AND amount IS NOT NULL GROUP BY customer, p
  UNION ALL SELECT 'processor_lane', processor_lane, p, (list(gross_amount ORDER BY gross_amount))[greatest(1, ceil(p * count(*)))::INT], count(*)
  FROM payment, (SELECT unnest([0.25::DOUBLE, 0.5, 0.75]) AS p) WHERE processor_lane IS NOT NULL AND gross_amount IS NOT NULL GROUP BY processor_lane, p""",
    "p5_found": _P5_GRID + "SELECT flow_run_id, source_block, target_block, at_us AS slot_us FROM missing",
    "p5_grid": _P5_GRID
    + """SELECT flow_run_id, source_block, target_block, s.slot_us, n AS n_readings, l.v AS value, 'observed' AS status FROM s JOIN counts USING (flow_run_id, source_block, target_block, slot_us)
  UNION ALL SELECT flow_run_id, source_block, target_block, at_us, 0, CASE WHEN nf.t - l.t <= 60000000 THEN l.v + (nf.v - l.v) * (at_us - l.t) / (nf.t - l.t) END, CASE WHEN nf.t - l.t <= 60000000 THEN 'interpolated' ELSE 'gap' END FROM missing""",
}
