"""Queries on row operators, batches and rate limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scalars
from millrace.operators import batching, ratelimit, rowops, routing
from millrace.operators.aggregates import count_and_total, running_totals
from millrace.sources.readers import read_after, read_changes
from millrace.sources.tables import micros, table

DAY_US = 86_400_000_000


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def filter_predicate(spark, d):
    """A predicate that reaches the scan."""
    return rowops.filter_rows(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice > 200000")


def _configured(operator: str, column: str, value, name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return rowops.filter_rows(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey"), rowops.FilterConfig(column, operator, value))

    query.__doc__, query.__name__ = f"C9: the configured filter {operator}.", name
    return query


def select_columns(spark, d):
    """C10."""
    return rowops.select_columns(table(spark, d, "lineitem"), "l_orderkey", "l_quantity", "l_returnflag")


def select_rename(spark, d):
    """C11."""
    return rowops.select_rename(table(spark, d, "lineitem"), {"l_orderkey": "order_key", "l_shipdate": "shipped"})


def derive_columns(spark, d):
    """Derived columns, a mask, a column removed, in one stage."""
    net = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_quantity")
    return rowops.transform_rows(rows, lambda df: rowops.derive(df, {"net": net.cast("decimal(18,4)"), "is_bulk": F.col("l_quantity") > 25}, ("l_discount",)))


def flat_map_project(spark, d):
    """Each event id 0 to 2 times."""
    items = F.expr("case when event_id % 3 = 0 then array() else sequence(1, cast(event_id % 3 as int)) end")
    return rowops.flat_map(_events(spark, d).select("event_id"), items, "item")


def _validated(spark, d) -> DataFrame:
    return rowops.enrich(rowops.validate(_events(spark, d).select("event_id", "props", "ts"), "event_id", "props"), "event_id")


def validate_enrich(spark, d):
    """C14, C15."""
    return _validated(spark, d).select("event_id", "is_valid", "category", "value")


def invoice_payments(spark, d):
    """Types by key, tax by type with half-even rounding, routed and merged."""
    i = F.col("o_orderkey") % 10
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.when(i < 4, "standard").when(i < 7, "premium").otherwise("international").alias("type"))
    rows = routing.route_static(rows, F.col("type"), ["standard", "premium", "international"])

    def taxed(rate: str):
        tax = scalars.round_even(F.col("amount") * F.lit(rate).cast("decimal(4,2)"), 2).cast("decimal(18,2)")
        return lambda df: df.withColumn("tax", tax).withColumn("gross", (F.col("amount") + F.col("tax")).cast("decimal(18,2)"))

    merged = routing.merge_routes(rows, {"standard": taxed("0.20"), "premium": taxed("0.15"), "international": taxed("0.00")})
    return merged.select("o_orderkey", "type", F.upper("type").alias("lane"), "tax", "gross")


def etl_batch_aggregate(spark, d):
    """Validate, enrich, route TypeB, batches of 100, count and total per batch and category."""
    rows = routing.route_static(_validated(spark, d).where("is_valid"), F.col("category"), ["TypeA", "TypeB", "TypeC"]).where("route = 'TypeB'")
    batches = batching.batch_by_size(rows.select("event_id", "category", "value"), 100, ["event_id"])
    return count_and_total(batches, ["batch_id", "category"], "value").select("batch_id", "category", "n_rows", F.col("total_value").cast("decimal(38,2)").alias("total_value"))


def metrics_totals(spark, d):
    """Rows and hundredths over all enriched events."""
    return running_totals(_validated(spark, d), "value")


def _cents(name: str = "value"):
    return F.sum(F.col(name).cast("decimal(18,2)")).cast("decimal(38,2)")


def batch_by_size(spark, d):
    """Batches of 100 by id."""
    rows = batching.batch_by_size(_events(spark, d).select("event_id", "value"), 100, ["event_id"])
    return rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), _cents().alias("total"))


def batch_items(spark, d):
    """The batches as arrays; their length, first and last item."""
    rows = batching.collect_batches(batching.batch_by_size(_events(spark, d).select("event_id", "event_type"), 100, ["event_id"]), ["batch_id"], ["event_id"])
    return rows.select("batch_id", F.size("items").cast("bigint").alias("n"), F.col("items")[0]["event_type"].alias("first_type"), F.element_at("items", -1)["event_id"].alias("last_id"))


def batch_by_size_or_tick(spark, d):
    """A tick every hour from the first event on, and at most 5 events a batch."""
    rows = batching.batch_by_size_or_tick(_events(spark, d).select("event_id", micros("ts").alias("us")), 5, "us", 3_600_000_000)
    return rows.groupBy("tick", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def epoch_batch(spark, d):
    """Batches of 50 within epochs of one day."""
    rows = batching.epoch_batch(_events(spark, d).select("event_id", "ts"), 50, F.to_date("ts"), ["event_id"])
    return rows.groupBy("epoch_seq", "batch_no").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def partition_row_ranges(spark, d):
    """Seven contiguous ranges of parts."""
    rows = batching.row_ranges(table(spark, d, "part").select("p_partkey"), 7, ["p_partkey"])
    return rows.groupBy("part_no").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_key"), F.max("p_partkey").alias("last_key"))


def accumulate_chunks(spark, d):
    """Days as chunks, put together until they hold a thousand events."""
    rows = _events(spark, d).select(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return batching.accumulate_chunks(rows, "day", 1000)


def rate_fixed_window(spark, d):
    """Three permits an hour."""
    rows = _events(spark, d).select("event_id", F.expr("unix_micros(cast(ts as timestamp)) div 3600000000").alias("a"))
    return ratelimit.release_windows(rows, "a", ["event_id"], 3).select("event_id", "release")


def rate_sliding_window(spark, d):
    """Three permits in any four quarters of an hour."""
    rows = _events(spark, d).select("event_id", F.expr("unix_micros(cast(ts as timestamp)) div 900000000").alias("a"))
    return ratelimit.release_windows(rows, "a", ["event_id"], 3, 4).select("event_id", "release")


def rate_reject(spark, d):
    """Without a queue, the first three events of each type and hour are accepted, the others rejected."""
    rows = _events(spark, d).select("event_id", "event_type", F.expr("unix_micros(cast(ts as timestamp)) div 3600000000").alias("hour"))
    return ratelimit.reject_beyond(rows, "hour", ["event_id"], 3, ["event_type"]).select("event_id", "accepted")


def token_bucket(spark, d):
    """Per user a bucket of 5 tokens with 2 more each day."""
    rows = _events(spark, d).select("event_id", "user_id", F.expr(f"unix_micros(cast(ts as timestamp)) div {DAY_US}").alias("day"))
    return ratelimit.token_bucket(rows, "day", ["event_id"], 5, 2, ["user_id"]).select("event_id", "user_id", "release")


def incremental_read(spark, d):
    """Versions after 10, up to one that is beyond the latest."""
    rows = _events(spark, d).select("event_id", "event_type", F.expr("event_id div 100 + 1").alias("commit_version"))
    return read_changes(rows, "commit_version", 10, 10**9)


def anchored_read(spark, d):
    """Events after the anchor 0 in epochs of 64."""
    rows = read_after(_events(spark, d).select("event_id"), "event_id", 0, 64)
    return rows.groupBy("epoch_seq").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("anchor"))


def describe_numeric(spark, d):
    """Rounded, as sums of doubles depend on the order of the rows."""
    made = rowops.describe(table(spark, d, "lineitem").select("l_quantity", "l_discount"), ["l_quantity", "l_discount"])
    return made.withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


def envelope_map(spark, d):
    """Purchases as data mapped by a function, other events as control signals passed through."""
    e = _events(spark, d)
    data = rowops.to_envelope(e.where("event_id % 10 != 0"), F.col("value").cast("decimal(18,2)"))
    signals = e.where("event_id % 10 = 0").select(F.struct(F.lit("barrier").alias("kind"), F.lit(None).cast("decimal(18,2)").alias("value"), F.col("event_id").alias("signal_id"), F.col("ts").alias("signal_ts")).alias("envelope"))
    both = rowops.map_data(data.unionByName(signals), lambda v: (v * 2).cast("decimal(18,2)"))
    return both.groupBy(F.col("envelope.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("envelope.value").cast("decimal(38,2)").alias("total"), F.max("envelope.signal_id").alias("last_signal"))


def trigger_parameters(spark, d):
    """Typed parameters from JSON, with a default where they are absent or of another type."""
    rows = _events(spark, d).select("event_id", scalars.parameter(F.col("props"), "k", "bigint", F.lit(-1).cast("bigint")).alias("k"), scalars.parameter(F.col("props"), "missing", "int", F.lit(7)).alias("missing"))
    return rows.groupBy("k", "missing").agg(F.count(F.lit(1)).alias("n"))


_FILTERS = {
    "filter_config_greater": _configured("GreaterThan", "o_custkey", 1000, "filter_config_greater"),
    "filter_config_less": _configured("LessThan", "o_custkey", 100, "filter_config_less"),
    "filter_config_equals": _configured("Equals", "o_orderstatus", "F", "filter_config_equals"),
    "filter_config_not_equals": _configured("NotEquals", "o_orderstatus", "F", "filter_config_not_equals"),
    "filter_config_contains": _configured("Contains", "o_orderpriority", "URGENT", "filter_config_contains"),
}
QUERIES = {
    f.__name__: f
    for f in (etl_batch_aggregate, filter_predicate, select_columns, select_rename, derive_columns, flat_map_project, validate_enrich, invoice_payments, metrics_totals, batch_by_size, batch_items, batch_by_size_or_tick, epoch_batch,
              partition_row_ranges, accumulate_chunks, rate_fixed_window, rate_sliding_window, rate_reject, token_bucket, incremental_read, anchored_read, describe_numeric, envelope_map, trigger_parameters)
} | _FILTERS

_ENRICHED = """WITH v AS (SELECT event_id, ts, coalesce(length(props), 0) > 0 AND event_id >= 0 AS is_valid,
  CASE event_id % 3 WHEN 0 THEN 'TypeA' WHEN 1 THEN 'TypeB' ELSE 'TypeC' END AS category, ((event_id % 1000)::DECIMAL(18,2) / 10)::DECIMAL(18,2) AS value FROM events) """
_FILTER_SQL = "SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey FROM orders WHERE "


def _limiter(unit_us: int, segments: int) -> str:
    return f"""WITH a AS (SELECT event_id, epoch_us(ts) // {unit_us} AS a, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events)
SELECT event_id, ({segments} * (i // 3) + max(a - {segments} * (i // 3)) OVER (PARTITION BY i % 3 ORDER BY i ROWS UNBOUNDED PRECEDING))::BIGINT AS release FROM a"""


ORACLE = {
    "rate_reject": "SELECT event_id, row_number() OVER (PARTITION BY event_type, epoch_us(ts) // 3600000000 ORDER BY event_id) <= 3 AS accepted FROM events",
    "filter_predicate": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000",
    "filter_config_greater": _FILTER_SQL + "o_custkey > 1000",
    "filter_config_less": _FILTER_SQL + "o_custkey < 100",
    "filter_config_equals": _FILTER_SQL + "o_orderstatus = 'F'",
    "filter_config_not_equals": _FILTER_SQL + "o_orderstatus <> 'F'",
    "filter_config_contains": _FILTER_SQL + "contains(o_orderpriority, 'URGENT')",
    "select_columns": "SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem",
    "select_rename": "SELECT l_orderkey AS order_key, l_shipdate AS shipped FROM lineitem",
    "derive_columns": "SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, (l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(4,2)))::DECIMAL(18,4) AS net, l_quantity > 25 AS is_bulk FROM lineitem",
    "flat_map_project": "SELECT event_id, unnest(generate_series(1, (event_id % 3)::INT))::INT AS item FROM events WHERE event_id % 3 > 0",
    "validate_enrich": _ENRICHED + "SELECT event_id, is_valid, category, value FROM v",
    "invoice_payments": """WITH p AS (SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS amount, CASE WHEN o_orderkey % 10 < 4 THEN 'standard' WHEN o_orderkey % 10 < 7 THEN 'premium' ELSE 'international' END AS type FROM orders),
t AS (SELECT *, CASE type WHEN 'standard' THEN 0.20::DECIMAL(4,2) WHEN 'premium' THEN 0.15::DECIMAL(4,2) ELSE 0.00::DECIMAL(4,2) END AS rate FROM p),
x AS (SELECT *, round_even((amount * rate)::DECIMAL(22,4), 2)::DECIMAL(18,2) AS tax FROM t) SELECT o_orderkey, type, upper(type) AS lane, tax, (amount + tax)::DECIMAL(18,2) AS gross FROM x""",
    "etl_batch_aggregate": _ENRICHED + """, b AS (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 100 + 1 AS batch_id FROM v WHERE is_valid AND category = 'TypeB')
SELECT batch_id, category, count(*) AS n_rows, sum(value)::DECIMAL(38,2) AS total_value FROM b GROUP BY ALL""",
    "metrics_totals": _ENRICHED + "SELECT count(*) AS n_rows, coalesce(sum(trunc(value * 100)::BIGINT), 0)::BIGINT AS total_hundredths FROM v",
    "batch_by_size": """WITH b AS (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 100 + 1 AS batch_id FROM events)
SELECT batch_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, sum(value::DECIMAL(18,2))::DECIMAL(38,2) AS total FROM b GROUP BY batch_id""",
    "batch_items": """WITH b AS (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 100 + 1 AS batch_id FROM events)
SELECT batch_id, count(*) AS n, arg_min(event_type, event_id) AS first_type, max(event_id) AS last_id FROM b GROUP BY batch_id""",
    "batch_by_size_or_tick": """WITH t AS (SELECT event_id, epoch_us(ts) AS us, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 3600000000 AS tick FROM events),
c AS (SELECT *, (row_number() OVER (PARTITION BY tick ORDER BY us) - 1) // 5 AS chunk FROM t) SELECT tick, chunk, count(*) AS n, min(event_id) AS first_id FROM c GROUP BY ALL""",
    "epoch_batch": """WITH c AS (SELECT event_id, CASE WHEN ts::DATE IS DISTINCT FROM lag(ts::DATE) OVER (ORDER BY event_id) THEN 1 ELSE 0 END AS x FROM events),
e AS (SELECT event_id, sum(x) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS epoch_seq FROM c),
b AS (SELECT *, (row_number() OVER (PARTITION BY epoch_seq ORDER BY event_id) - 1) // 50 + 1 AS batch_no FROM e) SELECT epoch_seq, batch_no, count(*) AS n, min(event_id) AS first_id FROM b GROUP BY ALL""",
    "partition_row_ranges": """WITH r AS (SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // (SELECT (count(*) + 6) // 7 FROM part) AS part_no FROM part)
SELECT part_no, count(*) AS n, min(p_partkey) AS first_key, max(p_partkey) AS last_key FROM r GROUP BY part_no""",
    "accumulate_chunks": """WITH RECURSIVE s AS (SELECT chunk, n_rows, row_number() OVER (ORDER BY chunk) AS i FROM (SELECT strftime(ts, '%Y-%m-%d') AS chunk, count(*) AS n_rows FROM events GROUP BY 1)),
g AS (SELECT i, chunk, n_rows, 1::BIGINT AS emit_no, n_rows AS held FROM s WHERE i = 1
  UNION ALL SELECT s.i, s.chunk, s.n_rows, CASE WHEN g.held >= 1000 THEN g.emit_no + 1 ELSE g.emit_no END, CASE WHEN g.held >= 1000 THEN s.n_rows ELSE g.held + s.n_rows END FROM g JOIN s ON s.i = g.i + 1)
SELECT chunk, n_rows, emit_no FROM g""",
    "rate_fixed_window": _limiter(3_600_000_000, 1),
    "rate_sliding_window": _limiter(900_000_000, 4),
    "token_bucket": f"""WITH a AS (SELECT event_id, user_id, epoch_us(ts) // {DAY_US} AS a, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events)
SELECT x.event_id, x.user_id, max(y.a + greatest(0, ceil((x.i - y.i + 1 - 5) / 2.0)))::BIGINT AS release FROM a x JOIN a y ON x.user_id = y.user_id AND y.i <= x.i GROUP BY x.event_id, x.user_id""",
    "incremental_read": "SELECT event_id, event_type, event_id // 100 + 1 AS commit_version, 'VersionDiffFallback' AS strategy FROM events WHERE event_id // 100 + 1 > 10",
    "anchored_read": """WITH b AS (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 64 + 1 AS epoch_seq FROM events WHERE event_id > 0)
SELECT epoch_seq, count(*) AS n, max(event_id) AS anchor FROM b GROUP BY epoch_seq""",
    "describe_numeric": """SELECT 'l_quantity' AS column_name, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, min(l_quantity) AS least, max(l_quantity) AS greatest FROM lineitem
UNION ALL SELECT 'l_discount', count(l_discount), round(avg(l_discount), 6), round(stddev_samp(l_discount), 6), min(l_discount), max(l_discount) FROM lineitem""",
    "envelope_map": """SELECT CASE WHEN event_id % 10 = 0 THEN 'barrier' ELSE 'data' END AS kind, count(*) AS n,
  sum(CASE WHEN event_id % 10 <> 0 THEN (value::DECIMAL(18,2) * 2)::DECIMAL(18,2) END)::DECIMAL(38,2) AS total, max(CASE WHEN event_id % 10 = 0 THEN event_id END) AS last_signal FROM events GROUP BY 1""",
    "trigger_parameters": "SELECT coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, 7 AS missing, count(*) AS n FROM events GROUP BY ALL",
}
