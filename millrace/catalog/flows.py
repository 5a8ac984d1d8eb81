"""Queries on fan-out, fan-in, routing, grouping and joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import aggregates, joins, routing, topology
from millrace.operators.ordered import numbered_within
from millrace.operators.rowops import FilterConfig, filter_rows
from millrace.plans.flows import build_flow, standard_registry
from millrace.sources.sinks import chunk_log
from millrace.sources.tables import table

TYPES = ["click", "error", "purchase", "signup", "view"]


def _money(c: str):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("decimal(38,2)")


def broadcast_fanout_counts(spark, d):
    """Three branches each see all orders."""
    branches = topology.broadcast_to(table(spark, d, "orders").select("o_orderstatus"), {
        "all": lambda df: df, "open": lambda df: df.where("o_orderstatus = 'O'"), "done": lambda df: df.where("o_orderstatus = 'F'")})
    return topology.fan_in(*(b.agg(F.count(F.lit(1)).alias("n")).withColumn("branch", F.lit(name)) for name, b in branches.items()))


def competing_assignment(spark, d):
    """Each order to one of four consumers."""
    rows = topology.assign_competing(table(spark, d, "orders").select("o_orderkey"), 4, F.col("o_orderkey"))
    return rows.groupBy("consumer").agg(F.count(F.lit(1)).alias("n"))


def round_robin_per_user(spark, d):
    """Each user's events in turn to three consumers."""
    rows = topology.round_robin(table(spark, d, "events").select("event_id", "user_id"), 3, ["event_id"], ["user_id"])
    return rows.select("event_id", "consumer")


def fan_in_union(spark, d):
    """Customers and suppliers as one stream."""
    return topology.fan_in(
        table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind")),
        table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind")),
    )


def row_concat(spark, d):
    """Orders of two price bands, one after the other; one lacks a column."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return topology.fan_in(orders.where("o_totalprice > 300000"), orders.where("o_totalprice < 50000").drop("o_orderstatus"), allow_missing=True)


def column_merge(spark, d):
    """H2: two branches of the orders merged by key; both have a column ``v``."""
    orders = table(spark, d, "orders")
    left = orders.select("o_orderkey", F.col("o_orderstatus").alias("v"), "o_custkey")
    right = orders.where("o_orderstatus != 'O'").select("o_orderkey", F.col("o_orderpriority").alias("v"))
    return topology.column_merge(left, right, "o_orderkey")


def dedup_global(spark, d):
    """The first line item of each order and line number by all columns."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return topology.dedup(line, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"])


def dedup_in_chunk(spark, d):
    """The first event of each user within each chunk of a thousand."""
    rows = table(spark, d, "events").select(F.expr("event_id div 1000").alias("chunk"), "user_id", "event_id")
    return topology.dedup(rows, ["user_id"], ["event_id"], within=["chunk"])


def control_broadcast(spark, d):
    """Data to its route, every hundredth event as a control signal to all."""
    e = table(spark, d, "events").select("event_id", "event_type")
    rows = topology.control_to_all(e.where("event_id % 100 != 0"), e.where("event_id % 100 = 0"), F.col("event_type"), TYPES)
    return rows.groupBy("target").agg(F.count(F.lit(1)).alias("n"))


def set_operations(spark, d):
    """E15, an addition: customers with and without orders."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return topology.fan_in(c.intersect(o).withColumn("side", F.lit("both")), c.exceptAll(o.distinct()).withColumn("side", F.lit("customer only")))


def _by_type(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value")


#: Static routes are named in the plan, so their number is bounded.
MOST_ROUTES = 10_000


def _routes(spark, d):
    """The event types at hand: a list of at most MOST_ROUTES; more fail."""
    found = [r[0] for r in _by_type(spark, d).select("event_type").where("event_type is not null").distinct().limit(MOST_ROUTES + 1).collect()]
    if len(found) > MOST_ROUTES:
        raise ValueError(f"more than {MOST_ROUTES} static routes")
    return sorted(found)


def route_static(spark, d):
    """known routes; another key would fail."""
    rows = routing.route_static(_by_type(spark, d), F.col("event_type"), _routes(spark, d))
    return rows.groupBy("route").agg(F.count(F.lit(1)).alias("n"), _money("value").alias("total"))


def route_tag_filter(spark, d):
    """two routes are kept, other rows vanish."""
    return routing.tag_and_filter(_by_type(spark, d), F.col("event_type"), ["purchase", "click"]).select("event_id", "route")


def route_dynamic_counts(spark, d):
    """routes made as keys appear, at most ten."""
    rows = routing.route_dynamic(_by_type(spark, d), F.col("event_type"), 10)
    return rows.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def route_template(spark, d):
    """each event type's rows through a flow made from one template with the type's own settings: values scaled, batches of its own size."""
    known = spark.createDataFrame([("click", 2, 10), ("error", 3, 20), ("purchase", 5, 7), ("signup", 7, 1000), ("view", 11, 3)], "route string, factor int, size int")

    def template(rows):
        rows = numbered_within(rows, ["route"], ["event_id"], "n")
        return rows.withColumn("batch", F.expr("(n - 1) div size")).groupBy("route", "batch").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("event_id") * F.col("factor")).alias("total"))

    return routing.route_dynamic(_by_type(spark, d).select("event_id", "event_type"), F.col("event_type"), 10, known, template).select("route", "batch", "n", "total")


def route_merge(spark, d):
    """price bands with a surcharge each, merged."""
    band = F.when(F.col("o_totalprice") < 100000, "low").when(F.col("o_totalprice") < 250000, "middle").otherwise("high")
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"), band.alias("route"))
    add = lambda x: lambda df: df.withColumn("price", (F.col("price") + F.lit(x).cast("decimal(18,2)")).cast("decimal(18,2)"))
    return routing.merge_routes(rows, {"low": add("1"), "middle": add("2.50"), "high": add("10")})


def route_expiring_sessions(spark, d):
    """A user's route expires after a day without events."""
    return routing.expiring_sessions(_by_type(spark, d), "user_id", "ts", 86_400_000_000)


def routed_epoch_grid(spark, d):
    """every type and day, also those without events."""
    rows = _by_type(spark, d).select("event_type", F.date_format("ts", "yyyy-MM-dd HH").alias("epoch"))
    return routing.routed_epochs(rows, "event_type", "epoch", rows.select("event_type"))


def groupby_per_chunk(spark, d):
    """G1: counts and totals per type within each chunk."""
    rows = _by_type(spark, d).withColumn("chunk", F.expr("event_id div 1000"))
    return aggregates.group_rows(rows, ["event_type"], {"n": F.count(F.lit(1)), "total": _money("value")}, "chunk")


def groupby_global(spark, d):
    """Means and totals per type over everything."""
    return aggregates.group_rows(_by_type(spark, d), ["event_type"], {"mean": F.round(F.avg("value"), 6), "total": _money("value"), "n": F.count(F.lit(1))})


def grouping_sets(spark, d):
    """G9, an addition: totals per status and priority, with subtotals."""
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def cube_counts(spark, d):
    """Orders by status and priority in every combination."""
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def chosen_grouping_sets(spark, d):
    """Orders by status and by priority apart, and in all; distinct customers beside the counts."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, d, "orders").groupingSets([[status], [priority], []], status, priority).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("n_customers"))


def window_frames(spark, d):
    """Per customer the orders' ranks, quarters, first and last price, and the mean over three neighbours; no customer holds many orders."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    near, all_ = w.rowsBetween(-1, 1), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_price = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))
    return table(spark, d, "orders").select(
        "o_orderkey", F.rank().over(by_price).alias("price_rank"), F.dense_rank().over(by_price).alias("price_dense"), F.ntile(4).over(w).alias("quarter"),
        F.first("o_totalprice").over(all_).alias("first_price"), F.last("o_totalprice").over(all_).alias("last_price"), F.round(F.avg("o_totalprice").over(near), 4).alias("near_mean"), F.lag("o_orderkey").over(w).alias("before"),
    )


def nest_orders(spark, d):
    """Orders with their lines as arrays; size and first part of each."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    nested = aggregates.nest(line, ["l_orderkey"], "lines", ["l_partkey", "l_quantity"])
    return nested.select("l_orderkey", F.size("lines").cast("bigint").alias("n"), F.col("lines")[0]["l_partkey"].alias("first_part"))


def unnest_orders(spark, d):
    """Nested and flattened again, nothing is lost."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    flat = aggregates.unnest(aggregates.nest(line, ["l_orderkey"], "lines", ["l_partkey", "l_quantity"]), "lines")
    return flat.groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"), _money("l_quantity").alias("quantity"))


def lookup_join(spark, d):
    """H1: line items with part and supplier, totals per brand and nation."""
    line = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    supplier = joins.lookup_join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey")), table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return joins.lookup_join(joins.lookup_join(line, part, "l_partkey"), supplier, "l_suppkey").groupBy("p_brand", "n_name").agg(_money("l_quantity").alias("quantity"))


def write_back_lookup(spark, d):
    """H3: parts marked as sold if an item of large quantity has them; the others pass through."""
    sold = table(spark, d, "lineitem").where("l_quantity >= 50")
    return joins.write_back(table(spark, d, "part").select("p_partkey"), sold.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "processed")


def log_chunks(spark, d):
    """Rows of each chunk and the schema."""
    rows = table(spark, d, "part").select("p_partkey", "p_size", F.expr("p_partkey div 500").alias("chunk"))
    return chunk_log(rows, "chunk").select("chunk", "n_rows", "schema")


def dynamic_flow(spark, d):
    """A flow given as JSON, built from registered blocks."""
    flow = {
        "flowId": "totals", "version": 1,
        "blocks": [{"instanceId": "in", "blockKey": "source"}, {"instanceId": "large", "blockKey": "rows/filter"}, {"instanceId": "band", "blockKey": "rows/derive"}, {"instanceId": "sum", "blockKey": "rows/group"}],
        "connections": [{"from": "in", "to": "large"}, {"from": "large", "to": "band"}, {"from": "band", "to": "sum"}],
        "config": {"large": {"column": "o_totalprice", "operator": "GreaterThan", "value": 100000}, "band": {"columns": {"half": "o_custkey % 2"}}, "sum": {"keys": ["half"], "aggregates": {"n": "count(1)"}}},
    }
    return build_flow(flow, standard_registry(), {"in": table(spark, d, "orders").select("o_custkey", "o_totalprice")})["sum"]


def sorted_page(spark, d):
    """The third page of the costliest orders."""
    from millrace.operators.events import list_page

    rows = filter_rows(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), FilterConfig("o_totalprice", "GreaterThan", 0))
    return list_page(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, 40)


QUERIES = {
    f.__name__: f
    for f in (broadcast_fanout_counts, competing_assignment, round_robin_per_user, fan_in_union, row_concat, column_merge, dedup_global, dedup_in_chunk, control_broadcast, set_operations, route_static, route_tag_filter, route_dynamic_counts, route_template,
              route_merge, route_expiring_sessions, routed_epoch_grid, groupby_per_chunk, groupby_global, grouping_sets, cube_counts, chosen_grouping_sets, window_frames, nest_orders, unnest_orders, lookup_join, write_back_lookup, log_chunks, dynamic_flow, sorted_page)
}

ORACLE = {
    "broadcast_fanout_counts": "SELECT 'all' AS branch, count(*) AS n FROM orders UNION ALL SELECT 'open', count(*) FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'done', count(*) FROM orders WHERE o_orderstatus = 'F'",
    "competing_assignment": "SELECT (o_orderkey % 4)::INT AS consumer, count(*) AS n FROM orders GROUP BY 1",
    "round_robin_per_user": "SELECT event_id, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 3)::INT AS consumer FROM events",
    "fan_in_union": "SELECT c_name AS name, c_nationkey AS nation, 'customer' AS kind FROM customer UNION ALL SELECT s_name, s_nationkey, 'supplier' FROM supplier",
    "row_concat": "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT o_orderkey, o_totalprice, NULL FROM orders WHERE o_totalprice < 50000",
    "column_merge": "SELECT a.o_orderkey, a.o_orderstatus AS v_left, a.o_custkey, b.o_orderpriority AS v_right FROM orders a JOIN orders b USING (o_orderkey) WHERE b.o_orderstatus <> 'O'",
    "dedup_global": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) AS r FROM lineitem) WHERE r = 1""",
    "dedup_in_chunk": "SELECT event_id // 1000 AS chunk, user_id, min(event_id) AS event_id FROM events GROUP BY 1, 2",
    "control_broadcast": "WITH t AS (SELECT DISTINCT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS target), x AS (SELECT event_type AS target FROM events WHERE event_id % 100 <> 0 UNION ALL SELECT target FROM events, t WHERE event_id % 100 = 0) SELECT target, count(*) AS n FROM x GROUP BY target",
    "set_operations": "SELECT k, 'both' AS side FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT k, 'customer only' FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)",
    "route_static": "SELECT event_type AS route, count(*) AS n, sum(value::DECIMAL(18,2))::DECIMAL(38,2) AS total FROM events GROUP BY 1",
    "route_tag_filter": "SELECT event_id, event_type AS route FROM events WHERE event_type IN ('purchase', 'click')",
    "route_dynamic_counts": "SELECT event_type AS route, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1",
    "route_template": """WITH s(route, factor, size) AS (VALUES ('click', 2, 10), ('error', 3, 20), ('purchase', 5, 7), ('signup', 7, 1000), ('view', 11, 3)),
n AS (SELECT event_type AS route, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS n FROM events)
SELECT n.route, n.n // size AS batch, count(*) AS n, sum(event_id * factor)::BIGINT AS total FROM n JOIN s ON s.route = n.route GROUP BY 1, 2""",
    "route_merge": """WITH r AS (SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS price, CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 250000 THEN 'middle' ELSE 'high' END AS route FROM orders)
SELECT o_orderkey, (price + CASE route WHEN 'low' THEN 1 WHEN 'middle' THEN 2.5 ELSE 10 END)::DECIMAL(18,2) AS price, route FROM r""",
    "route_expiring_sessions": """WITH n AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 86400000000 THEN 0 ELSE 1 END AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM n) SELECT user_id, session_no, count(*) AS n, min(t) AS first_us, max(t) AS last_us FROM s GROUP BY 1, 2""",
    "routed_epoch_grid": """WITH e AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d %H') AS epoch FROM events), r AS (SELECT DISTINCT event_type FROM events)
SELECT e.epoch, r.event_type, count(x.event_id) AS n FROM e CROSS JOIN r LEFT JOIN events x ON strftime(x.ts, '%Y-%m-%d %H') = e.epoch AND x.event_type = r.event_type GROUP BY 1, 2""",
    "groupby_per_chunk": "SELECT event_id // 1000 AS chunk, event_type, count(*) AS n, sum(value::DECIMAL(18,2))::DECIMAL(38,2) AS total FROM events GROUP BY 1, 2",
    "groupby_global": "SELECT event_type, round(avg(value), 6) AS mean, sum(value::DECIMAL(18,2))::DECIMAL(38,2) AS total, count(*) AS n FROM events GROUP BY 1",
    "grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "cube_counts": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus, o_orderpriority)::BIGINT AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "chosen_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "window_frames": """SELECT o_orderkey, (rank() OVER p)::INT AS price_rank, (dense_rank() OVER p)::INT AS price_dense, (ntile(4) OVER w)::INT AS quarter, first_value(o_totalprice) OVER a AS first_price, last_value(o_totalprice) OVER a AS last_price,
  round(avg(o_totalprice) OVER n, 4) AS near_mean, lag(o_orderkey) OVER w AS before FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC), a AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
  n AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""",
    "nest_orders": "SELECT l_orderkey, count(*) AS n, min(l_partkey) AS first_part FROM lineitem GROUP BY 1",
    "unnest_orders": "SELECT l_orderkey, l_partkey, count(*) AS n, sum(l_quantity::DECIMAL(18,2))::DECIMAL(38,2) AS quantity FROM lineitem GROUP BY 1, 2",
    "lookup_join": "SELECT p_brand, n_name, sum(l_quantity::DECIMAL(18,2))::DECIMAL(38,2) AS quantity FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2",
    "write_back_lookup": "SELECT p_partkey, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50) THEN true END AS processed FROM part",
    "log_chunks": "SELECT p_partkey // 500 AS chunk, count(*) AS n_rows, 'struct<p_partkey:bigint,p_size:int,chunk:bigint>' AS schema FROM part GROUP BY 1",
    "dynamic_flow": "SELECT o_custkey % 2 AS half, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1",
    "sorted_page": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0 ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 80",
}
