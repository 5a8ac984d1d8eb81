"""Small exact cases, and the errors that operators must raise."""

import random
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from millrace.functions import scalars, vectors
from millrace.operators import aggregates, batching, epochs, events, joins, ordered, ratelimit, routing, rowops, topology
from millrace.sources import readers, sinks


def ints(spark, n):
    return spark.range(n).select(F.col("id").alias("i"))


def frame(spark, n):
    return spark.createDataFrame([(i, 10 * i, "AB"[(i + 1) % 2]) for i in range(1, n + 1)], "RowId int, Amount int, Category string")


def test_batch_ten_by_three(spark):
    got = batching.collect_batches(batching.batch_by_size(ints(spark, 10), 3, ["i"]), ["batch_id"], ["i"])
    assert [[x["i"] for x in r["items"]] for r in got.orderBy("batch_id").collect()] == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9]]
    for bad in (0, -1):
        with pytest.raises(ValueError):
            batching.batch_by_size(ints(spark, 3), bad, ["i"])
    assert batching.batch_by_size(ints(spark, 0), 3, ["i"]).count() == 0


def test_segment_by_tens(spark):
    got = epochs.segment_by_key(ints(spark, 30).withColumn("k", F.expr("i div 10")), "k", ["i"])
    assert rows(got.groupBy("epoch_seq").count()) == [(1, 10), (2, 10), (3, 10)]


def test_segments_with_nulls_and_returning_keys(spark):
    r = random.Random(1)
    keys = [r.choice(["a", "b", None]) for _ in range(300)]
    df = spark.createDataFrame([*enumerate(keys)], "i int, k string")
    want, seq = [], 0
    for i, k in enumerate(keys):
        seq += i == 0 or k != keys[i - 1]
        want.append((i, seq))
    assert rows(epochs.segment_by_key(df, "k", ["i"]).select("i", "epoch_seq")) == sorted(want, key=repr)
    assert epochs.segment_by_key(df.limit(0), "k", ["i"]).count() == 0


def test_ordered_helpers(spark):
    r = random.Random(2)
    data = [(i, r.choice([None, None, i]), r.randrange(100), i % 3) for i in range(200)]
    df = spark.createDataFrame(data, "i int, v int, m bigint, lane int").repartition(7)
    known, now, best, want_max = [], None, {}, []
    for i, v, m, lane in data:
        now = v if v is not None else now
        known.append((i, now))
        best[lane] = max(m, best.get(lane, m))
        want_max.append((i, best[lane]))
    assert rows(ordered.last_known(df, "v", ["i"], "w").select("i", "w")) == sorted(known, key=repr)
    assert rows(ordered.running_max(df, "m", ["i"], "lane", "w").select("i", "w")) == sorted(want_max, key=repr)
    assert rows(ordered.numbered(df, ["i"]).select("i", "rn")) == sorted(((i, i + 1) for i in range(200)), key=repr)


def test_running_max_with_nulls(spark):
    r = random.Random(5)
    data = [(i, r.choice([None, r.randrange(100)]), r.choice(["hot", "hot", "hot", "b", None])) for i in range(200)]
    best, want = {}, []
    for i, m, lane in data:
        best[lane] = max((x for x in (m, best.get(lane)) if x is not None), default=None)
        want.append((i, m, lane, best[lane]))
    df = spark.createDataFrame(data, "i int, m bigint, lane string").repartition(7)
    got = ordered.running_max(df, "m", ["i"], "lane", "w")
    assert got.columns == ["i", "m", "lane", "w"] and rows(got) == sorted(want, key=repr)


def test_filter_and_select(spark):
    df = frame(spark, 10)
    assert rowops.filter_rows(df, "Amount > 50").count() == 5
    none = rowops.filter_rows(df, rowops.FilterConfig("Amount", "GreaterThan", 1000))
    assert none.count() == 0 and none.columns == df.columns
    assert rowops.select_columns(df, "Amount", "Category").columns == ["Amount", "Category"]
    for f in (lambda: rowops.select_columns(df), lambda: rowops.select_rename(df, {}), lambda: rowops.FilterConfig("Amount", "Like", 1).condition()):
        with pytest.raises(ValueError):
            f()


def test_validation_keeps_rows(spark):
    df = spark.createDataFrame([(1, "x"), (-1, "x"), (2, ""), (3, None), (None, "x")], "id int, data string")
    assert rows(rowops.validate(df, "id", "data").select("id", "is_valid")) == sorted([(1, True), (-1, False), (2, False), (3, False), (None, False)], key=repr)
    assert rows(rowops.enrich(spark.createDataFrame([(4321,)], "id int"), "id").select("category", "value")) == [("TypeB", Decimal("32.10"))]


def test_row_ranges(spark):
    assert sorted(r[1] for r in batching.row_ranges(frame(spark, 10), 4, ["RowId"]).groupBy("part_no").count().collect()) == [1, 3, 3, 3]
    assert sorted(r[1] for r in batching.row_ranges(frame(spark, 9), 4, ["RowId"]).groupBy("part_no").count().collect()) == [3, 3, 3]
    with pytest.raises(ValueError):
        batching.row_ranges(frame(spark, 9), 1, ["RowId"])


def test_accumulate_chunks(spark):
    df = spark.createDataFrame([(c, i) for c in range(3) for i in range(4)], "c int, i int")
    assert rows(batching.accumulate_chunks(df, "c", 8).groupBy("emit_no").agg(F.sum("n_rows"))) == [(1, 8), (2, 4)]


def test_dedup_keeps_the_first_and_tells_nulls_and_bars_apart(spark):
    df = spark.createDataFrame([(1, 1, "x"), (2, 2, "y"), (3, 1, "z")], "pos int, RowId int, v string")
    assert rows(topology.dedup(df, ["RowId"], ["pos"])) == [(1, 1, "x"), (2, 2, "y")]
    df = spark.createDataFrame([(1, "a|b", "c"), (2, "a", "b|c"), (3, None, "c"), (4, "", "c"), (5, None, "c")], "pos int, a string, b string")
    assert topology.dedup(df, ["a", "b"], ["pos"]).count() == 4


def test_fan_out_and_compete(spark):
    df = ints(spark, 10)
    branches = topology.broadcast_to(df, {n: (lambda d: d) for n in "abc"})
    assert sum(b.count() for b in branches.values()) == 30
    assert [b.count() for b in topology.broadcast_to(df, {n: (lambda d: d) for n in "abc"}, keep=True).values()] == [10] * 3
    shared = topology.assign_competing(df, 3, F.col("i"))
    assert shared.count() == 10 and shared.select("i").distinct().count() == 10
    with pytest.raises(ValueError):
        topology.fan_in()


def test_column_merge_names(spark):
    a, b = spark.createDataFrame([(1, "x", 5)], "id int, v string, w int"), spark.createDataFrame([(1, "y"), (2, "z")], "id int, v string")
    assert topology.column_merge(a, b, "id").columns == ["id", "v_left", "w", "v_right"]


def test_routes(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    with pytest.raises(Exception, match="no route c; routes: a, b"):
        routing.route_static(df, F.col("k"), ["a", "b"]).collect()
    with pytest.raises(ValueError):
        routing.route_static(df, F.col("k"), [])
    assert routing.tag_and_filter(df, F.col("k"), ["a"]).count() == 1
    with pytest.raises(ValueError):
        routing.route_dynamic(df, F.col("k"), 2)
    assert routing.route_dynamic(df, F.col("k"), 3).count() == 3


@pytest.mark.parametrize("seed", range(5))
def test_rate_limits_against_simulation(spark, seed):
    r = random.Random(seed)
    arrivals = sorted(r.randrange(40) for _ in range(120))
    df = spark.createDataFrame([*enumerate(arrivals)], "i int, a bigint")
    for permits, segments in ((3, 1), (2, 4)):
        out: list[int] = []
        for a in arrivals:
            t = max([a, *out[-1:]])
            while sum(1 for x in out if x > t - segments) >= permits:
                t += 1
            out.append(t)
        assert [x["release"] for x in ratelimit.release_windows(df, "a", ["i"], permits, segments).orderBy("i").collect()] == out
    for capacity, tokens in ((5, 2), (2, 3), (1, 1)):
        held, tick, out = capacity, arrivals[0], []
        for a in arrivals:
            if a > tick:
                held, tick = min(capacity, held + tokens * (a - tick)), a
            while not held:
                held, tick = min(capacity, tokens), tick + 1
            held -= 1
            out.append(tick)
        got = ratelimit.token_bucket(df.withColumn("k", F.lit(1)), "a", ["i"], capacity, tokens, ["k"])
        if capacity >= tokens:
            assert [x["release"] for x in got.orderBy("i").collect()] == out
    with pytest.raises(ValueError):
        ratelimit.release_windows(df, "a", ["i"], 0)


def test_vectors(spark):
    df = spark.sql("select map('a', 1L, 'b', 5L) a, map('b', 3L, 'c', 2L) b, cast(map() as map<string,bigint>) e")
    a, b, e = F.col("a"), F.col("b"), F.col("e")
    got = df.select(
        vectors.text(vectors.merge(a, b)), vectors.text(e), vectors.sequence(a, "z"), vectors.at_most(a, b), vectors.at_most(e, a), vectors.subsumes(vectors.merge(a, b), b), vectors.subsumes(a, b), vectors.total(a), vectors.text(vectors.advance(a, "b")), vectors.text(vectors.advance(a, "n"))
    ).first()
    assert tuple(got) == ("EpochVector[a=1, b=5, c=2]", "EpochVector.None", -1, False, True, True, False, 6, "EpochVector[a=1, b=6]", "EpochVector[a=1, b=5, n=1]")


def test_watermark_and_checkpoints(spark):
    progress = spark.createDataFrame([("b1", "s", i, "completed") for i in (1, 2, 3)] + [("b2", "s", i, "completed") for i in (1, 2)] + [("b3", "s", 9, "started"), ("b1", "t", 7, "completed")], "block string, source string, seq bigint, status string")
    assert rows(epochs.global_watermark(progress)) == [("s", 2), ("t", 7)]
    assert epochs.is_aligned(progress, F.create_map(F.lit("s"), F.lit(2).cast("bigint"))).first()[0] is True
    assert epochs.is_aligned(progress, F.create_map(F.lit("s"), F.lit(3).cast("bigint"))).first()[0] is False
    assert rows(epochs.clear_completed(progress, epochs.global_watermark(progress)).select("block", "seq")) == [("b1", 3), ("b3", 9)]
    six = spark.range(1, 7).select(F.col("id").alias("seq"))
    assert [r["seq"] for r in epochs.every_n(six, "seq", 3).where("checkpoint").orderBy("seq").collect()] == [3, 6]
    timed = epochs.time_based(spark.createDataFrame([(t,) for t in (0, 4, 9, 10, 12, 25)], "t bigint"), "t", 10)
    assert rows(timed.where("checkpoint").select("t")) == [(0,), (10,), (25,)]
    with pytest.raises(ValueError):
        epochs.every_n(six, "seq", 0)
    for bad in (lambda: epochs.EpochPolicy(), lambda: epochs.EpochPolicy.by_count(0), lambda: epochs.EpochPolicy.by_count_or_time(1, -1)):
        with pytest.raises(ValueError):
            bad()
    twice = spark.createDataFrame([(1, "b", "x"), (1, "b", "y")], "ck int, b string, s string")
    with pytest.raises(Exception, match="(?i)duplicate"):
        epochs.checkpoint_object(twice, ["ck"], "b", "s").collect()


def test_parameters(spark):
    df = spark.createDataFrame([('{"n": 5, "s": "x"}',), ("broken",), (None,)], "j string")
    assert [r[0] for r in df.select(scalars.parameter(F.col("j"), "n", "int", F.lit(9))).collect()] == [5, 9, 9]
    assert df.select(scalars.parameter(F.col("j"), "s", "int")).first()[0] is None
    with pytest.raises(Exception, match="parameter zz is missing"):
        df.select(scalars.required_parameter(F.col("j"), "zz", "int")).collect()


def test_paging_and_rates(spark):
    df = ints(spark, 500)
    assert [r[0] for r in events.list_page(df, [F.desc("i")], 0, 0).collect()] == [499]
    assert events.list_page(df, [F.desc("i")], 1, 1000).count() == 200
    samples = spark.createDataFrame([("e", 0, 0), ("e", 1_000_000, 10), ("e", 1_000_000, 12), ("e", 3_000_000, 12), ("e", 4_000_000, 20)], "e string, us bigint, items bigint")
    assert [r["rate"] for r in events.edge_rates(samples, ["e"], "us", "items").orderBy("us").collect()][-1] == 8.0


def test_nesting_and_joins(spark):
    df = spark.createDataFrame([(1, 2), (1, 1), (2, 9)], "k int, v int")
    nested = aggregates.nest(df, ["k"], "items", ["v"])
    assert rows(aggregates.unnest(nested, "items")) == [(1, 1), (1, 2), (2, 9)]
    assert rows(aggregates.running_totals(df.limit(0).withColumn("v", F.col("v").cast("decimal(18,2)")), "v")) == [(0, 0)]
    assert rows(joins.write_back(df, df.where("k = 1"), "k", "seen").select("k", "seen").distinct()) == sorted([(1, True), (2, None)], key=repr)
    plan = joins.lookup_join(df, df.select("k", F.col("v").alias("w")), "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan
    assert "broadcast" not in joins.small_side(df, 2)._jdf.queryExecution().optimizedPlan().toString()


def test_files_and_version_log(spark, tmp_path):
    df = frame(spark, 5)
    df.write.csv(str(tmp_path / "csv"), header=True)
    assert rows(readers.read_csv(spark, str(tmp_path / "csv"), "RowId int, Amount int, Category string")) == rows(df)
    df.write.json(str(tmp_path / "json"))
    assert rows(readers.read_json(spark, str(tmp_path / "json"), "RowId int, Amount int, Category string")) == rows(df)
    log = sinks.VersionLog(spark, str(tmp_path / "log"))
    assert log.latest() == 0 and log.changes(0) is None
    assert log.append(df.limit(2)) == (1, 2) and log.append(df.limit(0)) == (1, 0) and log.append(df.where("RowId > 3")) == (2, 2)
    assert rows(log.changes(1, 99).select("RowId", "strategy")) == [(4, "VersionDiffFallback"), (5, "VersionDiffFallback")]
    assert log.changes(2, 2).count() == 0
    sinks.write_epoch(df, str(tmp_path / "e"), 3)
    sinks.write_epoch(df, str(tmp_path / "e"), 3)
    assert spark.read.parquet(str(tmp_path / "e")).count() == 5
    seen_df, seen = sinks.observed(df, "o", n=F.count(F.lit(1)))
    seen_df.collect()
    assert seen.get["n"] == 5
    with pytest.raises(Exception, match="stop here"):
        readers.failing(df, "stop here").collect()
    assert rows(readers.from_rows(spark, iter([(1,)]), "i int")) == [(1,)]
    assert sinks.to_arrow(df).num_rows == 5 and len([*sinks.rows_of(df)]) == 5
    sinks.for_each_part(df, lambda it: sum(1 for _ in it))


def test_user_functions(spark):
    from millrace.operators import functions

    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5), (None, 7)], "k string, v int")
    assert rows(functions.map_batches(df, lambda p: p[p["v"] > 1][["v"]], "v int")) == [(2,), (5,), (7,)]
    assert rows(functions.map_epochs(df, "k", lambda p: p.head(1), "v int").select("k", "v").where("k = 'b' or k is null")) == sorted([("b", 5), (None, 7)], key=repr)
    assert rows(df.select(functions.scalar(lambda s: s + 1, "int")("v"))) == [(2,), (3,), (6,), (8,)]
    with pytest.raises(ValueError, match="2 rows"):
        functions.grouped(df, ["k"], lambda p: p, "k string, v int", most=1)


@pytest.mark.parametrize("most", [1, 3, 100_000])
def test_user_aggregate_from_parts(spark, most):
    from millrace.operators import functions

    df = spark.range(0, 3000, numPartitions=3).selectExpr("if(id % 7 = 6, null, id % 7) AS k", "id AS total", "1L AS n")
    merge = lambda t: t.group_by("k").aggregate([("n", "sum"), ("total", "sum")]).rename_columns(["k", "n", "total"])
    finish = lambda t: t.select(["k", "n", "total"])
    got = rows(functions.folded(df, ["k"], merge, finish, "k bigint, n bigint, total bigint", most))
    assert got == rows(df.groupBy("k").agg(F.sum("n"), F.sum("total"))) and len(got) == 7
    assert rows(functions.folded(df.limit(0), ["k"], merge, finish, "k bigint, n bigint, total bigint", most)) == []


def test_grouped_function_of_hot_and_odd_types(spark, tmp_path):
    from oracle_check import TABLES, compare

    from millrace.catalog import ORACLE, QUERIES

    hot = spark.range(1_000_001).selectExpr("'hot' AS event_type", "cast(id AS double) AS value")
    odd = [("nan", float("nan")), ("nan", 1.0), ("all nan", float("nan")), ("null", None), ("some null", None), ("some null", 3.0), (None, 2.0), (None, 7.5), ("inf", float("inf")), ("inf", 1.0), ("only inf", float("inf"))]
    hot.union(spark.createDataFrame(odd, "event_type string, value double")).selectExpr("monotonically_increasing_id() AS event_id", "*").write.parquet(str(tmp_path / "events.parquet"))
    for t in TABLES:
        if t != "events":
            (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    assert compare(spark, "grouped_function", str(tmp_path), QUERIES, ORACLE).startswith("ok 8 rows")


def test_checkpoint_store(spark, tmp_path):
    from millrace.sources.checkpoints import CheckpointStore

    store = CheckpointStore(spark, str(tmp_path / "store"))
    assert store.ids() == [] and store.latest() is None
    store.save("a", {"s": 1}, 5, {"b": "{}"})
    store.save("b", {}, 5, {})
    assert store.ids() == ["a", "b"] and store.latest()["checkpoint_id"] == "b" and store.get("a")["vector"] == {"s": 1}
    assert store.delete("b") and store.get("b") is None
    with pytest.raises(ValueError):
        store.save("x/y", {}, 0, {})


def test_every_route_of_many_is_in_the_grid(spark, tmp_path):
    from millrace.catalog.flows import QUERIES

    rows_ = spark.range(300).selectExpr("id AS event_id", "0L AS user_id", "CAST(IF(id = 299, NULL, id % 130) AS string) AS event_type", "TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(id % 2 AS int)) AS ts", "1.0D AS value")
    rows_.write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["routed_epoch_grid"](spark, str(tmp_path)).collect()
    assert len(got) == 131 * 2 and sum(r["n"] for r in got) == 300


def test_every_graph_is_ordered(spark, tmp_path):
    from millrace.catalog.surface import QUERIES

    def edge(a, b):
        return f'{{"sourceBlock": "{a}", "targetBlock": "{b}"}}'

    graphs = [
        (1, '{"blocks": [{"blockName": "z"}, {"blockName": "a"}, {"blockName": "m"}], "edges": [' + edge("a", "m") + ", " + edge("m", "z") + "]}"),
        (2, '{"Blocks": {"y": {}, "x": {"blockName": "w"}}, "edges": ' + edge("w", "y") + "}"),
        (3, '{"blocks": [{"blockName": "p"}, {"blockName": "q"}, {"blockName": "r"}], "edges": [' + edge("q", "r") + ", " + edge("r", "q") + "]}"),
    ]
    df = spark.createDataFrame([(i, "FlowGraphDefinedEvent", p) for i, p in [*graphs, graphs[0]]], "id bigint, event_type string, payload string")
    df.write.parquet(f"{tmp_path}/flow_event.parquet")
    got = rows(QUERIES["graph_order"](spark, str(tmp_path)))
    assert got == sorted([("1", 1, "a"), ("1", 2, "m"), ("1", 3, "z"), ("2", 1, "w"), ("2", 2, "y"), ("3", 1, "p"), ("3", None, "q"), ("3", None, "r")], key=repr)


def test_a_join_of_a_hot_key_is_split(spark):
    facts = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}", "x") for i in range(600)] + [(9999, None, "x")], "id int, k string, v string")
    dim = spark.createDataFrame([("hot", 1), *((f"k{i}", i) for i in range(0, 600, 6)), (None, 7)], "k string, w int")
    for how in ("left", "inner"):
        want = rows(facts.join(dim, ["k"], how).select("id", "k", "v", "w"))
        got = joins.salted_join(facts, dim, ["k"], how, rows=10)
        assert rows(got.select("id", "k", "v", "w")) == want and set(got.columns) == {"id", "k", "v", "w"}
        assert rows(joins.salted_join(facts, dim, ["k"], how).select("id", "k", "v", "w")) == want
        # the hot key's rows lie in many tasks
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        held = got.where("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert held > 1
    assert rows(joins.salted_join(facts.limit(0), dim, ["k"], rows=10)) == []
    assert not joins.is_small(dim, rows=10) and not joins.is_small(dim, size=50) and joins.is_small(dim)


@pytest.mark.parametrize("hot", [1.0, 0.5])
def test_order_within_a_key_that_holds_all_rows(spark, hot):
    """A key's rows span all partitions; numbers, sums and maxima are carried over."""
    r = random.Random(3)
    data = [("hot" if r.random() < hot else r.choice(["a", "z", None]), i, r.choice([None, r.randrange(-50, 50)])) for i in range(800)]
    df = spark.createDataFrame(data, "k string, i int, v bigint")
    laid = ordered.laid_out(df, ["k", "i"])
    assert laid.where("k = 'hot'").select(ordered.PART).distinct().count() >= (4 if hot == 1 else 2)
    want = {}
    state = {}
    for k, i, v in sorted(data, key=lambda x: x[1]):
        n, s, m = state.get(k, (0, None, None))
        n += 1
        s = s if v is None else (s or 0) + v
        m = v if m is None else m if v is None else max(m, v)
        state[k] = (n, s, m)
        want[i] = (n, s or 0, m)
    got = {x["i"]: x["rn"] for x in ordered.numbered_within(df, ["k"], ["i"]).collect()}
    assert got == {i: w[0] for i, w in want.items()}
    got = {x["i"]: x["s"] for x in ordered.running_within(df, ["k"], ["i"], F.col("v"), "s").collect()}
    assert got == {i: w[1] for i, w in want.items()}
    got = {x["i"]: x["m"] for x in ordered.running_within(df, ["k"], ["i"], F.col("v"), "m", "max").collect()}
    assert got == {i: w[2] for i, w in want.items()}
    assert rows(ordered.numbered_within(df.limit(0), ["k"], ["i"])) == []


def test_hot_ticks_epochs_and_keys_are_batched_right(spark):
    df = spark.range(1000).selectExpr("cast(id as int) i", "1 as k", "cast(id div 900 as bigint) as day", "7L as us")
    one = batching.batch_by_size_or_tick(df, 30, "us", 10, order=["i"]).collect()
    assert all(x["tick"] == 0 and x["chunk"] == x["i"] // 30 for x in one)
    assert sorted(x["chunk"] for x in batching.batch_by_size_or_tick(df, 30, "us", 10).collect()) == sorted(i // 30 for i in range(1000))
    got = batching.epoch_batch(df, 50, F.col("day"), ["i"]).collect()
    assert all(x["batch_no"] == (x["i"] % 900) // 50 + 1 and x["epoch_seq"] == x["i"] // 900 + 1 for x in got)
    got = epochs.cut_epochs(df, epochs.EpochPolicy.by_count_or_time(40, 1000), ["i"], "us").collect()
    assert all(x["epoch_seq"] == x["i"] // 40 + 1 for x in got)
    got = topology.round_robin(df, 3, ["i"], ["k"]).collect()
    assert all(x["consumer"] == x["i"] % 3 for x in got)
    got = ratelimit.token_bucket(df.withColumn("t", F.lit(0)), "t", ["i"], 1000, 1000, ["k"])
    assert {x["release"] for x in got.collect()} == {0}


def test_routes_without_blocks_or_settings_fail(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "route string, v int")
    ab = df.where("route is not null")
    both = {"a": lambda x: x, "b": lambda x: x.withColumn("v", F.col("v") * 10)}
    for keep in (False, True):
        assert rows(routing.merge_routes(ab, both, keep=keep)) == [("a", 1), ("b", 20)]
        with pytest.raises(Exception, match="no route b; routes: a"):
            routing.merge_routes(ab, {"a": both["a"]}, keep=keep).collect()
    with pytest.raises(Exception, match="no route null"):
        routing.merge_routes(df, both).collect()
    settings = spark.createDataFrame([("a", 7)], "route string, size int")
    assert rows(routing.route_dynamic(ab.where("route = 'a'").drop("route").withColumn("k", F.lit("a")), F.col("k"), 2, settings).select("route", "size")) == [("a", 7)]
    for frame in (ab, df.where("route is null")):
        with pytest.raises(Exception, match="no settings for route"):
            routing.route_dynamic(frame.withColumnRenamed("route", "k"), F.col("k"), 5, settings).collect()


def test_barrier(spark):
    e = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("b", 2), (None, 9), ("a", None)], "source string, seq bigint")
    got = {r["seq"]: (r["n_sources"], r["vector"], r["made"]) for r in epochs.barrier(e, ["a", "b"]).collect()}
    assert got == {1: (2, {"a": 1, "b": 1}, True), 2: (2, {"a": 2, "b": 2}, True), 3: (1, {"a": 3}, False)}
    assert not any(r["made"] for r in epochs.barrier(e, ["a", "b", "c"]).collect())
    with pytest.raises(Exception, match="source not registered: b"):
        epochs.barrier(e, ["a"]).collect()
    with pytest.raises(ValueError):
        epochs.barrier(e, [])
    assert rows(epochs.barrier(e.limit(0), ["a"])) == []


def test_a_limiter_without_a_queue_rejects(spark):
    df = spark.createDataFrame([(i, i // 50 if i < 99 else None) for i in range(100)], "i int, w int")
    got = {r["i"]: r["accepted"] for r in ratelimit.reject_beyond(df, "w", ["i"], 20).collect()}
    assert got == {i: i % 50 < 20 or i == 99 for i in range(100)}
    with pytest.raises(ValueError):
        ratelimit.reject_beyond(df, "w", ["i"], 0)


def test_version_log_raises_what_it_cannot_read(spark, tmp_path):
    log = sinks.VersionLog(spark, str(tmp_path / "log"))
    assert log.read() is None and log.latest() == 0 and log.changes(0) is None
    df = ints(spark, 5)
    assert log.append(df) == (1, 5) and log.append(df.limit(0)) == (1, 0) and log.append(df) == (2, 5)
    assert log.latest() == 2 and log.changes(1).count() == 5
    assert {r["strategy"] for r in log.changes(0).collect()} == {"VersionDiffFallback"}
    (tmp_path / "log" / "commit_version=1" / "part-broken.parquet").write_text("not parquet")
    for f in (tmp_path / "log").rglob("part-0*"):
        f.unlink()
    with pytest.raises(Exception):
        log.read().count()
    assert log.latest() == 2  # and the next append doesn't start at 1 again
    fed = sinks.VersionLog(spark, str(tmp_path / "fed"), feed=True)
    fed.append(df)
    fed.append(df)
    assert {r["strategy"] for r in fed.changes(0).collect()} == {"ChangeDataFeed"}
    # a version whose feed is gone: the fallback
    import shutil

    shutil.rmtree(tmp_path / "fed" / "_change_feed" / "commit_version=2")
    assert {r["strategy"] for r in fed.changes(0).collect()} == {"VersionDiffFallback"} and {r["strategy"] for r in fed.changes(0, 1).collect()} == {"ChangeDataFeed"}


def test_arrow_files(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * i, None, [i]) for i in range(50)], "i int, s string, n double, a array<int>").repartition(3)
    sinks.write_arrow(df, str(tmp_path / "a"))
    assert rows(readers.read_arrow(spark, str(tmp_path / "a"))) == rows(df)
    sinks.write_arrow(df.limit(0), str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        readers.read_arrow(spark, str(tmp_path / "none"))


def test_event_sink_snapshots_by_policy(spark, tmp_path):
    log, snaps = (sinks.VersionLog(spark, str(tmp_path / x)) for x in ("log", "snaps"))
    fold = lambda df: df.groupBy("run").agg(F.max("id").alias("as_of"))
    make = lambda xs: spark.createDataFrame(xs, "id bigint, run string, kind string")
    one = make([(1, "r", "FlowStartedEvent"), (2, "r", "BlockMetricsEvent"), (3, "s", "BlockMetricsEvent")])
    assert sinks.event_sink(one, log, snaps, "run", "id", "kind", fold) == {"version": 1, "events": 3, "snapshots": 1}
    two = make([(4, "r", "FlowCompletedEvent"), (100, "s", "BlockMetricsEvent")])
    assert sinks.event_sink(two, log, snaps, "run", "id", "kind", fold) == {"version": 2, "events": 2, "snapshots": 2}
    assert rows(snaps.read().select("run", "as_of")) == [("r", 2), ("r", 4), ("s", 100)]
    assert rows(sinks.read_events(log, "run", "kind", "FlowCompletedEvent").select("id")) == sorted([(1,), (3,), (4,), (100,)], key=repr)
    assert sinks.event_sink(two.limit(0), log, snaps, "run", "id", "kind", fold)["events"] == 0


def test_leases_of_tenants(spark, tmp_path):
    from millrace.sources.leases import Leases

    now = [100.0]
    one = Leases(spark, str(tmp_path / "l"), 10, lambda: now[0])
    two = Leases(spark, str(tmp_path / "l"), 10, lambda: now[0])
    assert one.holder("t") is None and one.acquire("t", "a") and one.holder("t") == ("a", 110.0)
    assert not two.acquire("t", "b") and not two.release("t", "b")
    now[0] = 105
    assert one.acquire("t", "a") and two.holder("t") == ("a", 115.0)  # renewed
    now[0] = 116
    assert two.holder("t") is None and two.acquire("t", "b") and not one.acquire("t", "a")
    assert two.release("t", "b") and one.acquire("t", "a")
    assert one.cursor("t") == two.cursor("t")
    for bad in ("", "a/b"):
        with pytest.raises(ValueError):
            one.acquire(bad, "a")
    with pytest.raises(ValueError):
        Leases(spark, "x", 0)


def test_the_first_of_labels_that_differ_in_case(spark):
    from millrace.operators.shred import Shape, entity_table, shred

    df = spark.createDataFrame([("r", '{"blocks": [{"State": "a", "STATE": "z", "blockName": "b"}, {"STATE": null, "state": "c", "blockName": "d"}]}')], "id string, j string")
    nodes = shred(df, "id", "j", Shape({"blocks": ("blockname",)}))
    got = entity_table(nodes, {"blocks": "block"}, {"name": ("blockName",), "state": ("state",)}).select("name", "state")
    assert rows(got) == [("b", "a"), ("d", "c")]


def test_most_specific_ancestor_against_all_pairs(spark):
    r = random.Random(4)
    make = lambda n: {s: r.randrange(-1, 6) for s in r.sample("abcde", n)}
    own = [(i, make(r.randrange(0, 5))) for i in range(60)] + [(60, None)]
    known = [(i, make(r.randrange(0, 4))) for i in range(40)] + [(40, {}), (41, {"a": -1})]

    def best(v):
        fits = [(len(c), sum(c.values()), -k) for k, c in known if v is not None and all(v.get(s, -1) >= n for s, n in c.items()) and c != v]
        return -max(fits)[2] if fits else None

    frames = [spark.createDataFrame(x, "id bigint, v map<string,bigint>") for x in (own, known)]
    got = epochs.most_specific_ancestor(*frames, "id", "v")
    assert dict(rows(got)) == {k: best(v) for k, v in own}
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
