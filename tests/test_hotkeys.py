import math
import random
from collections import Counter, defaultdict
from decimal import Decimal

from conftest import rows

from millrace.operators.hotkeys import dominating_values, key_quantiles, key_totals


def test_dominating_values_at_the_border(spark):
    data = ["a"] * 10 + ["b"] * 5 + ["c"] * 4 + [f"u{i}" for i in range(61)] + [None] * 15 + [""] * 5
    df = spark.createDataFrame([(x, 1) for x in data], "k string, key_value int")
    assert rows(dominating_values(df, "k").select("key_value", "n_rows")) == [("a", 10), ("b", 5)]


def test_dominating_values_of_odd_tables(spark):
    make = lambda xs: spark.createDataFrame([(x,) for x in xs], "k string")
    assert rows(dominating_values(make([]), "k")) == []
    assert rows(dominating_values(make([None, ""]), "k")) == []
    assert rows(dominating_values(make(["x"]), "k").select("key_value")) == [("x",)]
    every = [f"v{i}" for i in range(20)]
    assert rows(dominating_values(make(every), "k").select("key_value")) == sorted((x,) for x in every)


def test_dominating_values_random(spark):
    r = random.Random(5)
    data = [r.choice(["h1", "h2", "h3 "]) if r.random() < 0.4 else f"v{r.randrange(3000)}" for _ in range(20_000)]
    want = sorted((k,) for k, n in Counter(data).items() if n * 20 >= len(data))
    assert rows(dominating_values(spark.createDataFrame([(x,) for x in data], "k string"), "k").select("key_value")) == want


def test_quantiles_are_exact_for_hot_and_cold_keys(spark):
    r = random.Random(6)
    data = [("hot" if r.random() < 0.5 else f"k{r.randrange(30)}", Decimal(r.choice([r.randrange(-(10**9), 10**9), 500, -7])) / 100) for _ in range(6000)]
    data += [("k1", None), (None, Decimal("1.00"))]
    df = spark.createDataFrame(data, "k string, v decimal(18,2)")
    by = defaultdict(list)
    for k, v in data:
        if k is not None and v is not None:
            by[k].append(v)
    want = sorted(((k, p, sorted(vs)[max(1, math.ceil(p * len(vs))) - 1], len(vs)) for k, vs in by.items() for p in (0.0, 0.5, 0.99, 1.0)), key=repr)
    for least, parts in ((100, 10), (10, 1_000_000), (10**9, 1)):
        # sorted and hot; all hot; all sorted
        assert rows(key_quantiles(df, "k", "v", [0.0, 0.5, 0.99, 1.0], hot_least=least, hot_parts=parts)) == want
    assert rows(key_quantiles(df.limit(0), "k", "v", [0.5])) == []


def test_totals(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 5), ("", 2)], "k string, v int")
    assert rows(key_totals(df, "k", "v")) == sorted([("a", 2, 1, 1, 1, 1), (None, 1, 1, 5, 5, 5), ("", 1, 1, 2, 2, 2)], key=repr)


def test_many_ranks_of_hot_keys_without_nested_loops(spark, capsys):
    r = random.Random(8)
    data = [(r.choice("ab"), r.choice([r.randrange(-(2**40), 2**40), r.randrange(50)])) for _ in range(8000)]
    df = spark.createDataFrame(data, "k string, v bigint")
    probs = [i / 100 for i in range(1, 100)]
    got = key_quantiles(df, "k", "v", probs, hot_least=10, hot_parts=100)
    by = {k: sorted(v for x, v in data if x == k) for k in "ab"}
    assert rows(got) == sorted(((k, p, vs[max(1, math.ceil(p * len(vs))) - 1], len(vs)) for k, vs in by.items() for p in probs), key=repr)
    hot = dominating_values(df, "k")
    for x in (got, hot):
        assert "NestedLoop" not in x._jdf.queryExecution().toString()


def test_what_the_driver_collects_is_a_row_per_rank(spark, monkeypatch):
    from pyspark.sql import DataFrame
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    seen = []
    collect = Classic.collect
    monkeypatch.setattr(Classic, "collect", lambda self: seen.append(out := collect(self)) or out)
    df = spark.range(20_000).selectExpr("'hot' as k", "(id * 7919) % 1000003 as v")
    probs = [i / 100 for i in range(1, 100)]
    assert isinstance(key_quantiles(df, "k", "v", probs, hot_least=10), DataFrame)
    assert seen and max(map(len, seen)) <= len(probs)
