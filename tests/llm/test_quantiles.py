import math
import random
from collections import defaultdict
from datetime import datetime
from decimal import Decimal

import numpy as np
import pytest

from millrace.llm.catalog import PROBS as P3_PROBS
from millrace.llm.catalog import QUERIES, RANK_ERROR
from millrace.llm.quantiles import RankSummary, combine, merge_all, merged_level, permitted, read_quantiles, summarize

SF = "/root/testdata/sf0.001"
PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


def off(values, v, prob):
    """By how many ranks v is off the sought one; 0 if it is among its ties."""
    values = np.sort(values)
    rank = max(1, math.ceil(prob * len(values)))
    low, high = np.searchsorted(values, v, "left") + 1, np.searchsorted(values, v, "right")
    return max(0, low - rank, rank - high)


@pytest.mark.parametrize("seed", range(8))
def test_summary_error_is_proven(seed):
    r = np.random.default_rng(seed)
    parts = [r.integers(0, 40, 500).astype(float) if seed % 2 else r.lognormal(0, 3, r.integers(1, 3000)) for _ in range(9)]
    s = merge_all([RankSummary.of(p).compress(0.01) for p in parts]).compress(0.02)
    values = np.concatenate(parts)
    assert s.n == len(values) and s.error <= 0.02 + 1e-9
    assert len(s.value) < 200
    for p, v, bound in zip(PROBS, *s.quantile(PROBS)):
        assert off(values, v, p) <= bound <= s.error * s.n + 1


@pytest.mark.parametrize("seed", range(4))
def test_every_rank_is_within_its_bound_where_values_repeat(seed):
    r = np.random.default_rng(seed)
    values = np.repeat(r.lognormal(0, 2, 300).round(1), 60)
    r.shuffle(values)
    s = merge_all([RankSummary.of(p).compress(0.005) for p in np.array_split(values, 9)]).compress(0.01)
    ranks = np.arange(1, len(values) + 1)
    got, bound = s.quantile((ranks - 0.5) / len(values))
    values.sort()
    true = np.maximum(0, np.maximum(np.searchsorted(values, got, "left") + 1 - ranks, ranks - np.searchsorted(values, got, "right")))
    assert (true <= bound).all() and bound.max() <= s.error * s.n + 1


@pytest.mark.parametrize("n", [100, 125, 250, 3000])
def test_no_rank_is_off_by_more_than_the_stated_share(n):
    values = np.random.default_rng(n).permutation(n).astype(float)
    ranks = np.arange(1, n + 1)
    exact = RankSummary.of(values)
    for s in (exact, exact.compress(0.01), merge_all([RankSummary.of(p).compress(0.01) for p in np.array_split(values, 3)]).compress(0.02)):
        got, bound = s.quantile((ranks - 0.5) / n)
        assert np.abs(got + 1 - ranks).max() <= bound.max() <= s.error * n + 1e-6
        assert s.error <= 0.02
    assert exact.error == 0


def test_groups_over_partitions_and_days(spark):
    r = random.Random(4)
    data = [("hot" if r.random() < 0.6 else r.choice("ab"), r.choice(["d1", "d2", "d3"]), r.choice([r.gauss(0, 1e6), float(r.randrange(5))])) for _ in range(20_000)]
    data += [("a", "d1", None), ("a", "d1", math.nan), ("b", "d1", math.inf), (None, "d1", 1.0)]
    df = spark.createDataFrame(data, "who string, day string, v double")
    daily = combine(summarize(df, ["who", "day"], "v", 0.02), ["who"], 0.02)
    for made in (summarize(df, ["who"], "v", 0.02), daily):
        got = read_quantiles(made, ["who"], PROBS).collect()
        assert {x["who"] for x in got} == {"hot", "a", "b"}
        for x in got:
            values = np.array([v for w, _, v in data if w == x["who"] and v is not None and math.isfinite(v)])
            assert x["n_values"] == len(values)
            assert off(values, x["value"], x["prob"]) <= x["off_ranks"] <= 0.02 * len(values) + 1
            assert x["rank_error"] <= 0.02 + 1e-9


def test_empty(spark):
    df = spark.createDataFrame([], "who string, v double")
    assert read_quantiles(summarize(df, ["who"], "v"), ["who"], PROBS).count() == 0


def test_summaries_hardly_grow_with_what_is_combined():
    r = np.random.default_rng(2)
    error, sizes, errors = 0.01, {}, {}

    def up(parts):
        return merged_level([s for s, _ in parts], [k for _, k in parts], error)

    def day():
        # a day as ``summarize`` makes it: partitions, bundles, the whole
        leaves = [(RankSummary.of(r.lognormal(0, 2, 3000)).compress(permitted(error, 0)), 0) for _ in range(4)]
        return up([up(leaves[:2]), up(leaves[2:])])

    days = [day() for _ in range(48)]
    month = lambda: up([up([days[r.integers(48)] for _ in range(15)]) for _ in range(2)])
    months = [month() for _ in range(12)]
    year = up([up(months[:6]), up(months[6:])])
    ten = up([up([year] * 5), up([year] * 5)])
    for name, (s, _) in {"day": days[0], "month": months[0], "year": year, "ten": ten}.items():
        sizes[name], errors[name] = len(s.value), s.error
    assert all(e <= error for e in errors.values()), errors
    assert sizes["year"] <= 2 * sizes["month"] and sizes["ten"] <= 2 * sizes["year"], sizes


def test_many_groups_fit_in_little_memory():
    """400,000 groups of one value in one task: what the scan holds doesn't grow with them."""
    import subprocess
    import sys

    code = """
import resource, numpy as np, pandas as pd
from millrace.llm.quantiles import _leaves
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
names = (f"g{i:07d}" for i in range(400_000))
batches = (pd.DataFrame({"__g0": [next(names) for _ in range(10_000)], "v": np.arange(10_000.0), "part": 0}) for _ in range(40))
n = sum(len(x) for x in _leaves(["__g0"], 0.01)(batches))
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""
    n, mb = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=__file__.split("/tests/")[0]).stdout.split())
    assert n == 400_000 and mb < 200


def test_a_group_over_many_batches_is_thinned():
    from millrace.llm.quantiles import _leaves

    import pandas as pd

    values = np.sort(np.random.default_rng(3).integers(0, 30_000, 200_000).astype(float))
    batches = (pd.DataFrame({"__g0": "x", "v": values[i : i + 10_000], "part": 3}) for i in range(0, 200_000, 10_000))
    (out,) = _leaves(["__g0"], 0.01)(batches)
    s = RankSummary(int(out["n"][0]), *(np.asarray(out[c][0]) for c in ("value", "least", "greatest")))
    assert s.n == 200_000 and s.error <= permitted(0.01, 0) and len(s.value) < 500
    for p, v, bound in zip(PROBS, *s.quantile(PROBS)):
        assert off(values, v, p) <= bound <= 0.0025 * s.n + 1


def test_percentiles_are_within_their_bound(spark):
    values = defaultdict(dict)
    region = {r["id"]: r["region"] for r in spark.read.parquet(f"{SF}/invoice.parquet").where("id is not null and region is not null").collect()}
    for r in spark.read.parquet(f"{SF}/payment.parquet").collect():
        if r["gross_amount"] is not None and r["invoice_id"] in region:
            values["gross_amount", region[r["invoice_id"]]][r["payment_id"]] = float(r["gross_amount"])
    for r in spark.read.parquet(f"{SF}/benchmark_result.parquet").collect():
        v = r["throughput_per_sec"]
        if r["library"] is not None and v is not None and math.isfinite(v):
            values["throughput_per_sec", r["library"]][r["result_id"]] = v
    for name in ("p3_percentiles", "p3_combined_days"):
        got = QUERIES[name](spark, SF).collect()
        assert {(r["field"], r["group_value"]) for r in got} == {*values} and len(got) == len(values) * len(P3_PROBS)
        for r in got:
            own = np.sort([*values[r["field"], r["group_value"]].values()])
            rank = max(1, math.ceil(r["prob"] * len(own)))
            low, high = np.searchsorted(own, r["value"], "left") + 1, np.searchsorted(own, r["value"], "right")
            assert r["n_values"] == len(own) and r["rank_error"] <= RANK_ERROR
            assert max(0, low - rank, rank - high) <= r["off_ranks"] <= RANK_ERROR * len(own) + 1


def test_an_id_counts_by_its_finite_row(spark, tmp_path):
    t = datetime(2025, 1, 2)
    runs = [(1, "A", math.nan, t), (1, "B", 5.0, t), (2, "A", -math.inf, t), (2, "A", 7.0, t), (3, "A", 9.0, t), (3, "A", math.inf, t), (4, "A", math.nan, t), (5, "A", None, t), (5, "A", 1.0, None)]
    spark.createDataFrame(runs, "result_id bigint, library string, throughput_per_sec double, run_at timestamp").write.parquet(f"{tmp_path}/benchmark_result.parquet")
    paid = [("p", "i", None, t), ("p", "i", Decimal("2.00"), t), ("p", "i", Decimal("2.00"), t)]
    spark.createDataFrame(paid, "payment_id string, invoice_id string, gross_amount decimal(18,2), paid_at timestamp").write.parquet(f"{tmp_path}/payment.parquet")
    spark.createDataFrame([("i", None), ("i", "EU")], "id string, region string").write.parquet(f"{tmp_path}/invoice.parquet")
    day = "2025-01-02 00:00:00"
    got = {(r["field"], r["group_value"], r["day"]): (r["n"], r["value"]) for r in QUERIES["p3_daily"](spark, str(tmp_path)).collect()}
    throughput = {("A", ""): (1, [1.0]), ("A", day): (2, [7.0, 9.0]), ("B", day): (1, [5.0])}
    assert got == {("gross_amount", "EU", day): (1, [2.0])} | {("throughput_per_sec", *k): v for k, v in throughput.items()}
