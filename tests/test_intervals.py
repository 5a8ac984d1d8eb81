import random

import pytest
from conftest import rows

from millrace.operators.intervals import merge_intervals

SCHEMA = "kind string, who string, s bigint, e bigint, start_us string, span_kind string"


def brute(intervals):
    out = set()
    by = {}
    for kind, who, s, e in intervals:
        if None not in (kind, who, s, e) and e >= s:
            by.setdefault((kind, who), []).append((s, e))
    for key, own in by.items():
        own.sort()
        now_s, now_e = own[0]
        for s, e in own[1:]:
            if s <= now_e:
                now_e = max(now_e, e)
            else:
                out |= {(*key, "period", now_s, now_e), (*key, "gap", now_e, s)}
                now_s, now_e = s, e
        out.add((*key, "period", now_s, now_e))
    return sorted(out, key=repr)


def run(spark, intervals):
    df = spark.createDataFrame([(*i, "x", "y") for i in intervals], SCHEMA)
    return rows(merge_intervals(df, ["kind", "who"], "s", "e"))


def test_overlap_nest_touch_and_gap(spark):
    given = [("r", "a", 0, 10), ("r", "a", 2, 3), ("r", "a", 10, 12), ("r", "a", 20, 20), ("r", "a", 25, 30), ("r", "b", 5, 6)]
    assert run(spark, given) == sorted([("r", "a", "period", 0, 12), ("r", "a", "gap", 12, 20), ("r", "a", "period", 20, 20), ("r", "a", "gap", 20, 25), ("r", "a", "period", 25, 30), ("r", "b", "period", 5, 6)], key=repr)


def test_nulls_reversed_repeated_and_empty(spark):
    given = [(None, "a", 0, 1), ("r", None, 0, 1), ("r", "a", None, 1), ("r", "a", 1, None), ("r", "a", 5, 4), ("r", "a", 7, 9), ("r", "a", 7, 9)]
    assert run(spark, given) == [("r", "a", "period", 7, 9)]
    assert run(spark, []) == []
    assert run(spark, given[:5]) == []


@pytest.mark.parametrize("seed", range(6))
def test_random_with_a_hot_entity_over_all_partitions(spark, seed):
    r = random.Random(seed)
    given = []
    for _ in range(600):
        s = r.randrange(3000)
        who = "hot" if r.random() < 0.7 else r.choice("abcdef")
        given.append((r.choice(["run", "item"]) if who != "hot" else "run", who, s, s + r.choice([0, 1, 2, 5, 900 if r.random() < 0.02 else 3])))
    assert run(spark, given) == brute(given)
