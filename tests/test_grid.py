import random

from conftest import rows

from millrace.operators.grid import BLOCK, regular_grid

STEP = 10


def run(spark, data, limit=35):
    df = spark.createDataFrame([(*x, 1) for x in data], "k string, t bigint, v int, slot_us int")
    return rows(regular_grid(df, ["k"], "t", "v", STEP, limit))


def brute(data, limit=35):
    by = {}
    for k, t, v in data:
        if None not in (k, t, v):
            by.setdefault(k, []).append((t, v))
    out = []
    for k, rs in by.items():
        rs.sort()
        slots = {}
        for t, v in rs:
            slots.setdefault(t // STEP * STEP, []).append((t, v))
        for at in range(min(slots), max(slots) + STEP, STEP):
            if at in slots:
                out.append((k, at, len(slots[at]), float(slots[at][-1][1]), "observed"))
                continue
            (t0, v0), (t1, v1) = max(r for r in rs if r[0] < at), min(r for r in rs if r[0] >= at)
            near = t1 - t0 <= limit
            out.append((k, at, 0, v0 + (v1 - v0) * (at - t0) / (t1 - t0) if near else None, "interpolated" if near else "gap"))
    return sorted(out, key=repr)


def test_fill_mark_and_edges(spark):
    data = [("a", 5, 1), ("a", 25, 3), ("a", 90, 7), ("b", -15, 4), ("b", 12, 5), ("c", 0, 9), (None, 1, 1), ("a", None, 1), ("a", 300, None)]
    assert run(spark, data) == brute(data)


def test_random_with_a_hot_source(spark):
    r = random.Random(2)
    data = [("hot" if r.random() < 0.6 else r.choice("abc"), r.randrange(4000), r.randrange(100)) for _ in range(300)]
    data += data[:20]
    got, want = run(spark, data), brute(data)
    assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want]
    assert all((a[3] is None and b[3] is None) or abs(a[3] - b[3]) < 1e-9 for a, b in zip(got, want))


def test_a_gap_longer_than_a_block_and_an_empty_table(spark):
    data = [("a", 0, 0), ("a", STEP * (2 * BLOCK + 7), 1)]
    got = run(spark, data)
    assert len(got) == 2 * BLOCK + 8 and len({x[1] for x in got}) == len(got)
    assert run(spark, []) == []
