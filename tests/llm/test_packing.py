import random

import pytest
from conftest import rows

from millrace.llm import packing as P


def check(sizes, capacity):
    bins = P.pack(sizes, capacity)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= capacity for b in bins)
    return len(bins)


def best(sizes, capacity):
    """The fewest containers, by trying everything."""
    sizes = sorted((s for s in sizes if s), reverse=True)
    found = [len(sizes)]

    def go(i, room):
        if len(room) >= found[0]:
            return
        if i == len(sizes):
            found[0] = len(room)
            return
        for free in {*room}:
            if free >= sizes[i]:
                k = room.index(free)
                go(i + 1, [*room[:k], free - sizes[i], *room[k + 1 :]])
        go(i + 1, [*room, capacity - sizes[i]])

    go(0, [])
    return found[0]


@pytest.mark.parametrize("seed", range(30))
def test_small_lots_are_packed_as_well_as_can_be(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 50, 100])
    sizes = [r.randint(1, capacity) if r.random() < 0.5 else r.randint(capacity // 5, capacity // 2) for _ in range(r.randint(1, 11))]
    n = best(sizes, capacity)
    assert P.lower_bound(sizes, capacity) <= n == check(sizes, capacity)


@pytest.mark.parametrize("share", [1.0, 0.4, 0.1])
def test_large_lots_waste_little(share):
    r = random.Random(3)
    sizes = [r.randint(0, int(1000 * share)) for _ in range(3000)]
    assert check(sizes, 1000) <= P.lower_bound([s for s in sizes if s], 1000) * 1.01 + 1


def test_a_case_that_best_fit_misses():
    sizes = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6]  # 180 = 2 x 90 + ... into three of 60
    assert check(sizes, 60) == best(sizes, 60)


def test_odd_lots():
    assert P.pack([], 10) == []
    assert P.pack([0, 0], 10) == [[0, 1]]
    assert check([10, 10, 0], 10) == 2


def test_assignment(spark):
    docs = [(1, "word " * 500, "x"), (2, "", "x"), (3, None, "x"), (4, "one two three", "x"), (4, "one two three", "x"), (None, "lost", "x"), (5, "a" * 200_000, "x"), (6, "ß€語 " * 40, "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, capacity string")
    specs = spark.createDataFrame([(1, 64), (2, 10_000_000), (3, None), (4, 0), (1, 64)], "spec_id int, capacity int")
    got = P.assign(df, specs, lot=2).collect()
    encoding = P._encoding(P.TOKENIZER)
    for spec, capacity in ((1, 64), (2, 10_000_000)):
        own = [r for r in got if r["spec_id"] == spec]
        held = {}
        for r in own:
            held[r["container_id"]] = held.get(r["container_id"], 0) + r["n_tokens"]
        assert all(n <= capacity for n in held.values())
        for doc_id, text in {d[0]: d[1] for d in docs if d[0]}.items():
            pieces = sorted((r["piece_no"], r["token_start"], r["n_tokens"]) for r in own if r["doc_id"] == doc_id)
            n = P.count_tokens(encoding, text)
            assert [p[0] for p in pieces] == list(range(len(pieces))) and sum(p[2] for p in pieces) == n
            assert len(pieces) == max(1, -(-n // capacity))  # split only if it must be
            assert all(start == sum(p[2] for p in pieces[:k]) for k, (_, start, _) in enumerate(pieces))
    assert {r["spec_id"] for r in got} == {1, 2}
    assert rows(P.assign(df.limit(0), specs)) == []
    assert rows(P.assign(df, specs.limit(0))) == []


def test_the_search_saves_containers_over_best_fit():
    gains = []
    for seed in range(6):
        r = random.Random(seed)
        sizes, own = [min(1000, int(r.lognormvariate(5.9, 0.8)) + 1) for _ in range(1200)], []
        bins = P.pack(sizes, 1000, own)
        assert len(bins) == len(P.best_fit(sizes, 1000)) - len(own) >= P.lower_bound(sizes, 1000)
        gains += own
    assert len(gains) > 0


@pytest.mark.parametrize("seed", range(20))
def test_fillings_against_all_sets(seed):
    r = random.Random(seed)
    sizes = sorted((r.randint(1, 12) for _ in range(r.randint(0, 9))), reverse=True)
    room, most = r.randint(0, 30), r.randint(0, 8)
    want = set()
    for mask in range(1 << len(sizes)):
        some = tuple(s for k, s in enumerate(sizes) if mask >> k & 1)
        if 0 <= room - sum(some) <= most:
            want.add((room - sum(some), some))
    got = [(w, tuple(sizes[k] for k in c)) for w, c in P.fillings(sizes, room, most, 10_000)]
    assert len(got) == len(set(got)) and set(got) == want and [w for w, _ in got] == sorted(w for w, _ in got)


def test_dominated_fillings():
    assert P.dominated([3, 2], {3: 1, 2: 1, 5: 1}, 0)  # one of 5 for 3 + 2
    assert P.dominated([3], {3: 1, 4: 1}, 1)
    assert not P.dominated([3, 2], {3: 1, 2: 1, 6: 1}, 0)
    assert not P.dominated([4, 4], {4: 2}, 0)


@pytest.mark.parametrize("seed", range(20))
def test_branch_and_bound_finds_what_there_is(seed):
    r = random.Random(seed)
    sizes = [r.randint(2, 9) for _ in range(8)]
    n = best(sizes, 12)
    found = P.branch_and_bound(sizes, 12, n, 100_000, 1000)
    assert sorted(i for b in found for i in b) == list(range(8)) and len(found) <= n and all(sum(sizes[i] for i in b) <= 12 for b in found)
    assert P.branch_and_bound(sizes, 12, n - 1, 100_000, 1000) is None


@pytest.mark.parametrize("text", ["7" * 70_007, "?!" * 90_000, "a" * 150_000, " " * 70_000 + "x", "x \n\n  y " * 20_000, "語" * 70_000, "don't 12 " * 9_000])
def test_long_texts_without_places_to_cut(text):
    encoding = P._encoding(P.TOKENIZER)
    assert P.count_tokens(encoding, text) == len(encoding.encode_ordinary(text))


def test_long_texts_are_cut_where_the_tokenizer_cuts():
    r = random.Random(1)
    text = " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(60_000))
    encoding = P._encoding(P.TOKENIZER)
    assert P.count_tokens(encoding, text) == len(encoding.encode_ordinary(text))
