import random

import numpy as np
from conftest import rows

from millrace.llm import leakage as L

R = random.Random(11)
NAMES = ["".join(R.choice("bcdfgklmnprstvz") + R.choice("aeiou") for _ in range(3)) for _ in range(4000)]
COMMON = "the a of and to in was that he it with on for her his at by had not but from they or one all".split()


def text(r, n):
    return " ".join(r.choice(COMMON) if r.random() < 0.5 else r.choice(NAMES) for _ in range(n))


def as_cues(words, r):
    out, k = [], 1
    while words:
        n = r.randint(2, 7)
        out.append(f"{k}\n00:00:{k % 60:02d},000 --> 00:00:{k % 60:02d},900\n{' '.join(words[:n])}\n")
        words, k = words[n:], k + 1
        if r.random() < 0.2:
            out.append(f"{k}\n00:00:01,000 --> 00:00:02,000\n[door slams]\n")
    return "\n".join(out)


def test_whole_partly_damaged_and_short_passages(spark):
    r = random.Random(1)
    items = [(i, text(r, 50)) for i in range(60)]
    docs, want = [], set()
    for d in range(120):
        before, after = text(r, r.randint(0, 200)).split(), text(r, r.randint(0, 200)).split()
        i = r.randrange(60)
        words = items[i][1].split()
        kind = d % 6
        if kind == 0:
            part = [w.upper() for w in words]
        elif kind == 1:
            part = words[10:38]
        elif kind == 2:  # small damage: letters confused, a few words lost or replaced
            part = [w.replace("e", "c", 1) if r.random() < 0.2 else w for k, w in enumerate(words) if k % 11 != 5]
            part[20] = "intruder"
        elif kind == 3:
            part = words[20:29]  # a short echo
        elif kind == 4:
            part = []
        else:
            part = words
        if kind in (0, 1, 2, 5):
            want.add((d, i))
        docs.append((d, as_cues(before + part + after, r), "extra"))
    df = spark.createDataFrame([*docs, (None, docs[0][1], "e"), (500, None, "e"), (501, "", "e"), (502, "1\n\n", "e"), docs[0]], "doc_id bigint, text string, item_id string")
    tests = spark.createDataFrame([*items, (900, None), (901, ""), (None, "x"), (902, "two words")], "item_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]) for x in L.find_leaks(df, tests).collect()}
    assert got == want
    assert rows(L.find_leaks(df.limit(0), tests)) == []
    assert rows(L.find_leaks(df, tests.limit(0))) == []
    # shuffled to the tests instead: the same rows
    for parts in (L.HOT_PARTS, 1 << 40):  # also with every fingerprint hot
        was, L.HOT_PARTS = L.HOT_PARTS, parts
        try:
            assert rows(L.find_leaks(df, tests, broadcast_postings=0)) == rows(L.find_leaks(df, tests))
        finally:
            L.HOT_PARTS = was


def test_passages_of_shared_words_are_found(spark):
    """Items whose first three fifths use the same thirty words, in another order each: no word there is rare, but the passage is verbatim."""
    r = random.Random(5)
    shared = NAMES[:30]
    items = [(i, " ".join([*(r.choice(shared) for _ in range(30)), *r.sample(NAMES[30:], 20)])) for i in range(60)]
    docs = [(i, as_cues(text(r, 60).split() + t.split()[:30] + text(r, 60).split(), r)) for i, t in items]
    got = {(x["doc_id"], x["item_id"]) for x in L.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(i, i) for i in range(60)}


def test_any_cut_of_the_tests_gives_the_same_rows(spark):
    r = random.Random(9)
    items = [(i, text(r, r.randint(12, 70))) for i in range(30)]
    docs = [(d, as_cues(text(r, 80).split() + items[d % 30][1].split()[: 8 + d] + text(r, 80).split(), r)) for d in range(60)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    whole = rows(L.find_leaks(df, spark.createDataFrame(items, "item_id bigint, text string")))
    cut = [x for k in range(3) for x in rows(L.find_leaks(df, spark.createDataFrame(items[k::3], "item_id bigint, text string")))]
    assert len(whole) > 20 and sorted(cut, key=repr) == whole


def test_winnowing_keeps_a_fingerprint_of_every_long_enough_shared_run():
    r = np.random.default_rng(0)
    for _ in range(200):
        shared = r.integers(1, 500, L.K + L.WINDOW - 1)
        a = np.concatenate([r.integers(500, 900, r.integers(0, 9)), shared, r.integers(500, 900, r.integers(0, 9))])
        b = np.concatenate([r.integers(900, 1300, r.integers(0, 9)), shared, r.integers(900, 1300, r.integers(0, 9))])
        fa, fb = (set(L.fingerprints(x, np.array([0]))[1].tolist()) for x in (a, b))
        assert fa & fb


def test_alignment_against_a_plain_one():
    r = random.Random(3)
    for _ in range(40):
        item = [r.randrange(1, 8) for _ in range(r.randint(1, 12))]
        doc = [r.randrange(1, 8) for _ in range(r.randint(1, 20))]
        # score, equal words, item words of the best alignment that ends at each place, by plain recursion
        best = [[(0, 0, 0)] * (len(doc) + 1) for _ in range(len(item) + 1)]
        for i, w in enumerate(item, 1):
            for j, x in enumerate(doc, 1):
                s, e, n = best[i - 1][j - 1]
                u, f, m = best[i - 1][j]
                v, g, k = best[i][j - 1]
                top = max((s + L.MATCH, e + 1, n + 1) if x == w else (s - L.DIFFERENT, e, n + 1), (u - L.SKIPPED, f, m + 1), (v - L.INSERTED, g, k))
                best[i][j] = top if top[0] > 0 else (0, 0, 0)
        equal, stretch, last, end = L.align(np.array([item]), np.array([doc]))
        top = max(x for row in best for x in row)
        assert (equal[0], stretch[0]) == top[1:]
        assert not top[0] or best[last[0] + 1][end[0] + 1] == top


def test_plain_and_damaged_passages_little_longer_than_two_fifths(spark):
    r = random.Random(7)
    # an item's second half has few names
    items = [[*map(r.choice, [NAMES] * 25)] + [r.choice(NAMES if k % 8 == 4 else COMMON) for k in range(25)] for _ in range(60)]
    docs, want = [], set()
    for i, w in enumerate(items):
        for kind in range(4):
            part = w[28:] if kind == 0 else w[4:26] if kind == 1 else w[:20] if kind == 2 else w[5:23]
            if kind == 1:  # the words next to both ends are replaced
                part = [part[0], "qqqqqqq", *part[2:-2], "zzzzzzz", part[-1]]
            if kind < 3:
                want.add((len(docs), i))
            docs.append((len(docs), " ".join(["xyzzyx"] * 30 + part + ["yzxxzy"] * 30)))
    got = L.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string"))
    assert {(x["doc_id"], x["item_id"]) for x in got.collect()} == want


def test_a_document_of_many_batches(spark):
    """A very long document whose rows fill several batches, in which every item stands, and damage by insertion."""
    r = random.Random(2)
    items = [(i, text(r, 40)) for i in range(300)]
    long = "\n".join(text(r, 30) + " " + t for _ in range(3) for _, t in items)
    spread = "\n".join(" ".join(x for w in items[0][1].split() for x in (w, "zzz", "yyy")) for _ in range(1))
    df = spark.createDataFrame([(1, long), (2, spread), (3, items[7][1])], "doc_id bigint, text string")
    got = {(x["doc_id"], x["item_id"]) for x in L.find_leaks(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(1, i) for i in range(300)} | {(3, 7)}


def test_stock_phrases_are_no_case_but_the_passage_with_its_names_is(spark):
    r = random.Random(13)
    stock = [" ".join(r.sample(COMMON, 6)) for _ in range(12)]
    items, decoys = [], []
    for i in range(40):
        phrases = r.sample(stock, 6)
        items.append((i, " ".join(f"{p} {r.choice(NAMES)}" for p in phrases)))
        decoys.append((100 + i, "\n".join(f"{p} {r.choice(NAMES)}" for p in phrases[:4])))  # four phrases in order, other names
    docs = [(i, "\n".join(text(r, 8) for _ in range(4)) + "\n" + t) for i, t in items] + decoys
    df, tests = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {(x["doc_id"], x["item_id"]) for x in L.find_leaks(df, tests).collect()} == {(i, i) for i in range(40)}
    # tests that are copies of each other have nothing telling, and are found all the same
    same = spark.createDataFrame([(i, items[0][1]) for i in range(20)], "item_id bigint, text string")
    assert {(x["doc_id"], x["item_id"]) for x in L.find_leaks(df.where("doc_id < 1"), same).collect()} == {(0, i) for i in range(20)}
