import random

import numpy as np
import pytest
from conftest import rows

from millrace.llm import language as L
from millrace.llm.subtitles import Alphabet, cues

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def samples(spark):
    return spark.read.parquet(f"{SF}/lang_sample.parquet")


def srt(lines):
    return "\n".join(f"{i}\n00:00:{i % 60:02d},000 --> 00:00:{i % 60:02d},900\n{x}\n" for i, x in enumerate(lines, 1))


def test_held_out_accuracy(samples):
    data = [(r["lang"], r["text"]) for r in samples.collect()]
    random.Random(0).shuffle(data)
    model = L.TextModel(data[: len(data) // 2])
    scores = L.WordScores(model)
    found, counts, _ = L.cue_scores(scores, [srt([t]) for _, t in data[len(data) // 2 :]])
    right = [model.languages[k] == lang for k, (lang, _) in zip(found.argmax(axis=1), data[len(data) // 2 :])]
    assert counts.sum() == len(right) and np.mean(right) > 0.97


def test_segments_labels_and_odd_documents(spark, samples):
    by = {}
    for r in samples.collect():
        by.setdefault(r["lang"], []).append(r["text"])
    en, de, pl = by["en"], by["de"], by["pl"]
    docs = [
        (1, srt(en[:5]), "en-GB", "a.example"), (2, srt(en[:5]), "GERMAN", "a.example"), (3, srt(en[:4] + de[:4]), "en", None), (4, srt(en[:4] + de[:2] + en[4:8]), "eng", "b"),
        (5, srt(en[:2]), None, "b"), (6, srt(de[:3] + ["[TÜR KNALLT]", "Subtitles by x.example"] + pl[:3]), "und", "b"), (7, "", "en", "b"), (8, None, "en", "b"), (9, "1\n\n2\n", "en", "b"),
        (None, srt(en[:5]), "de", "b"), (10, srt(x.upper() for x in pl[:5]), "pl", None), (11, srt([t.encode("utf-8").decode("cp1252", "replace") for t in pl[5:10]]), "de", "c"), (12, "\n".join(f"{{{i}}}{{{i + 9}}}{t}" for i, t in enumerate(de[:4])), "it", "c"),
    ]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id bigint, text string, lang string, source string, seg_no int, declared int")
    got = {}
    for r in L.identify(df, samples).collect():
        got.setdefault(r["doc_id"], []).append((r["seg_no"], r["lang"], r["label_fits"]))
        assert 0 < r["confidence"] <= 1
    # 5 has two cues and 9 none: no segment, but a language
    want = {5: [(0, "en", False)], 9: [(0, "en", True)], 1: [(1, "en", True)], 2: [(1, "en", False)], 3: [(1, "en", True), (2, "de", True)], 4: [(1, "en", True)], 6: [(1, "de", False), (2, "pl", False)], 10: [(1, "pl", True)], 11: [(1, "pl", False)], 12: [(1, "de", False)]}
    assert {k: sorted(v) for k, v in got.items()} == want
    told = {r["doc_id"]: (r["lang"], r["n_segments"]) for r in L.document_languages(L.identify(df, samples)).collect()}
    assert {*told} == {*want} and told[5] == ("en", 0) and told[2] == ("en", 1) and told[3][1] == 2
    assert rows(L.identify(df.limit(0), samples)) == []
    with pytest.raises(ValueError):
        L.identify(df, samples.limit(0))


def test_letters_of_the_samples_are_usual():
    text = "Příliš žluťoučký kůň úpěl ďábelské ódy"
    assert Alphabet().oddness(text) > 0 == Alphabet(text).oddness(text)
    assert Alphabet(text).repair(text) == text
    assert Alphabet(text).repair(text.encode("utf-8").decode("cp437")) == text


def brute_segments(path):
    runs = []
    for x in path:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    out = []
    for x, n in runs:
        if n >= L.LEAST_CUES and (not out or out[-1] != x):
            out.append(x)
    return out


def test_segments_against_a_plain_scan_where_long_runs_decide():
    r = random.Random(9)
    for _ in range(200):
        path = [x for _ in range(r.randint(1, 6)) for x in [r.randrange(3)] * r.choice([1, 3, 4, 6])]
        doc, lang, *_ = L.segments(np.array(path), np.array([len(path)]))
        if max(path.count(x) for x in set(path)) >= 3 and brute_segments(path):
            assert set(brute_segments(path)) <= {int(x) for x in lang}


def test_a_stretch_that_only_short_ones_interrupt():
    doc, lang, first, last, own = L.segments(np.array([0, 0, 1, 0, 0]), np.array([5]))
    assert lang.tolist() == [0] and own.tolist() == [4]


def test_best_path_against_all_paths():
    r = np.random.default_rng(1)
    for _ in range(30):
        n = int(r.integers(1, 6))
        scores, prior = -r.random((n, 3)) * 8, np.log(r.dirichlet([1, 1, 1]))
        best = max(np.ndindex(*[3] * n), key=lambda p: prior[p[0]] + scores[0, p[0]] + sum(scores[t, p[t]] + (0 if p[t] == p[t - 1] else L.SWITCH + prior[p[t]]) for t in range(1, n)))
        assert L.best_paths(scores, np.array([n]), prior[None]).tolist() == list(best)


def test_labels(spark):
    given = ["EN", "en-GB", "eng", "English", "pt_BR", "Português", " fra ", "und", "unk", "", None, "Klingon", "es-419"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string")
    assert dict(rows(df.select("i", L.label_code(df["x"])))) == dict(enumerate(["en", "en", "en", "en", "pt", "pt", "fr", None, None, None, None, "klingon", "es"]))


def test_cues_leave_out_what_isnt_spoken():
    t = "﻿WEBVTT\n\n1\n00:01.000 --> 00:02.000\n<i>Hel-\nlo there</i>\n\n00:02.000 --> 00:03.000\n♪ la la ♪\n\n7\n00:03.000 --> 00:04.000\nSync and corrections: X\nx.example\n\n8\n00:03.000 --> 00:04.000\n- Yes. [laughs]\n- 42\n"
    assert cues(t.replace("\n", "\r\n")) == ["Hello there", "- Yes.  \n- 42"]
    assert cues("{1}{2}One|two\n{3}{4}(WIND)\n") == ["One\ntwo"]
    assert cues("plain text\n\n123\nmore") == ["plain text", "more"]


@pytest.mark.parametrize("wrong,right", [("cp1252", "utf-8"), ("cp437", "utf-8"), ("cp850", "cp1252"), ("cp1252", "cp1250")])
def test_encodings_are_repaired(wrong, right):
    text = "Zauważył zieloną łódź nad rzeką. Później zgubił żółty klucz." if right != "cp1252" else "El niño pequeño abrió el farol. ¿Quién lo olvidó? Mañana llegará después."
    broken = "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in text.encode(right))
    assert Alphabet().repair(broken) == text
    assert Alphabet().repair(text) == text


def test_russian_read_as_latin():
    text = "Старый садовник нашёл три старые карты возле колодца."
    assert Alphabet().repair(text.encode("cp1251").decode("latin-1")) == text


def test_more_words_in_weak_cues_of_one_task_than_the_first_table_holds(spark, samples):
    letters = "abcdefghijklmnopqrstuvwxyz"
    made = ["q" + letters[i % 26] + letters[i // 26 % 26] + letters[i // 676] + "x" for i in range(5000)]
    en = [r["text"] for r in samples.where("lang = 'en'").collect()]
    text = srt(en[:5] + [" ".join(made[i : i + 2]) for i in range(0, len(made), 2)] + en[:5])
    df = spark.createDataFrame([(1, text, "en", "a.example"), (2, srt(en[:5]), "en", "a.example")], "doc_id bigint, text string, lang string, source string").coalesce(1)
    got = L.identify(df, samples).collect()
    assert {(r["doc_id"], r["lang"]) for r in got} >= {(1, "en"), (2, "en")}
    model = L.TextModel([(r["lang"], r["text"]) for r in samples.collect()])
    scores = L.WordScores(model)
    assert all((scores.row(w) == model.score(w)).all() for w in made) and len(scores.table) > 4096


def test_a_large_sample_keeps_every_language(spark, samples, monkeypatch):
    monkeypatch.setattr(L, "MAX_SAMPLE", 40)
    ru = [r["text"] for r in samples.where("lang = 'ru'").collect()]
    df = spark.createDataFrame([(1, srt(ru[:5]), "en", "a.example")], "doc_id bigint, text string, lang string, source string")
    assert [r["lang"] for r in L.identify(df, samples).collect()] == ["ru"]
