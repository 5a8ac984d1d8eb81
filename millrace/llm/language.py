"""The language of documents and of each segment of a mixed one, with a confidence (problem 8).

Method: Bayesian evidence fusion. A cue's text gives a likelihood per language (words, backed off to letters).
Priors come from all documents by grouped aggregation: how often each declared label, each source and each source's
address suffix goes with a language, smoothed from the whole corpus to the suffix to the source. Text and priors
meet in a chain over a document's cues that pays for every change of language; its best path gives the segments.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.subtitles import Alphabet, cues
from millrace.operators.durable import durable
from millrace.operators.joins import salted_join

#: Labelled rows that the text model is fitted on, at most.
MAX_SAMPLE = 20_000
#: Cues of one language in a row that make a segment.
LEAST_CUES = 3
#: What a change of language from one cue to the next costs, as a log probability.
SWITCH = -4.0
#: Weight of the letter model against counted words; of the corpus against a suffix, and of that against a source or label, in documents.
BACKOFF, SUFFIX_WEIGHT, HOST_WEIGHT = 2.0, 50.0, 10.0
#: A word that no sample holds counts less, as names belong to no language; it can't weigh more than so many nats.
UNKNOWN_WEIGHT, UNKNOWN_MOST = 0.5, 4.0
#: A cue is weak if its second language is within so many nats of the first. Its words are then judged by how often they stand in weak
#: cues of documents of each language, counted over the whole corpus. Words of less than one part in LEARNED of those counts are left.
WEAK, LEARNED, LEARNED_LEAST, LEARNED_MOST = 12.0, 20_000, 5, 6.0
#: Scores below the best by more than this are the same; a cue's scores are kept in one byte each.
DEEPEST = 51.0

# Other ways in which a language is named.
_NAMES = {
    "en": "en eng english anglais englisch",
    "es": "es spa esp spanish castellano espanol español",
    "pt": "pt por portuguese portugues português",
    "fr": "fr fra fre french francais français",
    "de": "de deu ger german deutsch",
    "nl": "nl nld dut dutch nederlands",
    "pl": "pl pol polish polski",
    "ru": "ru rus russian русский",
    "it": "it ita italian italiano",
    "cs": "cs ces cze czech",
    "bg": "bg bul bulgarian",
    "uk": "uk ukr ukrainian",
}
_CODE_OF = {name: code for code, names in _NAMES.items() for name in names.split()}
_MISSING = ("", "und", "unk", "unknown", "none", "null", "n/a", "mul", "zxx")


def label_code(label: Column) -> Column:
    """The two-letter code of a label in any notation; null if it is missing; what it says, in lower case, if it is unknown."""
    first = F.lower(F.regexp_extract(F.trim(label), r"^[\p{L}/]*", 0))
    codes = F.create_map(*(F.lit(x) for pair in _CODE_OF.items() for x in pair))
    return F.when(label.isNull() | first.isin(*_MISSING), None).otherwise(F.coalesce(F.try_element_at(codes, first), first))


_TOKEN = re.compile(r"[^\W\d_]+|\x01")


class _Bare(dict):
    """Character -> the letter without its accent, worked out when first met."""

    def __missing__(self, code: int):
        c = chr(code).lower()
        base = c if ord(c[0]) < 128 or "а" <= c[0] <= "ё" else "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        self[code] = {"ł": "l", "ß": "ss"}.get(base, base)
        return self[code]


_BARE = _Bare()


class TextModel:
    """Log probability of a word in each language: counted words, backed off to runs of three letters."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.languages = sorted({lang for lang, _ in samples})
        self.alphabet = Alphabet("".join({c for _, text in samples for c in text}))
        self.words: list[Counter] = [Counter() for _ in self.languages]
        self.runs: list[Counter] = [Counter() for _ in self.languages]
        self.pairs: list[Counter] = [Counter() for _ in self.languages]
        for lang, text in samples:
            i = self.languages.index(lang)
            found = [w for w in _TOKEN.findall(text.translate(_BARE)) if w != "\x01"]
            self.words[i].update(found)
            for w in found:
                padded = f"\x02\x02{w}\x03"
                self.runs[i].update(padded[k : k + 3] for k in range(len(padded) - 2))
                self.pairs[i].update(padded[k : k + 2] for k in range(len(padded) - 2))
        self.letters = len({c for runs in self.runs for r in runs for c in r}) + 1
        self.totals = [sum(w.values()) for w in self.words]

    def score(self, word: str) -> np.ndarray:
        padded = f"\x02\x02{word}\x03"
        out = np.empty(len(self.languages))
        for i in range(len(self.languages)):
            runs, pairs = self.runs[i], self.pairs[i]
            spelled = sum(math.log((runs[padded[k : k + 3]] + 0.1) / (pairs[padded[k : k + 2]] + 0.1 * self.letters)) for k in range(len(padded) - 2))
            out[i] = math.log((self.words[i][word] + BACKOFF * math.exp(spelled)) / (self.totals[i] + BACKOFF)) if spelled > -600 else -600
        out -= out.max()
        if not any(w[word] for w in self.words):
            out = np.maximum(out * UNKNOWN_WEIGHT, -UNKNOWN_MOST)
        return out


class WordScores(dict):
    """Word -> row of ``table``; a new word is scored when first met."""

    LIMIT = 500_000

    def __init__(self, model: TextModel):
        super().__init__()
        self.model, self.table = model, np.zeros((4096, len(model.languages)))
        self["\x01"] = 0

    def __missing__(self, word: str) -> int:
        n = len(self)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[n] = self.model.score(word.translate(_BARE))
        self[word] = n
        return n

    def row(self, word: str) -> np.ndarray:
        """A word's scores. ``table[self[word]]`` would look in the old table where a new word makes it larger."""
        n = self[word]
        return self.table[n]

    def trim(self) -> None:
        """Forgets all words once there are many, so that a task's memory is bounded; between batches only."""
        if len(self) > self.LIMIT:
            self.clear()
            self["\x01"] = 0


def _relative(sums: np.ndarray) -> np.ndarray:
    return sums - sums.max(axis=-1, keepdims=True)


def cue_scores(scores: WordScores, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """The cues' scores of many documents end to end, each relative to its best language; the number of cues of each document; the words of each weak cue."""
    spoken = [cues(scores.model.alphabet.repair(t)) if t else [] for t in texts]
    counts = np.array([len(c) for c in spoken], np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros((0, len(scores.model.languages))), counts, []
    tokens = _TOKEN.findall("\x01" + "\x01".join(c.lower() for d in spoken for c in d))
    ids = np.fromiter(map(scores.__getitem__, tokens), np.int64, len(tokens))
    starts = np.flatnonzero(ids == 0)
    sums = np.add.reduceat(scores.table[ids], starts, axis=0)
    sums = _relative(sums)
    ends = np.append(starts[1:], len(tokens))
    return sums, counts, [tokens[starts[k] + 1 : ends[k]] for k in weak_cues(sums)]


def weak_cues(scores: np.ndarray) -> np.ndarray:
    """The cues whose best language isn't clear from the samples' words."""
    return np.flatnonzero(np.sort(scores, axis=1)[:, -2] > -WEAK) if scores.shape[1] > 1 else np.empty(0, np.int64)


def best_paths(scores: np.ndarray, counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """The language number of every cue: the best path of each document, all documents step by step together."""
    states = scores.shape[1] if scores.ndim == 2 else 0
    path = np.zeros(len(scores), np.int64)
    starts = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    if not len(order):
        return path
    longest = int(counts[order[0]])
    back = np.zeros((longest, len(order), states), np.int8)
    live = np.array([(counts[order] > t).sum() for t in range(longest)])
    value = prior[order] + scores[starts[order]]
    for t in range(1, longest):
        n = live[t]
        v = value[:n]
        best = v.argmax(axis=1)
        jump = v[np.arange(n), best][:, None] + SWITCH + prior[order[:n]]
        stay = v
        switched = jump > stay
        back[t, :n] = np.where(switched, best[:, None], np.arange(states))
        value[:n] = np.where(switched, jump, stay) + scores[starts[order[:n]] + t]
    now = value.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        n = live[t]
        path[starts[order[:n]] + t] = now[:n]
        now[:n] = back[t, np.arange(n), now[:n]]
    return path


def segments(path: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, language, first cue, last cue, cues of that language) of every segment, in text order; shorter stretches are passed over."""
    doc = np.repeat(np.arange(len(counts)), counts)
    n = len(path)
    if not n:
        return (np.empty(0, np.int64),) * 5
    fresh = np.ones(n, bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (path[1:] != path[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], n) - 1
    spoken = last - first + 1
    long = spoken >= LEAST_CUES
    lang = path[first]
    extra = _interrupted(doc[first], lang, spoken, long)
    if extra:
        # a language whose stretches are all short, but which only short stretches of others interrupt
        head, tail, own = np.array(extra).T
        first, last, spoken = (np.concatenate([x[long], y]) for x, y in ((first, first[head]), (last, last[tail]), (spoken, own)))
        lang = np.concatenate([lang[long], lang[head]])
        order = np.argsort(first, kind="stable")
        first, last, spoken, lang = (x[order] for x in (first, last, spoken, lang))
    else:
        first, last, spoken, lang = first[long], last[long], spoken[long], lang[long]
    if not len(first):
        return (np.empty(0, np.int64),) * 5
    join = np.ones(len(first), bool)
    join[1:] = (doc[first[1:]] != doc[first[:-1]]) | (lang[1:] != lang[:-1])
    head = np.flatnonzero(join)
    tail = np.append(head[1:], len(join)) - 1
    return doc[first[head]], lang[head], first[head], last[tail], np.add.reduceat(spoken, head)


def _interrupted(doc: np.ndarray, lang: np.ndarray, spoken: np.ndarray, long: np.ndarray) -> list[tuple[int, int, int]]:
    """(first run, last run, own cues) of the language with the most cues between two long runs, if it has enough and neither of them is in it."""
    out = []
    edge = np.ones(len(doc) + 1, bool)
    edge[1:-1] = (doc[1:] != doc[:-1]) | long[1:] | long[:-1]
    at = np.flatnonzero(edge)
    for a, b in zip(at[:-1], at[1:]):
        if b - a > 2 and not long[a]:
            own = np.bincount(lang[a:b], spoken[a:b]).astype(np.int64)
            best = int(own.argmax())
            beside = {int(lang[k]) for k in (a - 1, b) if 0 <= k < len(doc) and doc[k] == doc[a]}
            if own[best] >= LEAST_CUES and best not in beside:
                runs = np.flatnonzero(lang[a:b] == best) + a
                out.append((int(runs[0]), int(runs[-1]), int(own[best])))
    return out


def _log_share(counts: Column, parent: Column, weight: float) -> Column:
    """Counts smoothed towards a parent distribution."""
    return F.zip_with(counts, parent, lambda c, p: (c + p * weight) / (F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) + weight))


def _learn(read: DataFrame, states: int) -> dict[str, np.ndarray]:
    """Words of weak cues -> their score in each language, from the documents that hold them. At most LEARNED words."""
    said = read.where("size(__weak) > 0").select("__lang", F.explode(F.split(F.array_join("__weak", " "), " ")).alias("w")).where("w != ''")
    counted = said.groupBy("w", "__lang").agg(F.count(F.lit(1)).alias("n"))
    totals = {r["__lang"]: r["n"] for r in counted.groupBy("__lang").agg(F.sum("n").alias("n")).collect()}
    least = max(LEARNED_LEAST, sum(totals.values()) // LEARNED)
    per_word = counted.groupBy("w").agg(*(F.sum(F.when(F.col("__lang") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(states)), F.sum("n").alias("n"))
    size = np.array([totals.get(i, 0) for i in range(states)], float)
    out = {}
    for r in per_word.where(F.col("n") >= least).collect():
        share = (np.array([r[f"n{i}"] for i in range(states)]) + 0.5) / (size + states)
        out[r["w"]] = np.maximum(_relative(np.log(share)), -LEARNED_MOST)
    return out


def identify(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """One row per segment: doc_id, seg_no, lang, confidence, n_cues, declared (code or null), label_fits, n_segments.

    ``documents``: doc_id, text, lang, source; ``samples``: lang (code), text, of which at most MAX_SAMPLE rows,
    spread evenly over the languages, are read. A segment is a stretch of at least LEAST_CUES spoken cues in one language; sounds, adverts and shorter
    stretches make no segment and end none. ``label_fits``: the label names the language of some segment.
    A document without a segment gives one row of ``seg_no`` 0 with its most likely language: by what it says, if
    anything, and by label and source. A null id or text, or an empty text, gives no row. Null labels and sources
    give no evidence beyond the corpus. Exact repeated rows give repeated segments. Other columns are ignored.
    """
    labelled = samples.where("lang is not null and text is not null").select("lang", "text")
    fitted = labelled.limit(MAX_SAMPLE + 1).collect()
    if len(fitted) > MAX_SAMPLE:
        # as many of each language as there is room for, so that none is left out
        ranked = labelled.withColumn("__n", F.row_number().over(Window.partitionBy("lang").orderBy("text"))).where(F.col("__n") <= MAX_SAMPLE)
        fitted = ranked.orderBy("__n", "lang").limit(MAX_SAMPLE).collect()
    spark = documents.sparkSession
    model = TextModel([(r["lang"], r["text"]) for r in fitted])
    names, states = model.languages, len(model.languages)
    if not states:
        raise ValueError("no labelled sample")
    shared = spark.sparkContext.broadcast(model)
    rows = documents.where("doc_id is not null and text is not null and text != ''").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", label_code(F.col("lang")).alias("declared"), F.col("source").cast("string").alias("source")
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = WordScores(shared.value)
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                part = pdf.iloc[i : i + 256]
                scores.trim()
                found, counts, weak = cue_scores(scores, part["text"].tolist())
                whole = np.zeros((len(part), states))
                has = counts > 0
                if has.any():
                    whole[has] = np.add.reduceat(np.maximum(found, -10), (np.cumsum(counts) - counts)[has], axis=0)
                packed = np.clip(-found / DEEPEST * 255, 0, 255).round().astype(np.uint8)
                cuts = np.split(packed, np.cumsum(counts)[:-1])
                out = part[["doc_id", "declared", "source"]].copy()
                out["__lang"] = np.where(has, whole.argmax(axis=1), -1)
                out["__scores"] = [c.tobytes() for c in cuts]
                at, offsets = weak_cues(found), np.cumsum(counts) - counts
                doc = np.searchsorted(offsets, at, "right") - 1 if len(at) else at
                of_doc: list[dict] = [{"at": [], "words": []} for _ in range(len(part))]
                for k, j, w in zip(at, doc, weak):
                    of_doc[j]["at"].append(int(k - offsets[j]))
                    of_doc[j]["words"].append(" ".join(w))
                out["__weak_at"], out["__weak"] = [x["at"] for x in of_doc], [x["words"] for x in of_doc]
                yield out

    # one byte a cue and language is kept, so that the texts are read once
    read_ = durable(rows.mapInPandas(read, "doc_id bigint, declared string, source string, __lang int, __scores binary, __weak_at array<int>, __weak array<string>"))
    learned = spark.sparkContext.broadcast(_learn(read_, states))
    suffix = F.regexp_extract(F.lower("source"), r"\.([a-z]{2,})$", 1)
    evidence = read_.withColumn("__suffix", F.coalesce(suffix, F.lit("")))
    even = F.array(*[F.lit(1.0 / states)] * states)
    # grouped first by all three, so that the three priors are rolled up from few rows
    counted = evidence.where("__lang >= 0").groupBy("declared", "source", "__suffix", "__lang").agg(F.count(F.lit(1)).cast("double").alias("n"))

    def share(by: list[str], parent: Column, weight: float) -> Column:
        sums = F.array(*(F.sum(F.when(F.col("__lang") == i, F.col("n")).otherwise(0.0)) for i in range(states)))
        return counted.groupBy(*by).agg(sums.alias("__counts")).select(*by, _log_share(F.col("__counts"), parent, weight).alias("__share"))

    everywhere = [r["__share"] for r in share([], even, 1.0).collect()]
    known = bool(everywhere) and everywhere[0] is not None and None not in everywhere[0]  # not so in an empty corpus
    corpus = everywhere[0] if known else [1.0 / states] * states
    top = F.array(*(F.lit(float(x)) for x in corpus))
    by_suffix = share(["__suffix"], top, SUFFIX_WEIGHT).withColumnRenamed("__share", "__above")
    sums = F.array(*(F.sum(F.when(F.col("__lang") == i, F.col("n")).otherwise(0.0)) for i in range(states)))
    by_source = (
        counted.where("source is not null").groupBy("source", "__suffix").agg(sums.alias("__counts")).join(by_suffix, "__suffix")
        .select(F.col("source"), _log_share(F.col("__counts"), F.col("__above"), HOST_WEIGHT).alias("__host"))
    )
    by_label = share(["declared"], top, HOST_WEIGHT).where("declared is not null").withColumnRenamed("__share", "__label")
    # one source, or one label, may hold much of the corpus
    joined = salted_join(salted_join(evidence, by_source, ["source"]), by_label, ["declared"])
    # corpus x (source / corpus) x (label / corpus)
    prior = F.transform(F.arrays_zip(F.coalesce("__host", top).alias("h"), F.coalesce("__label", top).alias("l"), top.alias("c")), lambda x: F.log(x["h"]) + F.log(x["l"]) - F.log(x["c"]))
    fused = joined.select("doc_id", "declared", "__scores", "__weak_at", "__weak", prior.alias("__prior"))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, known = WordScores(shared.value), learned.value
        for pdf in batches:
            words.trim()
            for i in range(0, len(pdf), 256):
                part = pdf.iloc[i : i + 256]
                raw = [np.frombuffer(b, np.uint8).reshape(-1, states) for b in part["__scores"]]
                counts = np.array([len(r) for r in raw], np.int64)
                scores = np.concatenate(raw) / -255 * DEEPEST
                for start, at, weak in zip(np.cumsum(counts) - counts, part["__weak_at"], part["__weak"]):
                    for k, cue in zip(at, weak):
                        scores[start + k] = _relative(sum((known[w] if w in known else words.row(w) for w in cue.split()), np.zeros(states)))
                prior = np.array(part["__prior"].tolist())
                prior -= np.log(np.exp(prior).sum(axis=1, keepdims=True))
                path = best_paths(scores, counts, prior)
                doc, lang, first, last, spoken = segments(path, counts)
                bare = np.setdiff1d(np.arange(len(counts)), doc)
                if len(bare):
                    # no segment: all cues together, and the priors
                    told = prior[bare] + np.array([scores[a : a + n].sum(axis=0) for a, n in zip((np.cumsum(counts) - counts)[bare], counts[bare])])
                    told = np.exp(_relative(told))
                    most = told.argmax(axis=1)
                    own, codes = part.iloc[bare], np.array(names)[most]
                    yield pd.DataFrame(
                        {"doc_id": own["doc_id"], "seg_no": 0, "lang": codes, "confidence": told[np.arange(len(bare)), most] / told.sum(axis=1), "n_cues": counts[bare], "declared": own["declared"], "label_fits": codes == own["declared"].to_numpy(), "n_segments": 0}
                    )
                if not len(doc):
                    continue
                belief = np.exp(scores + np.repeat(prior, counts, axis=0))
                belief = belief[np.arange(len(path)), path] / belief.sum(axis=1)
                # of the segment's own cues; cues of shorter stretches within it don't count
                own = np.array([belief[a : b + 1][path[a : b + 1] == x].mean() for a, b, x in zip(first, last, lang)])
                fresh = np.ones(len(doc), bool)
                fresh[1:] = doc[1:] != doc[:-1]
                head = np.flatnonzero(fresh)
                seg_no = np.arange(len(doc)) - np.repeat(head, np.diff(np.append(head, len(doc)))) + 1
                codes = np.array(names)[lang]
                declared = part["declared"].to_numpy()[doc]
                fits = np.zeros(len(counts), bool)
                np.logical_or.at(fits, doc, codes == declared)
                yield pd.DataFrame(
                    {"doc_id": part["doc_id"].to_numpy()[doc], "seg_no": seg_no, "lang": codes, "confidence": own, "n_cues": spoken, "declared": declared, "label_fits": fits[doc], "n_segments": np.bincount(doc, minlength=len(counts))[doc]}
                )

    return fused.mapInPandas(decide, "doc_id bigint, seg_no int, lang string, confidence double, n_cues int, declared string, label_fits boolean, n_segments int")


def document_languages(segments_: DataFrame) -> DataFrame:
    """One row per document of the result of ``identify``: doc_id, lang (of most cues, of equally many the first code), confidence (the mean over its cues), n_segments."""
    per = segments_.groupBy("doc_id", "lang").agg(F.sum("n_cues").alias("n"), F.sum(F.col("confidence") * F.greatest("n_cues", F.lit(1))).alias("c"), F.sum(F.greatest("n_cues", F.lit(1))).alias("w"), F.max("n_segments").alias("n_segments"))
    best = F.max_by(F.struct("lang", "c", "w", "n_segments"), F.struct("n", F.lit(1) - F.ascii("lang"), F.lit(0) - F.ascii(F.substring("lang", 2, 1))))
    return per.groupBy("doc_id").agg(best.alias("b")).select("doc_id", "b.lang", (F.col("b.c") / F.col("b.w")).alias("confidence"), "b.n_segments")
