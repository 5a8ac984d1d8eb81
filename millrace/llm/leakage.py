"""Passages of held-out texts inside a training corpus (problem 7).

Method: winnowing. Words are folded (letter case, accents, letters that scanning confuses); of every w successive
hashes of k words the least is kept as a fingerprint, in corpus and test texts alike, so any shared run of w + k - 1
words has a fingerprint in common. The corpus is read once; its fingerprints are joined by hash with those of the test
texts; the hits of a document and an item that lie near one diagonal are extended by a local alignment of the words
around them, and the aligned share of the item decides. No word counts more than another; a passage that consists of
phrases which many test texts share is no case.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.subtitles import Alphabet, cues
from millrace.operators.durable import durable

K, WINDOW = 4, 3
#: Share of an item's words that must be aligned, from the first aligned word to the last.
SHARE = 0.4
#: Share of the words in that stretch, and in the document's, which must be equal: small damage is at most a word in four,
#: and half of that where an even alignment has to reach over it.
DENSITY = 0.75
#: Width of a band of diagonals in words; bands overlap by half.
BAND = 24
#: Different fingerprints in one band that make a candidate; fewer where an undamaged passage of the least length may have fewer.
LEAST_HITS = 3
#: A fingerprint is telling if at most HELD test texts hold it, or one part in HELD_PART of them. TELLING different ones
#: make a candidate as well, and a passage, once aligned, must have as many, or as many as the item has: phrases that many test texts share are no case.
HELD, HELD_PART, TELLING = 3, 100, 2
#: Fingerprints and bytes of test texts up to which they are broadcast; beyond, the corpus' hits are shuffled to them.
BROADCAST_POSTINGS, BROADCAST_BYTES = 2_000_000, 64 << 20
#: Slots of the filter that keeps corpus fingerprints no test text has from leaving their task: so many for each of the tests', at most.
FILTER_SLOTS, FILTER_MOST = 32, 1 << 26
#: A fingerprint with more than one part in HOT_PARTS of the corpus' hits is hot: there are at most so many, and each is split over SALTS.
HOT_PARTS, SALTS = 200, 64
#: Candidates aligned at a time, so that a batch's memory is bounded; the longest test text in words.
AT_ONCE, LONGEST = 256, 500_000

_WORD = re.compile(r"\w+")
# Letters that scanning confuses, each with the letter that stands for its group.
_CONFUSED = {"c": "e", "b": "h", "f": "t", "i": "l", "1": "l", "j": "l", "0": "o", "5": "s", "ł": "l", "ø": "o", "đ": "d", "ß": "s", "æ": "e", "œ": "e", "ё": "е"}


class _Fold(dict):
    """Character -> what stands for it, worked out when first met."""

    def __missing__(self, code: int):
        c = chr(code).lower()
        base = unicodedata.normalize("NFKD", c) if ord(c[0]) > 127 and not "а" <= c[0] <= "ё" else c
        kept = "".join(_CONFUSED.get(x, x) for x in base if not unicodedata.combining(x))
        self[code] = kept
        return kept


_FOLD = _Fold()


def words(text: str) -> list[str]:
    """The folded words of a text."""
    return _WORD.findall(text.translate(_FOLD).replace("rn", "m").replace("ss", "s"))


def document_words(text: str, alphabet: Alphabet) -> list[str]:
    """The words spoken in a document, as written."""
    spoken = "\n".join(cues(alphabet.repair(text)))
    return _WORD.findall(spoken if spoken.isascii() or unicodedata.is_normalized("NFC", spoken) else unicodedata.normalize("NFC", spoken))


def word_hash(folded: str) -> int:
    return int.from_bytes(hashlib.blake2b(folded.encode("utf-8", "replace"), digest_size=8).digest(), "little")


class Hashes(dict):
    """Word as written -> the 64-bit hash of the folded word; forgets all words once there are many, so that a task's memory is bounded."""

    LIMIT = 500_000

    def __missing__(self, written: str) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        n = self[written] = word_hash("".join(words(written)))
        return n


def fingerprints(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed fingerprints of many texts laid end to end: their places in ``ids`` and their hashes, none of them 0.

    ``ids``: the words' hashes; ``starts``: where each text begins. Texts of fewer than K words have none.
    """
    n = len(ids) - K + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    x = ids.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    valid = np.ones(n, bool)
    for j in range(K):
        h = (h ^ x[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    inside = starts[starts > 0]
    for j in range(1, K):  # runs that reach over the end of a text
        cut = inside - j
        valid[cut[(cut >= 0) & (cut < n)]] = False
    worst = np.uint64(0xFFFFFFFFFFFFFFFF)
    h = np.where(valid, np.maximum(h, np.uint64(1)), worst)
    padded = np.concatenate([np.full(WINDOW - 1, worst), h, np.full(WINDOW - 1, worst)])
    # the least of each window, and whether a place is the least of any window that holds it
    least = padded[: n + WINDOW - 1].copy()
    for j in range(1, WINDOW):
        np.minimum(least, padded[j : j + n + WINDOW - 1], out=least)
    chosen = np.zeros(n, bool)
    for j in range(WINDOW):
        chosen |= h == least[j : j + n]
    at = np.flatnonzero(chosen & valid)
    return at, h[at]


# What the alignment gives for an equal word and takes for a different, a skipped and an inserted one.
MATCH, DIFFERENT, SKIPPED, INSERTED = 4, 5, 4, 3
# What an even alignment takes for the three: one equal word then reaches over two damaged.
EVEN = 2, 3, 3


def align(items: np.ndarray, docs: np.ndarray, even: bool = False) -> tuple[np.ndarray, ...]:
    """Of each pair of rows the best local alignment: its equal words, the item's words from the first aligned to the last, and its ends in item and document.

    Rows are padded: items with -1, documents with -2. All pairs are worked through together, row by row. A cell holds score,
    equal words and length in one number, so that a maximum carries all three. ``even``: damage near an end doesn't cut it off.
    """
    pairs, n = docs.shape
    unit, equal_unit = 1 << 42, 1 << 21
    different, skipped, inserted = EVEN if even else (DIFFERENT, SKIPPED, INSERTED)
    ramp = np.arange(n, dtype=np.int64) * (inserted * unit)
    gain, loss, lost = MATCH * unit + equal_unit + 1, 1 - different * unit, 1 - skipped * unit
    above, best = np.zeros((pairs, n + 1), np.int64), np.zeros(pairs, np.int64)
    here = np.zeros((pairs, n), np.int64)
    last, end = np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
    for i in range(items.shape[1]):
        word = items[:, i : i + 1]
        # an equal word adds score, one equal word and one to the length; a skipped or different one adds to the length
        np.maximum(above[:, :-1] + np.where(docs == word, gain, loss), above[:, 1:] + lost, out=here)
        here[here < unit] = 0
        here += ramp
        np.maximum.accumulate(here, axis=1, out=here)
        here -= ramp
        here[(here < unit) | (word < 0)] = 0
        above[:, 1:] = here
        at = here.argmax(axis=1)
        top = here[np.arange(pairs), at]
        more = top > best
        best[more], last[more], end[more] = top[more], i, at[more]
    return (best % unit) // equal_unit, best % equal_unit, last, end


def least_hits(size, share: float = SHARE):
    """Of an item of ``size`` words the fingerprints that an undamaged passage of ``share`` of it has at least, up to LEAST_HITS; 1 where it may have none."""
    return np.clip(-(-(np.ceil(share * size) - (K + WINDOW - 2)) // WINDOW), 1, LEAST_HITS)


def candidates(doc: np.ndarray, place: np.ndarray, item: np.ndarray, spot: np.ndarray, size: np.ndarray, telling: np.ndarray, share: float = SHARE) -> tuple[np.ndarray, ...]:
    """Hits -> (document, item, item's words, least and greatest diagonal, telling hits) where enough different ones lie in a band; bands that touch make one."""
    band = (place - spot + (1 << 30)) // (BAND // 2)
    # each hit lies in two overlapping bands
    doc, place, item, spot, size, telling = (np.concatenate([x, x]) for x in (doc, place, item, spot, size, telling))
    band = np.concatenate([band, band - 1])
    order = np.lexsort((spot, band, item, doc))
    doc, place, item, spot, size, telling, band = (x[order] for x in (doc, place, item, spot, size, telling, band))
    if not len(doc):
        return (np.empty(0, np.int64),) * 6
    other = np.ones(len(doc), bool)
    other[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    fresh = other.copy()
    fresh[1:] |= band[1:] != band[:-1]
    new = fresh.copy()
    new[1:] |= spot[1:] != spot[:-1]
    first = np.flatnonzero(fresh)
    diagonal = place - spot
    low, high, hits = np.minimum.reduceat(diagonal, first), np.maximum.reduceat(diagonal, first), np.add.reduceat(new.astype(np.int64), first)
    told = np.add.reduceat((new & telling).astype(np.int64), first)
    keep = (hits >= least_hits(size[first], share)) | (told >= TELLING)
    first, low, high, told = first[keep], low[keep], high[keep], told[keep]
    if not len(first):
        return (np.empty(0, np.int64),) * 6
    doc, item, size, band = (x[first] for x in (doc, item, size, band))
    apart = np.ones(len(first), bool)
    apart[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] > band[:-1] + 1)
    head = np.flatnonzero(apart)
    return doc[head], item[head], size[head], np.minimum.reduceat(low, head), np.maximum.reduceat(high, head), np.maximum.reduceat(told, head)


def _deletions(word: str) -> list[str]:
    return [word[:i] + word[i + 1 :] for i in range(len(word))]


class ItemWords:
    """The words of an item by number; a word one letter off, of five letters or more, counts as the item's word."""

    def __init__(self, split: list[str]):
        self.known: dict[str, int] = {}
        self.ids = np.array([self.known.setdefault(w, len(self.known)) for w in split], np.int64)
        self.near: dict[str, int] = {}
        for w, n in self.known.items():
            if len(w) >= 5 and not w.isdigit():
                for d in _deletions(w):
                    self.near.setdefault(d, n)
        self.spelled = {*self.near, *(w for w in self.known if len(w) >= 5)}

    def number(self, word: str, shorter: frozenset[str]) -> int:
        """The number of the item's word, -2 if it has none like it. ``shorter``: the word without each of its letters."""
        n = self.known.get(word, -2)
        if n == -2 and shorter:
            n = self.near.get(word, -2)
            if n == -2 and not self.spelled.isdisjoint(shorter):
                n = min((self.known if d in self.known else self.near)[d] for d in shorter & self.spelled)
        return n


class _Spellings(dict):
    """Word as written -> the folded word, and that without each of its letters; empty for short words and numbers."""

    def __missing__(self, written: str) -> tuple[str, frozenset[str]]:
        if len(self) > Hashes.LIMIT // 5:
            self.clear()
        w = "".join(words(written))
        out = self[written] = (w, frozenset(_deletions(w)) if len(w) >= 5 and not w.isdigit() else frozenset())
        return out


def judge(items: list[np.ndarray], windows: list[np.ndarray], share: float, density: float) -> tuple[np.ndarray, ...]:
    """(pair, equal words, stretch) of the pairs that hold a passage."""
    out = [(np.empty(0, np.int64),) * 3]
    order = np.argsort([len(w) * len(i) for w, i in zip(windows, items)], kind="stable")
    at = 0
    while at < len(order):
        # as many as fit: long windows come in smaller lots
        width = max(len(windows[k]) for k in order[at : at + AT_ONCE])
        lot = order[at : at + max(1, min(AT_ONCE, AT_ONCE * 160 // max(1, width)))]
        at += len(lot)
        rows = np.full((len(lot), max(len(items[k]) for k in lot)), -1, np.int64)
        texts = np.full((len(lot), max(len(windows[k]) for k in lot)), -2, np.int64)
        for j, k in enumerate(lot):
            rows[j, : len(items[k])], texts[j, : len(windows[k])] = items[k], windows[k]
        least = share * (rows >= 0).sum(axis=1)
        near = np.arange(len(lot))
        for even in (False, True):
            equal, stretch, last, end = align(rows[near], texts[near], even)
            dense = (1 + density) / 2 if even else density
            fine = (stretch >= least[near] - 1e-9) & (equal >= dense * stretch - 1e-9) & (equal > 0)
            # what is inserted between the document's words is damage as well
            for j in np.flatnonzero(fine):
                k = near[j]
                back = align(rows[k : k + 1, last[j] :: -1], texts[k : k + 1, end[j] :: -1], even)
                fine[j] = equal[j] >= dense * (int(back[3][0]) + 1) - 1e-9
            out.append((lot[near[fine]], equal[fine], stretch[fine]))
            # damage near an end may have cut it off: those are aligned once more, evenly
            near = near[~fine & (stretch >= least[near] / 2)]
            if not len(near):
                break
    return tuple(np.concatenate(x) for x in zip(*out))


FOUND = "doc_id bigint, item_id bigint, equal_words int, stretch int, item_words int"
_SCANNED = "uid bigint, doc_id bigint, words string, h bigint, place int"


def _item_table(items: DataFrame) -> DataFrame:
    """(item_id, text, size, h, spot): the test texts with the hashes and places of their fingerprints as arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t in zip(pdf["item_id"], pdf["text"]):
                split = words(t)
                if len(split) > LONGEST:
                    raise ValueError(f"test text {i} has over {LONGEST} words")
                at, h = fingerprints(np.array([word_hash(w) for w in split], np.uint64), np.zeros(1, np.int64))
                out.append((i, " ".join(split), len(split), h.view(np.int64), at.astype(np.int32)))
            yield pd.DataFrame(out, columns=["item_id", "item_text", "size", "h", "spot"])

    return items.mapInPandas(run, "item_id bigint, item_text string, size int, h array<bigint>, spot array<int>")


def _filter_bits(postings: DataFrame, count: int) -> np.ndarray:
    """A bit for each slot that the hash of some posting falls into; the slots are bounded, and so is what is collected."""
    bits = min(max(1 << 12, 1 << (FILTER_SLOTS * max(1, count) - 1).bit_length()), FILTER_MOST).bit_length() - 1
    slot = F.shiftrightunsigned("h", 64 - bits)
    cells = postings.select(F.shiftright(slot, 6).alias("cell"), slot.bitwiseAND(63).cast("int").alias("bit"))
    cells = cells.groupBy("cell").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[cells["cell"].to_numpy()] = cells["mask"].to_numpy()
    return out.view(np.uint64)


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the slot of each hash is taken."""
    slot = h >> np.uint64(64 - (len(bits) * 64).bit_length() + 1)
    return ((bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)


def _scan(docs: DataFrame, bits, fewest: int, alphabet: Alphabet) -> DataFrame:
    """The one pass over the corpus. Of each document with enough fingerprints that pass the filter: a row with its words, then a row for each of these."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        hashes, taken, uid = Hashes(), bits.value, TaskContext.get().partitionId() << 40
        for pdf in batches:
            for i in range(0, len(pdf), 512):
                split = [document_words(t, alphabet) for t in pdf["text"].iloc[i : i + 512]]
                ids = np.fromiter((hashes[w] for s in split for w in s), np.uint64, sum(map(len, split)))
                lengths = np.array([len(s) for s in split], np.int64)
                starts = np.cumsum(lengths) - lengths
                at, h = fingerprints(ids, starts)
                some = passes(taken, h)
                at, h = at[some], h[some]
                doc = np.searchsorted(starts, at, "right") - 1
                times = np.bincount(doc, minlength=len(split))
                kept = np.flatnonzero(times >= fewest)
                if not len(kept):
                    uid += len(split)
                    continue
                some = times[doc] >= fewest
                at, h, doc = at[some], h[some], doc[some]
                head = np.searchsorted(doc, kept) + np.arange(len(kept))  # each document's first row holds its words
                n = len(doc) + len(kept)
                rest = np.ones(n, bool)
                rest[head] = False
                who, where, what, text = np.empty(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, None, object)
                who[head], who[rest] = kept, doc
                where[rest], what[rest] = at - starts[doc], h.view(np.int64)
                text[head] = [" ".join(split[k]) for k in kept]
                yield pd.DataFrame({"uid": uid + who, "doc_id": pdf["doc_id"].to_numpy(np.int64)[i + who], "words": text, "h": what, "place": where})
                uid += len(split)

    return docs.mapInPandas(run, _SCANNED)


def _windows(share: float):
    """Rows of each document, its words first -> (doc_id, item_id, window) for each candidate."""

    def some(pdf: pd.DataFrame) -> pd.DataFrame | None:
        head = np.flatnonzero(pdf["words"].notna().to_numpy())
        uid = pdf["uid"].to_numpy()
        if len(head) != 1 + np.count_nonzero(np.diff(uid)) or not len(head) or head[0] != 0 or (uid[head[1:]] == uid[head[1:] - 1]).any():
            raise RuntimeError("a document's rows don't stand together")
        lead = np.zeros(len(pdf), np.int64)
        lead[head] = 1
        doc = np.cumsum(lead) - 1
        hit = lead == 0
        place, item, spot, size, telling = (pdf[c].to_numpy()[hit].astype(np.int64) for c in ("place", "item_id", "spot", "size", "telling"))
        doc, item, size, low, high, told = candidates(doc[hit], place, item, spot, size, telling > 0, share)
        if not len(doc):
            return None
        split = {k: pdf["words"].iloc[head[k]].split(" ") for k in np.unique(doc)}
        windows = [" ".join(split[k][max(0, a - BAND // 2) : b + m + BAND]) for k, m, a, b in zip(doc, size, low, high)]
        return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[head[doc]], "item_id": item, "window": windows, "told": told})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            # the last document may go on in the next batch
            uid = pdf["uid"].to_numpy()
            last = len(uid) - int((uid[::-1] != uid[-1]).argmax() or len(uid))
            if last:
                found = some(pd.concat([*waiting, pdf.iloc[:last]]))
                waiting = []
                if found is not None:
                    yield found
            waiting.append(pdf.iloc[last:])
            if len({int(w["uid"].iloc[0]) for w in waiting}) > 1:
                found = some(pd.concat(waiting[:-1]))
                waiting = waiting[-1:]
                if found is not None:
                    yield found
        if waiting and (found := some(pd.concat(waiting))) is not None:
            yield found

    return run


def _extend(share: float, density: float):
    """(doc_id, item_id, window, told, item_text, item_tells) -> FOUND for those that hold a passage."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, ItemWords] = {}
        spelled = _Spellings()
        for pdf in batches:
            if len(known) > 5_000:
                known.clear()
            items, windows = [], []
            for i, text, window in zip(pdf["item_id"], pdf["item_text"], pdf["window"]):
                own = known.get(i)
                if own is None:
                    own = known[i] = ItemWords(text.split(" "))
                items.append(own.ids)
                windows.append(np.array([own.number(*spelled[w]) for w in window.split(" ")], np.int64))
            pair, equal, stretch = judge(items, windows, share, density)
            needed = np.minimum(TELLING, pdf["item_tells"].to_numpy())
            fine = pdf["told"].to_numpy()[pair] >= needed[pair]
            pair, equal, stretch = pair[fine], equal[fine], stretch[fine]
            if len(pair):
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[pair], "item_id": pdf["item_id"].to_numpy()[pair], "equal_words": equal, "stretch": stretch, "item_words": [len(items[k]) for k in pair]})

    return run


def find_leaks(documents: DataFrame, items: DataFrame, share: float = SHARE, density: float = DENSITY, broadcast_postings: int = BROADCAST_POSTINGS) -> DataFrame:
    """(doc_id, item_id, equal_words, stretch, item_words) for each document that holds a passage of an item; the widest if several.

    ``documents``: doc_id, text; ``items``: item_id, text. A passage is a stretch of at least ``share`` of the item's words, of
    which at least ``density`` stand in the document in order and in one place. Rows with a null id or text, and empty texts,
    match nothing; repeated rows give their result once; a document of any length is searched whole; an item_id with several
    texts is searched for by each. Other columns are ignored.

    The corpus is read once, whatever the number of tests. Test texts of at most ``broadcast_postings`` fingerprints meet the
    corpus' fingerprints where these are, and nothing of the corpus moves. Larger ones meet them in a shuffle by hash, of
    those only that pass a filter of bounded size; a hot hash is split. The rows are the same either way.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null and text != ''")
    tests = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null and text != ''").distinct()
    # a number of its own for each text: an id may have several
    table = durable(_item_table(tests).withColumn("real_id", F.col("item_id")).withColumn("item_id", F.xxhash64("item_id", "item_text")))
    postings = table.select(F.explode(F.arrays_zip("h", "spot")).alias("p"), "item_id", "size").select("p.h", "p.spot", "item_id", "size")
    sizes = table.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(F.size("h")), F.lit(0)).alias("n"), F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0)).alias("bytes"), F.min("size").alias("least")).first()
    if not sizes["n"]:
        return documents.sparkSession.createDataFrame([], FOUND)
    # how many test texts hold a fingerprint, counted over all of them
    held = postings.groupBy("h").agg(F.countDistinct("item_id").alias("held"))
    postings = durable(postings.join(held, "h").withColumn("telling", (F.col("held") <= max(HELD, sizes["items"] // HELD_PART)).cast("int")).drop("held"))
    tells = postings.groupBy("item_id").agg(F.countDistinct(F.when(F.col("telling") == 1, F.col("spot"))).cast("int").alias("item_tells"))
    small = sizes["n"] <= broadcast_postings and sizes["bytes"] <= BROADCAST_BYTES
    bits = documents.sparkSession.sparkContext.broadcast(_filter_bits(postings, sizes["n"]))
    # the tests' letters beyond ASCII; there are no more than Unicode has
    beyond = tests.select(F.explode(F.split(F.regexp_replace("text", r"[\x00-\x7f]", ""), "")).alias("c")).where("c != ''").distinct().collect()
    scanned = _scan(docs, bits, min(2, int(least_hits(sizes["least"], share))), Alphabet("".join(sorted(r["c"] for r in beyond))))
    texts = table.join(tells, "item_id").select("item_id", "real_id", "item_text", "item_tells")
    if small:
        met = scanned.join(F.broadcast(postings), "h", "left").where("words is not null or item_id is not null")
        texts = F.broadcast(texts)
    else:
        scanned = durable(scanned)
        marks = scanned.where("words is null").select("uid", "doc_id", "h", "place")
        total = marks.count()
        hot = [r["h"] for r in marks.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HOT_PARTS > total).collect()]
        is_hot = F.col("h").isin(hot) if hot else F.lit(False)
        salted = marks.withColumn("salt", F.when(is_hot, F.pmod("uid", F.lit(SALTS)).cast("int")).otherwise(0))
        spread = postings.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        hits = salted.join(spread, ["h", "salt"]).select("uid", "doc_id", F.lit(None).cast("string").alias("words"), "place", "item_id", "spot", "size", "telling")
        heads = scanned.where("words is not null").select("uid", "doc_id", "words", F.lit(0).alias("place"), *(F.lit(None).cast(k).alias(c) for c, k in (("item_id", "bigint"), ("spot", "int"), ("size", "int"), ("telling", "int"))))
        met = heads.unionByName(hits).repartition("uid").sortWithinPartitions("uid", F.col("words").isNull())
    # no nulls in the numbers: pandas would make them floats, and floats lose digits
    whole = [F.coalesce(c, F.lit(0)).alias(c) for c in ("item_id", "spot", "size", "telling")]
    windows = met.select("uid", "doc_id", "words", "place", *whole).mapInPandas(_windows(share), "doc_id bigint, item_id bigint, window string, told int")
    found = windows.join(texts, "item_id").select("doc_id", F.col("real_id").alias("item_id"), "window", "told", "item_text", "item_tells").mapInPandas(_extend(share, density), FOUND)
    best = F.max(F.struct("stretch", "equal_words", "item_words")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.equal_words", "b.stretch", "b.item_words")
