"""Texts of varying length into containers of fixed capacity with little unused space (problem 6).

Method: bin completion with branch and bound. Best fit gives the first solution of a lot. While that has more
containers than the lower bound, a search tries to pack some of its containers, drawn from the whole lot, into one
fewer: the largest text left is put into a container, the fillings around it of any number of texts that no other
filling dominates are enumerated, the least waste first, and a branch ends where its waste exceeds what one fewer
container leaves free. Texts meet in lots of a bounded number, so each lot is solved in one task and a corpus of any
size in as many tasks; a lot leaves at most its last containers partly filled.
"""

from __future__ import annotations

import base64
import random
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.durable import durable

#: Where the public tokenizers' files lie, and the one to measure by.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the tokenizer cuts text before it joins bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of a lot, on average.
LOT = 4_000
#: A search is over so many texts, or as many more as its lower bound needs, up to four times as many; it opens so many containers, and tries so many fillings of each.
WINDOW, NODES, WIDTH = 250, 120, 4
#: Searches of a lot at most, and how many may fail in a row.
ROUNDS, MISSES = 16, 4


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Characters encoded at a time; longer texts are cut between two of the tokenizer's own pieces. A longer piece is encoded whole.
SLICE = 1 << 16


@lru_cache(maxsize=1)
def _pieces():
    import regex

    return regex.compile(PATTERN)


def count_tokens(encoding, text: str | None) -> int:
    """The tokens of the whole text, as many as the tokenizer gives for it at once."""
    if not text:
        return 0
    if len(text) <= SLICE:
        return len(encoding.encode_ordinary(text))
    total, at = 0, 0
    for piece in _pieces().finditer(text):
        if piece.end() - at >= SLICE:
            total, at = total + len(encoding.encode_ordinary(text[at : piece.end()])), piece.end()
    return total + len(encoding.encode_ordinary(text[at:]))


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of each doc_id once; a null text has none, of repeated ids the longest text counts, a null id gives no row."""
    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(tokenizer)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [count_tokens(encoding, t) for t in pdf["text"]]})

    return rows.mapInPandas(run, "doc_id bigint, n_tokens bigint").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Containers that no packing can do without: by the sum, and by the large items that can't share (Martello and Toth's second bound)."""
    ordered = np.sort(np.array(sizes, np.int64))
    if not len(ordered):
        return 0
    sums = np.concatenate([[0], np.cumsum(ordered)])
    best = -(-int(sums[-1]) // capacity)
    half = int(np.searchsorted(ordered, capacity // 2, "right"))  # items above half of the capacity
    small = np.unique(ordered[: np.searchsorted(ordered, capacity // 2, "right")])
    for k in np.append(0, small):
        alone = int(np.searchsorted(ordered, capacity - k, "right"))
        large = len(ordered) - alone  # larger than capacity - k
        middle = alone - half  # above half, up to capacity - k
        low = int(np.searchsorted(ordered, k, "left"))
        rest = int(sums[half] - sums[low])  # from k up to half
        free = middle * capacity - int(sums[alone] - sums[half])
        best = max(best, large + middle + max(0, -(-(rest - free) // capacity)))
    return best


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit of the items from large to small: lists of item numbers."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(room, (sizes[i], -1))
        if at == len(room):
            bins.append([i])
            left = (capacity - sizes[i], len(bins) - 1)
        else:
            free, b = room.pop(at)
            bins[b].append(i)
            left = (free - sizes[i], b)
        insort(room, left)
    return bins


def fillings(sizes: list[int], room: int, most: int, width: int) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(waste, places) of up to ``width`` fillings of ``room`` by some of ``sizes`` (from large to small) that waste at most ``most``; least waste first, of equal waste larger sizes first.

    A number whose bits are the sums that the sizes from a place on can make tells which branches end in a filling, so none is entered in vain.
    """
    n, mask = len(sizes), (1 << (room + 1)) - 1
    sums = [1] * (n + 1)
    for k in range(n - 1, -1, -1):
        sums[k] = (sums[k + 1] | (sums[k + 1] << sizes[k])) & mask
    found = 0
    for waste in range(min(most, room) + 1):
        if not (sums[0] >> (room - waste)) & 1:
            continue
        todo: list[tuple[int, int, tuple[int, ...]]] = [(0, room - waste, ())]
        while todo:
            k, left, chosen = todo.pop()
            if not left:
                yield waste, chosen
                found += 1
                if found == width:
                    return
                continue
            ways, last = [], -1
            while k < n and len(ways) < width and (sums[k] >> left) & 1:
                s = sizes[k]
                if s != last and s <= left and (sums[k + 1] >> (left - s)) & 1:
                    ways.append((k + 1, left - s, (*chosen, k)))
                    last = s
                k += 1
            todo.extend(reversed(ways))


def dominated(chosen: list[int], left: dict[int, int], waste: int) -> bool:
    """Whether a size left out could stand for one or two of those chosen, and waste no more: such a filling needn't be tried, as what it frees is no harder to place. ``left``: size -> how many there are in all."""
    for i, a in enumerate(chosen):
        if any(left.get(a + d, 0) > chosen.count(a + d) for d in range(1, waste + 1)):
            return True
        for b in chosen[i + 1 :]:
            if any(left.get(a + b + d, 0) > chosen.count(a + b + d) for d in range(waste + 1)):
                return True
    return False


def branch_and_bound(sizes: list[int], capacity: int, target: int, nodes: int = NODES, width: int = WIDTH) -> list[list[int]] | None:
    """The items' numbers in at most ``target`` containers, or None if ``nodes`` containers opened and ``width`` fillings of each have shown no such packing."""
    slack = target * capacity - sum(sizes)
    if slack < 0:
        return None
    opened = 0
    # a container is open at each step: its first item, the items after it, what may still be wasted, the fillings left to try
    steps: list[tuple[int, list[int], int, Iterator]] = []
    packed: list[list[int]] = []
    items, free = sorted(range(len(sizes)), key=lambda i: -sizes[i]), slack
    while True:
        if sum(sizes[i] for i in items) <= capacity and (len(packed) < target or not items):
            return [*packed, items] if items else packed
        if len(packed) < target and opened < nodes:
            opened += 1
            rest = [sizes[i] for i in items[1:]]
            steps.append((items[0], items[1:], free, fillings(rest, capacity - sizes[items[0]], free, width)))
        # the next filling of the innermost container that has one
        while steps:
            first, others, free, ways = steps[-1]
            del packed[len(steps) - 1 :]
            counts: dict[int, int] = {}
            for i in others:
                counts[sizes[i]] = counts.get(sizes[i], 0) + 1
            way = next((w for w in ways if not dominated([sizes[others[k]] for k in w[1]], counts, w[0])), None) if opened <= nodes else None
            if way is not None:
                break
            steps.pop()
        else:
            return None
        waste, places = way
        taken = set(places)
        packed.append([first, *(others[k] for k in places)])
        items, free = [i for k, i in enumerate(others) if k not in taken], free - waste
        if opened >= nodes and sum(sizes[i] for i in items) > capacity:
            return None


def _window(bins: list[list[int]], sizes: list[int], capacity: int, turn: int, chance: random.Random) -> list[int] | None:
    """Containers that might be packed into one fewer: the emptiest, until one container's room is free, and others in changing order, until the lower bound allows it."""
    waste = [capacity - sum(sizes[i] for i in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda k: (-waste[k], k))
    chosen, free, n = [], 0, 0
    for k in order:
        if free >= capacity * (1 + 0.15 * (turn % 4)):
            break
        chosen.append(k)
        free, n = free + waste[k], n + len(bins[k])
    if free < capacity:
        return None
    held = set(chosen)
    others = [k for k in order if k not in held]
    if turn % 3 == 0:
        chance.shuffle(others)
    elif turn % 3 == 1:  # those with small items
        others.sort(key=lambda k: min(sizes[i] for i in bins[k]) * (1 + chance.random()))
    else:  # those with many items
        others.sort(key=lambda k: (-len(bins[k]), chance.random()))
    want, rest = max(WINDOW, n), iter(others)
    while True:
        for k in rest:
            chosen.append(k)
            n += len(bins[k])
            if n >= want:
                break
        else:
            want = 4 * WINDOW + 1
        if lower_bound([sizes[i] for k in chosen for i in bins[k]], capacity) < len(chosen):
            return chosen
        if want > 4 * WINDOW:
            return []
        want = want * 3 // 2


def pack(sizes: list[int], capacity: int, gains: list[int] | None = None) -> list[list[int]]:
    """Lists of item numbers, one per container. No item may be larger than the capacity; items of size 0 go into the first container. ``gains`` gets a 1 for each container that the search saved over best fit."""
    capacity = int(capacity)  # numpy's numbers have too few bits for the sums of the fillings
    full = [i for i, s in enumerate(sizes) if s]
    real = [int(sizes[i]) for i in full]
    bound, best, missed, chance = lower_bound(real, capacity), best_fit(real, capacity), 0, random.Random(len(real))
    for turn in range(ROUNDS):
        if len(best) <= bound or missed == MISSES:
            break
        chosen = _window(best, real, capacity, turn, chance)
        if chosen is None:
            break
        items = [i for k in chosen for i in best[k]]
        again = branch_and_bound([real[i] for i in items], capacity, len(chosen) - 1) if chosen else None
        missed += again is None
        if again is not None:
            held, missed = set(chosen), 0
            best = [b for k, b in enumerate(best) if k not in held] + [[items[i] for i in b] for b in again]
            if gains is not None:
                gains.append(1)
    out = [[full[i] for i in b] for b in best]
    empty = [i for i, s in enumerate(sizes) if not s]
    if empty:
        if out:
            out[0].extend(empty)
        else:
            out.append(empty)
    return out


ASSIGNMENT = "spec_id int, container_id string, doc_id bigint, piece_no int, token_start bigint, n_tokens bigint"


def assign(documents: DataFrame, specs: DataFrame, tokenizer: str = TOKENIZER, lot: int = LOT) -> DataFrame:
    """(spec_id, container_id, doc_id, piece_no, token_start, n_tokens): every document's place for each capacity.

    ``documents``: doc_id, text; ``specs``: spec_id, capacity, a table of a few rows (over 1,000 is an error). A text
    longer than the capacity is split into full containers and one rest, which is packed like any text; no other
    text is split. Empty and null texts take no room and are assigned too. Specs with a null or non-positive
    capacity, and documents without an id, give no rows; repeated ids count once; an empty table gives no rows.
    """
    wanted = specs.where("spec_id is not null and capacity > 0").select(F.col("spec_id").cast("int"), F.col("capacity").cast("int")).distinct().limit(1001).collect()
    if len(wanted) > 1000:
        raise ValueError("over 1,000 container sizes")
    spark = documents.sparkSession
    counts = durable(token_counts(documents.select("doc_id", "text"), tokenizer))
    lots = max(1, -(-counts.count() // lot))
    if not wanted:
        return spark.createDataFrame([], ASSIGNMENT)
    spec = F.explode(F.array(*(F.struct(F.lit(r["spec_id"]).alias("spec_id"), F.lit(r["capacity"]).cast("bigint").alias("capacity")) for r in wanted))).alias("s")
    items = counts.select("doc_id", "n_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(lots)).alias("lot"), spec).select("doc_id", "n_tokens", "lot", "s.*")
    over = F.col("n_tokens") > F.col("capacity")
    whole = F.expr("n_tokens div capacity")
    piece = F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1)).alias("p")
    pieces = items.where(over).select("spec_id", "doc_id", "capacity", piece)
    filled = pieces.select(
        "spec_id", F.concat(F.lit("full-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("p").cast("string")).alias("container_id"), "doc_id",
        F.col("p").cast("int").alias("piece_no"), (F.col("p") * F.col("capacity")).alias("token_start"), F.col("capacity").alias("n_tokens"),
    )
    rest = F.when(over, F.col("n_tokens") % F.col("capacity")).otherwise(F.col("n_tokens"))
    loose = items.withColumn("size", rest).where(~over | (F.col("size") > 0)).select("spec_id", "lot", "capacity", "doc_id", "size", F.when(over, whole).otherwise(0).cast("int").alias("piece_no"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts = None, []

        def solved() -> pd.DataFrame:
            spec_id, lot_no, capacity = now
            rows = pd.concat(parts)
            container = np.empty(len(rows), np.int64)
            for k, members in enumerate(pack(rows["size"].tolist(), capacity)):
                container[members] = k
            return pd.DataFrame({
                "spec_id": spec_id, "container_id": [f"lot-{lot_no}-{k}" for k in container], "doc_id": rows["doc_id"].to_numpy(), "piece_no": rows["piece_no"].to_numpy(),
                "token_start": rows["piece_no"].to_numpy().astype(np.int64) * capacity, "n_tokens": rows["size"].to_numpy(),
            })

        for pdf in batches:
            for key, part in pdf.groupby(["spec_id", "lot", "capacity"], sort=False):
                if key != now:
                    if parts:
                        yield solved()
                    now, parts = key, []
                parts.append(part)
        if parts:
            yield solved()

    by = ["spec_id", "lot", "capacity"]
    packed = loose.repartition(*by).sortWithinPartitions(*by, "doc_id").mapInPandas(run, ASSIGNMENT)
    return filled.unionByName(packed)
