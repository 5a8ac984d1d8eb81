"""Nested documents into related flat tables through an adjacency table (problem 2).

``shred`` stores every node of every document as one row (node, parent, label, ordinal, kind, scalar).
``entity_table`` brings the object nodes below a container label together with their scalar children and pivots
them into one flat table; ``with_owner`` links such a table to the one above it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from json.decoder import scanstring
from json.scanner import NUMBER_RE

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ADJACENCY = "record_id string, doc bigint, node int, parent int, label string, ordinal int, kind string, container string, owner int, map_key string, scalar string"
_COLUMNS = [c.split()[0] for c in ADJACENCY.split(", ")]
_KINDS = [{"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in ADJACENCY.split(", ")]
#: Rows that a task hands on at a time.
AT_ONCE = 10_000
NODE = ["record_id", "doc", "node"]


@dataclass(frozen=True)
class Shape:
    """What the documents are known to hold.

    containers: label of a container (lower case) -> the fields that name an object in it. An object found where
    a list is usual is a list of one if it holds such a field as a scalar, or if the label is in ``lists``;
    otherwise it is a map from keys to objects.
    text_labels: labels whose string values are JSON text in their own right.
    scalars: the scalar labels to keep (lower case), None for all; objects and arrays are always kept.
    max_wraps: JSON strings around a document that are unwrapped, None for all.
    """

    containers: dict[str, tuple[str, ...]]
    lists: frozenset[str] = frozenset()
    text_labels: frozenset[str] = frozenset()
    scalars: frozenset[str] | None = None
    max_wraps: int | None = field(default=None)


def _refuse(name: str) -> None:
    raise ValueError(name)


_SPACE = re.compile(r"[ \t\n\r]*")
_LITERALS = {"true": True, "false": False, "null": None}


def _load(text: str):
    """The value of a JSON text of any depth."""
    try:
        return json.loads(text, parse_constant=_refuse)
    except RecursionError:
        return _load_deep(text)


def _load_deep(text: str):
    """The same without recursion, for documents nested deeper than the json module goes."""

    def past_space(i: int) -> int:
        return _SPACE.match(text, i).end()

    def key(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise ValueError(i)
        name, i = scanstring(text, i + 1, True)
        i = past_space(i)
        if text[i : i + 1] != ":":
            raise ValueError(i)
        return name, past_space(i + 1)

    open_: list[tuple[dict | list, str | None]] = []  # what isn't closed yet, and the key in it whose value is next
    at = past_space(0)
    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            value, at = ({} if c == "{" else []), past_space(at + 1)
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                name = None
                if c == "{":
                    name, at = key(at)
                open_.append((value, name))
                continue
            at += 1
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        elif number := NUMBER_RE.match(text, at):
            whole, part, power = number.groups()
            value, at = (float(number.group()) if part or power else int(whole)), number.end()
        else:
            word = next((w for w in _LITERALS if text.startswith(w, at)), "")
            if not word:
                raise ValueError(at)
            value, at = _LITERALS[word], at + len(word)
        while True:  # put the value where it belongs, and close what ends with it
            at = past_space(at)
            if not open_:
                if at != len(text):
                    raise ValueError(at)
                return value
            holder, name = open_.pop()
            if isinstance(holder, dict):
                holder[name] = value
            else:
                holder.append(value)
            c, at = text[at : at + 1], at + 1
            if c == ",":
                at = past_space(at)
                if isinstance(holder, dict):
                    name, at = key(at)
                open_.append((holder, name))
                break
            if c != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError(at)
            value = holder


def parse(text: str | None, wraps: int | None = None):
    """The value of a JSON text of any depth, without the strings it may be wrapped in (all, or ``wraps`` of them); None if it isn't valid JSON."""
    try:
        value = _load(text)
        while isinstance(value, str) and wraps != 0:
            value, wraps = _load(value), None if wraps is None else wraps - 1
        return value
    except (ValueError, TypeError):
        return None


def _clean(text: str | None) -> str | None:
    """A lone surrogate escape can't be stored as UTF-8; it becomes a question mark."""
    return text if text is None or text.isascii() else text.encode("utf-8", "replace").decode()


def _as_text(value) -> str | None:
    return _clean(value) if value is None or isinstance(value, str) else json.dumps(value)


def _nodes(record_id: str, doc: int, root, shape: Shape) -> Iterator[tuple]:
    """The rows of one document, without recursion: a deep document can't exhaust the stack."""
    # value, parent, label, ordinal, container it is an element of, nearest entity above, key in a map
    todo = [(root, -1, None, 0, None, -1, None)]
    count = 0
    while todo:
        value, parent, label, ordinal, container, owner, map_key = todo.pop()
        label, map_key = _clean(label), _clean(map_key)
        low = label.lower() if label else None
        if isinstance(value, str) and low in shape.text_labels and (inner := parse(value)) is not None:
            value = inner
        if not isinstance(value, (dict, list)):
            if shape.scalars is None or low in shape.scalars:
                yield record_id, doc, count, parent, label, ordinal, "scalar", container, owner, map_key, _as_text(value)
                count += 1
            continue
        node, count = count, count + 1
        here = low if low in shape.containers else None
        if isinstance(value, list):
            yield record_id, doc, node, parent, label, ordinal, "array", container, owner, map_key, None
            todo.extend((x, node, None, i, here, owner, None) for i, x in enumerate(value))
            continue
        names = shape.containers.get(here, ())
        if here and not container:
            scalars = {k.lower() for k, v in value.items() if not isinstance(v, (dict, list))}
            if here in shape.lists or scalars.intersection(names):  # a list of one
                yield record_id, doc, node, parent, label, ordinal, "array", None, owner, None, None
                todo.append((value, node, None, 0, here, owner, None))
            else:
                yield record_id, doc, node, parent, label, ordinal, "map", None, owner, None, None
                todo.extend((v, node, None, i, here, owner, k) for i, (k, v) in enumerate(value.items()))
            continue
        yield record_id, doc, node, parent, label, ordinal, "object", container, owner, map_key, None
        below = node if container else owner
        for i, (k, v) in enumerate(value.items()):
            # most children are scalars: they are stored, or left, at once
            if isinstance(v, (dict, list)) or (isinstance(v, str) and k.lower() in shape.text_labels):
                todo.append((v, node, k, i, None, below, None))
            elif shape.scalars is None or k.lower() in shape.scalars:
                yield record_id, doc, count, node, _clean(k), i, "scalar", None, below, None, _as_text(v)
                count += 1


def shred(df: DataFrame, record_id: str, text: str, shape: Shape) -> DataFrame:
    """The adjacency table of the JSON documents in column ``text``: columns of ``ADJACENCY``.

    ``doc`` tells documents of one record apart; equal documents of one record get equal rows, so repeated
    deliveries fold together in ``entity_table``. A null record id, a null or invalid document gives no rows;
    a JSON text inside a JSON string counts as its content. Documents may be nested to any depth. Other columns of ``df`` are ignored.
    """
    rows = df.select(F.col(record_id).cast("string").alias("record_id"), F.col(text).alias("text")).where("record_id is not null and text is not null")
    rows = rows.select("record_id", F.xxhash64("record_id", "text").alias("doc"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for r, d, t in zip(*(batch.column(c).to_pylist() for c in range(3))):
                value = parse(t, shape.max_wraps)
                if isinstance(value, (dict, list)):
                    for row in _nodes(r, d, value, shape):
                        out.append(row)
                        if len(out) == AT_ONCE:
                            yield _batch(out)
                            out = []
        if out:
            yield _batch(out)

    return rows.mapInArrow(run, ADJACENCY)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=_COLUMNS)


def entity_table(nodes: DataFrame, containers: dict[str, str], fields: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row per object found in a container: its keys, ``kind``, ``owner``, ``map_key``, ``ordinal`` and ``fields``.

    containers: label -> kind of the entity. fields: column -> scalar labels it is taken from, in any letter case,
    the first label that has a value first; of labels that differ in letter case only, the first in the object. Object nodes and scalar children meet by the object's id in one
    shuffle; copies fold together on the map side.
    """
    wanted = sorted({x.lower() for labels in fields.values() for x in labels})
    low = F.lower("label")
    # one pass over the nodes: an object goes by its own number, a scalar by its parent's
    is_object = (F.col("kind") == "object") & F.col("container").isin([*containers])
    is_child = (F.col("kind") == "scalar") & low.isin(wanted) & F.col("container").isNull()
    of_object = lambda c: F.when(is_object, F.col(c)).alias(c)
    both = nodes.where(is_object | is_child).select(
        "record_id", "doc", F.when(is_object, F.col("node")).otherwise(F.col("parent")).alias("node"), *(of_object(c) for c in ("container", "owner", "map_key", "ordinal")),
        F.when(is_child, F.col("ordinal")).alias("at"), F.when(is_child, low).alias("label"), F.when(is_child, F.col("scalar")).alias("scalar"),
    )
    met = both.groupBy(*NODE).agg(
        *(F.max(c).alias(c) for c in ("container", "owner", "map_key", "ordinal")),
        *(F.min(F.when((F.col("label") == x) & F.col("scalar").isNotNull(), F.struct("at", "scalar")))["scalar"].alias(f"__s_{x}") for x in wanted),
    )
    kinds = F.create_map(*(F.lit(x) for pair in containers.items() for x in pair))
    return met.where(F.col("container").isNotNull()).select(*NODE, "owner", "map_key", "ordinal", kinds[F.col("container")].alias("kind"), *(F.coalesce(*(F.col(f"__s_{x.lower()}") for x in labels)).alias(c) for c, labels in fields.items()))


def with_owner(entities: DataFrame, owners: DataFrame, key: str, alias: str) -> DataFrame:
    """``entities`` with the column ``key`` of the entity that owns each row, as ``alias``; rows without an owner get null."""
    above = owners.select("record_id", "doc", F.col("node").alias("owner"), F.col(key).alias(alias))
    return entities.join(above, ["record_id", "doc", "owner"], "left")
