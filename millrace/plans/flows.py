"""Blocks by name, and flows given as JSON documents built from them."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.rowops import FilterConfig, filter_rows, select_rename
from millrace.operators.topology import fan_in
from millrace.plans.graph import Block, Edge, Graph


@dataclass(frozen=True)
class Registered:
    """A block: a function of its input frames and its configuration; what it takes and gives, by name."""

    build: Callable[..., DataFrame]
    takes: str = "rows"
    gives: str = "rows"
    many_inputs: bool = False


@dataclass
class Registry:
    blocks: dict[str, Registered] = field(default_factory=dict)

    def register(self, key: str, block: Registered) -> None:
        if not self.try_register(key, block):
            raise ValueError(f"block {key!r} is registered already")

    def try_register(self, key: str, block: Registered) -> bool:
        if key in self.blocks:
            return False
        self.blocks[key] = block
        return True

    def get(self, key: str) -> Registered:
        return self.blocks[key]

    def keys(self, prefix: str = "") -> list[str]:
        return sorted(k for k in self.blocks if k.startswith(prefix))


def standard_registry() -> Registry:
    r = Registry()
    r.register("rows/filter", Registered(lambda df, c: filter_rows(df, FilterConfig(c["column"], c["operator"], c["value"]))))
    r.register("rows/select", Registered(lambda df, c: select_rename(df, c["columns"])))
    r.register("rows/derive", Registered(lambda df, c: df.withColumns({k: F.expr(v) for k, v in c["columns"].items()})))
    r.register("rows/group", Registered(lambda df, c: df.groupBy(*c["keys"]).agg(*(F.expr(v).alias(k) for k, v in c["aggregates"].items()))))
    r.register("rows/union", Registered(lambda *dfs_and_config: fan_in(*dfs_and_config[:-1]), many_inputs=True))
    return r


def check_flow(document: str | dict, registry: Registry) -> list[str]:
    """All that is wrong with a flow, not only the first thing."""
    flow = json.loads(document) if isinstance(document, str) else document
    errors: list[str] = []
    kinds: dict[str, Registered | None] = {}
    for b in flow.get("blocks", []):
        name = (b.get("instanceId") or "").strip()
        if not name:
            errors.append("a block has no id")
            continue
        if name.lower() in {k.lower() for k in kinds}:
            errors.append(f"block id {name!r} is there twice")
        kinds[name] = registry.blocks.get(b.get("blockKey", ""))
        if kinds[name] is None and b.get("blockKey") != "source":
            errors.append(f"block {name!r}: no registered block {b.get('blockKey')!r}")
    for c in flow.get("connections", []):
        ends = [c.get("from"), c.get("to")]
        missing = [e for e in ends if e not in kinds]
        errors += [f"connection {ends[0]!r} to {ends[1]!r}: no block {e!r}" for e in missing]
        a, b = (kinds.get(e) for e in ends)
        if not missing and b is not None and a is not None and a.gives != b.takes:
            errors.append(f"connection {ends[0]!r} to {ends[1]!r}: {a.gives} isn't {b.takes}")
    graph = flow_graph(flow, registry)
    errors += [e for e in graph.problems()[0] if "inputs" in e or "cycle" in e]
    return errors


def flow_graph(document: str | dict, registry: Registry) -> Graph:
    flow = json.loads(document) if isinstance(document, str) else document
    made = [Block(b.get("instanceId") or "", b.get("blockKey", ""), getattr(registry.blocks.get(b.get("blockKey", "")), "many_inputs", False)) for b in flow.get("blocks", [])]
    return Graph(made, [Edge(c.get("from"), c.get("to")) for c in flow.get("connections", [])])


def build_flow(document: str | dict, registry: Registry, sources: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The frames of the flow's last blocks. Blocks of the key ``source`` are given; a flow with errors isn't built."""
    flow = json.loads(document) if isinstance(document, str) else document
    errors = check_flow(flow, registry)
    if errors:
        raise ValueError("; ".join(errors))
    config = flow.get("config", {})
    by_name = {b["instanceId"]: b for b in flow["blocks"]}
    inputs: dict[str, list[str]] = {}
    for c in flow.get("connections", []):
        inputs.setdefault(c["to"], []).append(c["from"])
    made: dict[str, DataFrame] = {}
    for name in flow_graph(flow, registry).order():
        b = by_name[name]
        made[name] = sources[name] if b["blockKey"] == "source" else registry.get(b["blockKey"]).build(*(made[i] for i in inputs.get(name, [])), config.get(b.get("configRef", name), {}))
    feeds = {c["from"] for c in flow.get("connections", [])}
    return {n: df for n, df in made.items() if n not in feeds}
