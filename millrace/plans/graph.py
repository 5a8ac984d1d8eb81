"""Flow graphs as data: validation, order, diagrams. The graph describes a plan; Spark runs it."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Block:
    name: str
    kind: str = "transform"
    many_inputs: bool = False


@dataclass(frozen=True)
class Edge:
    source: str
    target: str
    strategy: str = "simple"


@dataclass
class Graph:
    blocks: list[Block] = field(default_factory=list)
    edges: list[Edge] = field(default_factory=list)

    def problems(self) -> tuple[list[str], list[str]]:
        """(errors, warnings): duplicate names, unknown ends, several inputs where one is meant, cycles; blocks that hang on nothing."""
        errors: list[str] = []
        seen: set[str] = set()
        for b in self.blocks:
            if b.name in seen:
                errors.append(f"block {b.name!r} is there twice")
            seen.add(b.name)
        inputs: dict[str, int] = {}
        for e in self.edges:
            errors += [f"edge {e.source!r} to {e.target!r}: no block {end!r}" for end in (e.source, e.target) if end not in seen]
            inputs[e.target] = inputs.get(e.target, 0) + 1
        merging = {b.name for b in self.blocks if b.many_inputs}
        errors += [f"block {t!r} has {n} inputs" for t, n in inputs.items() if n > 1 and t in seen and t not in merging]
        if len(self.order()) < len(seen):
            errors.append("the graph has a cycle")
        joined = {end for e in self.edges for end in (e.source, e.target)}
        warnings = [f"block {b.name!r} is connected to nothing" for b in self.blocks if len(seen) > 1 and b.name not in joined]
        return errors, warnings

    def order(self) -> list[str]:
        """The blocks after all that feed them, ties in the order given; blocks on a cycle are left out."""
        names = [*dict.fromkeys(b.name for b in self.blocks)]
        waits = {n: 0 for n in names}
        below: dict[str, list[str]] = {n: [] for n in names}
        for e in self.edges:
            if e.source in waits and e.target in waits:
                waits[e.target] += 1
                below[e.source].append(e.target)
        ready, out = deque(n for n in names if not waits[n]), []
        while ready:
            n = ready.popleft()
            out.append(n)
            for t in below[n]:
                waits[t] -= 1
                if not waits[t]:
                    ready.append(t)
        return out

    def depth_first(self) -> list[str]:
        """The blocks in pre-order from those without an input; on a diamond this is not a topological order."""
        below: dict[str, list[str]] = {}
        for e in self.edges:
            below.setdefault(e.source, []).append(e.target)
        targets = {e.target for e in self.edges}
        todo, out = [b.name for b in reversed(self.blocks) if b.name not in targets], []
        while todo:
            n = todo.pop()
            if n not in out:
                out.append(n)
                todo.extend(reversed(below.get(n, [])))
        return out

    def mermaid(self) -> str:
        ids = {b.name: f"b{i}" for i, b in enumerate(self.blocks)}
        lines = ["flowchart LR", *(f'  {ids[b.name]}["{b.name} ({b.kind})"]' for b in self.blocks)]
        lines += [f"  {ids[e.source]} -->{'' if e.strategy == 'simple' else f'|{e.strategy}|'} {ids[e.target]}" for e in self.edges]
        return "\n".join(lines)

    def graphviz(self) -> str:
        q = lambda s: '"' + s.replace('"', r"\"") + '"'
        lines = ["digraph flow {", *(f"  {q(b.name)} [label={q(f'{b.name} ({b.kind})')}];" for b in self.blocks)]
        lines += [f"  {q(e.source)} -> {q(e.target)} [label={q(e.strategy)}];" for e in self.edges]
        return "\n".join([*lines, "}"])

    def text(self) -> str:
        below: dict[str, list[str]] = {}
        for e in self.edges:
            below.setdefault(e.source, []).append(e.target)
        return "\n".join(f"{n} -> {', '.join(below[n])}" if n in below else n for n in self.order())

    def summary(self) -> dict[str, int]:
        kinds: dict[str, int] = {}
        for b in self.blocks:
            kinds[b.kind] = kinds.get(b.kind, 0) + 1
        return {"blocks": len(self.blocks), "edges": len(self.edges), **{f"kind_{k}": n for k, n in sorted(kinds.items())}}
