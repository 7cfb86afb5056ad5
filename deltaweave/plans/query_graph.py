"""The query graph: parsing, checks and shape statistics. Small, so it lives on the driver."""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field

MAX_VERTICES, MAX_EDGES = 32, 64
_SPACE = re.compile(r"[ \t\r]+")


class QueryError(ValueError):
    """A query that can't be run."""


@dataclass
class QueryGraph:
    """labels by vertex (None: the default); edges (a, b) -> label or None, undirected ones with a < b."""

    labels: list[int | None]
    edges: dict[tuple[int, int], int | None]
    directed: bool = False
    names: list[int] = field(default_factory=list)

    def __post_init__(self):
        if not self.directed:
            flat: dict[tuple[int, int], int | None] = {}
            for (a, b), el in self.edges.items():
                flat.setdefault((min(a, b), max(a, b)), el)
            self.edges = flat
        if not self.edges:
            raise QueryError("the query has no edges")
        if len(self.labels) > MAX_VERTICES or len(self.edges) > MAX_EDGES:
            raise QueryError(f"at most {MAX_VERTICES} vertices and {MAX_EDGES} edges")
        if any(a == b for a, b in self.edges):
            raise QueryError("self loop")
        if len(self.distances(0)) < self.k:
            raise QueryError("the query is not connected")

    @property
    def k(self) -> int:
        return len(self.labels)

    @property
    def labelled(self) -> bool:
        """Whether edge labels matter at all: an unlabelled query edge then asks for an unlabelled data edge."""
        return any(el is not None for el in self.edges.values())

    def neighbours(self, v: int) -> set[int]:
        return {b if a == v else a for a, b in self.edges if v in (a, b)}

    def degree(self, v: int) -> int:
        return len(self.neighbours(v))

    def checks(self, c: int, bound: set[int]) -> list[tuple[int, int, int | None]]:
        """Edges between c and bound vertices: (bound vertex, side as seen from it, label)."""
        out = []
        for (a, b), el in self.edges.items():
            if a in bound and b == c:
                out.append((a, 0, el))
            elif b in bound and a == c:
                out.append((b, 1 if self.directed else 0, el))
        return out

    def with_default(self, label: int) -> QueryGraph:
        return QueryGraph([label if x is None else x for x in self.labels], dict(self.edges), self.directed, self.names)

    def label_pairs(self) -> set[tuple[int, int]]:
        """Label pairs that an edge must have to matter."""
        out = {(self.labels[a], self.labels[b]) for a, b in self.edges}
        return out if self.directed else out | {(b, a) for a, b in out}

    def distances(self, start: int) -> dict[int, int]:
        seen, todo = {start: 0}, deque([start])
        while todo:
            v = todo.popleft()
            for n in self.neighbours(v):
                if n not in seen:
                    seen[n] = seen[v] + 1
                    todo.append(n)
        return seen

    def shape(self) -> dict[str, int]:
        return {
            "vertices": self.k,
            "edges": len(self.edges),
            "max_degree": max(self.degree(v) for v in range(self.k)),
            "diameter": max(max(self.distances(v).values()) for v in range(self.k)),
            "labels": len(set(self.labels)),
        }


def _number(token: str, digits: int) -> int | None:
    return int(token) if re.fullmatch(rf"[0-9]{{1,{digits}}}", token) else None


def parse_query(text: str, directed: bool = False) -> QueryGraph:
    """`v id label` and `e u v [label]` lines; any other line but `t`, a comment or a blank one is an error. Of several labels of a vertex the last counts, of equal edges the first."""
    names: dict[int, int] = {}
    labels: list[int | None] = []
    edges: dict[tuple[int, int], int | None] = {}

    def local(token: str, at: int) -> int:
        raw = _number(token, 38)
        if raw is None:
            raise QueryError(f"line {at}: bad vertex id {token!r}")
        if raw not in names:
            if len(names) == MAX_VERTICES:
                raise QueryError(f"more than {MAX_VERTICES} vertices")
            names[raw] = len(labels)
            labels.append(None)
        return names[raw]

    for at, line in enumerate(text.split("\n"), 1):
        tokens = [t for t in _SPACE.split(line) if t]
        if not tokens or tokens[0][0] in "#%" or tokens[0] == "t":
            continue
        if tokens[0] == "v":
            label = _number(tokens[2], 19) if len(tokens) > 2 else None
            if label is None:
                raise QueryError(f"line {at}: expected 'v <id> <label>'")
            labels[local(tokens[1], at)] = label
        elif tokens[0] == "e":
            if len(tokens) < 3:
                raise QueryError(f"line {at}: expected 'e <u> <v> [label]'")
            a, b = local(tokens[1], at), local(tokens[2], at)
            if a == b:
                raise QueryError(f"line {at}: self loop")
            if not directed:
                a, b = min(a, b), max(a, b)
            edges.setdefault((a, b), _number(tokens[3], 19) if len(tokens) > 3 else None)
        else:
            raise QueryError(f"line {at}: unknown line type {tokens[0]!r}")
    return QueryGraph(labels, edges, directed, list(names))
