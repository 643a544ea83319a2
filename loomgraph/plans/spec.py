"""Query documents: the graph pattern a query names, bound and validated.

`load` takes YAML text or a path, `from_request` the nested request dialect with
knowledgeGraphId and pathQuery; both give a `Query`, or raise `InvalidQuery` with
every error found.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path as FilePath
from typing import Any

from . import yaml_subset

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
REQUEST_OPERATORS = ("EQ", "CONTAINS")
DIRECTIONS, KINDS = ("OUTBOUND", "INBOUND", "UNDIRECTED"), ("PATH", "NODE", "EDGE")


@dataclass(frozen=True)
class Error:
    field: str
    message: str

    def __str__(self) -> str:
        return f"{self.field}: {self.message}"


class InvalidQuery(ValueError):
    """All errors of a document."""

    def __init__(self, errors: list[Error]):
        super().__init__("\n".join(map(str, errors)))
        self.errors = errors


@dataclass(frozen=True)
class Node:
    labels: tuple = ()
    id: Any = None
    properties: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Edge:
    source: str | None
    target: str | None
    direction: str | None = "OUTBOUND"
    type: str | None = None
    id: Any = None
    properties: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Path:
    alias: str
    edges: tuple


@dataclass(frozen=True)
class Item:
    kind: str | None
    ref: str | None
    alias: str | None


@dataclass(frozen=True)
class Query:
    nodes: dict
    edges: dict
    paths: tuple
    items: tuple = ()
    limit: int | None = None
    tests: dict = field(default_factory=dict)  # alias -> ((property, operator, value), ...) besides the equalities

    def walk(self, path: Path) -> list[str]:
        """The node aliases along a path."""
        return [self.edges[path.edges[0]].source, *(self.edges[e].target for e in path.edges)]

    def returned(self) -> tuple:
        """The items to return; without any, every path under its own name."""
        return self.items or tuple(Item("PATH", p.alias, p.alias) for p in self.paths)


def _is_name(x: Any) -> bool:
    return isinstance(x, str) and IDENTIFIER.fullmatch(x) is not None


def _is_scalar(x: Any) -> bool:
    return x is None or isinstance(x, (str, bool, int, float))


class _Binder:
    """Turns the tree into a Query; wrong shapes end it at once, as they leave nothing to check."""

    def fail(self, where: str, what: str):
        raise InvalidQuery([Error(where, what)])

    def mapping(self, x: Any, where: str, optional: bool = True) -> dict:
        if x is None and optional:
            return {}
        return x if isinstance(x, dict) else self.fail(where, "must be a mapping")

    def listing(self, x: Any, where: str) -> list:
        if x is None:
            return []
        return x if isinstance(x, list) else self.fail(where, "must be a sequence")

    def text(self, x: Any, where: str) -> str | None:
        if not _is_scalar(x):
            self.fail(where, "must be a scalar")
        if x is None or not str(x).strip():
            return None
        return str(x).strip() if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)

    def value(self, x: Any, where: str) -> Any:
        return x if _is_scalar(x) else self.fail(where, "must be a scalar")

    def integer(self, x: Any, where: str) -> int | None:
        if x is None:
            return None
        if isinstance(x, bool) or not isinstance(x, (int, float)) or x != int(x):
            self.fail(where, "must be an integer")
        return int(x)

    def choice(self, x: Any, where: str, of: tuple) -> str | None:
        name = (self.text(x, where) or "").upper()
        if name and name not in of:
            self.fail(where, f"must be one of {', '.join(of)}")
        return name or None

    def values(self, x: Any, where: str) -> dict:
        return {k: self.value(v, f"{where}.{k}") for k, v in self.mapping(x, where).items()}

    def query(self, tree: Any) -> tuple[int | None, Query]:
        root = self.mapping(tree, "document", optional=False)
        version = self.integer(root.get("version"), "version")
        q = self.mapping(root.get("query"), "query", optional=False)
        nodes, edges = {}, {}
        for name, n in self.mapping(q.get("nodes"), "query.nodes").items():
            at = f"query.nodes.{name}"
            n = self.mapping(n, at, optional=False)
            labels = tuple(self.text(x, f"{at}.labels") for x in self.listing(n.get("labels"), f"{at}.labels"))
            nodes[name] = Node(labels, self.value(n.get("id"), f"{at}.id"), self.values(n.get("properties"), f"{at}.properties"))
        for name, e in self.mapping(q.get("edges"), "query.edges").items():
            at = f"query.edges.{name}"
            e = self.mapping(e, at, optional=False)
            edges[name] = Edge(
                self.text(e.get("from"), f"{at}.from"), self.text(e.get("to"), f"{at}.to"), self.choice(e.get("direction"), f"{at}.direction", DIRECTIONS),
                self.text(e.get("type"), f"{at}.type"), self.value(e.get("id"), f"{at}.id"), self.values(e.get("properties"), f"{at}.properties"),
            )
        paths = []
        for k, p in enumerate(self.listing(q.get("paths"), "query.paths")):
            at = f"query.paths[{k}]"
            p = self.mapping(p, at, optional=False)
            paths.append(Path(self.text(p.get("alias"), f"{at}.alias"), tuple(self.text(x, f"{at}.edges") for x in self.listing(p.get("edges"), f"{at}.edges"))))
        items = []
        for k, i in enumerate(self.listing(self.mapping(q.get("return"), "query.return").get("items"), "query.return.items")):
            at = f"query.return.items[{k}]"
            i = self.mapping(i, at, optional=False)
            items.append(Item(self.choice(i.get("kind"), f"{at}.kind", KINDS), self.text(i.get("ref"), f"{at}.ref"), self.text(i.get("alias"), f"{at}.alias")))
        return version, Query(nodes, edges, tuple(paths), tuple(items), self.integer(q.get("limit"), "query.limit"))


def check(query: Query, version: int | None = 1) -> list[Error]:
    """Everything that is wrong with the query."""
    errors: list[Error] = []
    add = lambda where, what: errors.append(Error(where, what))
    if version != 1:
        add("version", "only version 1 is supported")
    for kind, held in (("node", query.nodes), ("edge", query.edges), ("path", query.paths)):
        if not held:
            add(f"query.{kind}s", f"at least one {kind} must be defined")
    for kind, held in (("node", query.nodes), ("edge", query.edges)):
        for name, x in held.items():
            at = f"query.{kind}s.{name}"
            if not _is_name(name):
                add(at, f"{kind} alias must be a valid identifier")
            if not _is_scalar(x.id):
                add(f"{at}.id", "must be a scalar value")
            for key, value in x.properties.items():
                if key == "id":
                    add(f"{at}.properties.id", "id has a field of its own")
                elif not _is_name(key):
                    add(f"{at}.properties.{key}", "property must be a valid identifier")
                elif not _is_scalar(value):
                    add(f"{at}.properties.{key}", "must be a scalar value")
    for name, n in query.nodes.items():
        for k, label in enumerate(n.labels):
            if not _is_name(label):
                add(f"query.nodes.{name}.labels[{k}]", "label must be a valid identifier")
    for name, e in query.edges.items():
        at = f"query.edges.{name}"
        for end, alias in (("from", e.source), ("to", e.target)):
            if not _is_name(alias):
                add(f"{at}.{end}", f"{end} must be a valid identifier")
            elif alias not in query.nodes:
                add(f"{at}.{end}", f"{end} references unknown node '{alias}'")
        if e.direction is None:
            add(f"{at}.direction", "direction must be provided")
        if e.type is not None and not _is_name(e.type):
            add(f"{at}.type", "type must be a valid identifier")
    seen: set = set()
    for k, p in enumerate(query.paths):
        at = f"query.paths[{k}]"
        if not _is_name(p.alias):
            add(f"{at}.alias", "path alias must be a valid identifier")
        elif p.alias in seen:
            add(f"{at}.alias", f"duplicate path alias '{p.alias}'")
        seen.add(p.alias)
        if not p.edges:
            add(f"{at}.edges", "path must reference at least one edge")
        before = None
        for i, name in enumerate(p.edges):
            where = f"{at}.edges[{i}]"
            edge = query.edges.get(name)
            if not _is_name(name):
                add(where, "edge reference must be a valid identifier")
            elif edge is None:
                add(where, f"unknown edge reference '{name}'")
            else:
                if before is not None and before.target != edge.source:
                    add(where, f"path is not continuous: '{before.target}' is followed by '{edge.source}'")
                if name in p.edges[:i]:
                    add(where, f"edge '{name}' appears twice in one path")
            before = edge
    for name in query.edges:
        if name in query.nodes:
            add(f"query.edges.{name}", f"alias '{name}' is already used")
    for k, p in enumerate(query.paths):
        if p.alias in query.nodes or p.alias in query.edges:
            add(f"query.paths[{k}].alias", f"alias '{p.alias}' is already used")
    outputs: set = set()
    held = {"PATH": {p.alias for p in query.paths}, "NODE": query.nodes, "EDGE": query.edges}
    used_edges = {e for p in query.paths for e in p.edges}
    used_nodes = {n for e in used_edges if e in query.edges for n in (query.edges[e].source, query.edges[e].target)}
    for k, item in enumerate(query.items):
        at = f"query.return.items[{k}]"
        if item.kind is None:
            add(f"{at}.kind", "kind must be one of PATH, NODE, EDGE")
        if not _is_name(item.alias):
            add(f"{at}.alias", "output alias must be a valid identifier")
        elif item.alias in outputs:
            add(f"{at}.alias", f"duplicate output alias '{item.alias}'")
        outputs.add(item.alias)
        if not _is_name(item.ref):
            add(f"{at}.ref", "ref must be a valid identifier")
        elif item.kind and item.ref not in held[item.kind]:
            add(f"{at}.ref", f"unknown {item.kind.lower()} reference '{item.ref}'")
        elif (item.kind == "NODE" and item.ref not in used_nodes) or (item.kind == "EDGE" and item.ref not in used_edges):
            add(f"{at}.ref", f"'{item.ref}' is in no path")
    for kind, held, used in (("nodes", query.nodes, used_nodes), ("edges", query.edges, used_edges)):
        for name, x in held.items():
            if name not in used and (x.id is not None or x.properties or name in query.tests):
                add(f"query.{kind}.{name}", f"'{name}' is filtered but in no path")
    if query.limit is not None and query.limit <= 0:
        add("query.limit", "limit must be greater than 0")
    return errors


def validated(query: Query, version: int | None = 1) -> Query:
    if errors := check(query, version):
        raise InvalidQuery(errors)
    return query


def load(source: str | FilePath) -> Query:
    """The query of YAML text, or of a file if source is a Path."""
    text = source.read_text(encoding="utf-8") if isinstance(source, FilePath) else source
    version, query = _Binder().query(yaml_subset.parse(text))
    return validated(query, version)


def from_request(request: dict) -> Query:
    """The nested request dialect: pathQuery with nodes and edges of one hop, an empty entityType for any."""
    q = request.get("pathQuery") or {}
    names = {n["alias"]: n for n in q.get("nodes", [])}

    tests, errors = {}, []

    def note(alias: str, x: dict, where: str) -> None:
        """Every condition becomes a test of the alias, repeated properties too."""
        for k, c in enumerate(x.get("conditions") or []):
            operator = str(c.get("operator") or "EQ").upper()
            if not _is_name(c.get("property")):
                errors.append(Error(f"{where}.conditions[{k}].property", "property must be a valid identifier"))
            elif operator not in REQUEST_OPERATORS:
                errors.append(Error(f"{where}.conditions[{k}].operator", f"operator must be one of {', '.join(REQUEST_OPERATORS)}"))
            elif not _is_scalar(c.get("value")):
                errors.append(Error(f"{where}.conditions[{k}].value", "must be a scalar value"))
            else:
                tests.setdefault(alias, []).append((c["property"], operator, c.get("value")))

    nodes = {a: Node((n["entityType"],) if n.get("entityType") else ()) for a, n in names.items()}
    for k, (a, n) in enumerate(names.items()):
        note(a, n, f"pathQuery.nodes[{k}]")
    edges = {}
    for k, e in enumerate(q.get("edges", [])):
        if e.get("hops", 1) != 1:
            raise InvalidQuery([Error(f"pathQuery.edges[{k}].hops", "only single hops are supported")])
        edges[f"e{k}"] = Edge(e.get("startNode"), e.get("endNode"), "OUTBOUND", e.get("entityType") or None)
        note(f"e{k}", e, f"pathQuery.edges[{k}]")
    query = Query(nodes, edges, (Path("path0", tuple(edges)),), (), request.get("limit"), tests)
    if errors := [*check(query), *errors]:
        raise InvalidQuery(errors)
    return query
