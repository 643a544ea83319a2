"""Graph patterns as join plans.

Every way in which the pattern's untyped relationships and unlabelled nodes can
be given tables is one typed plan; the result is their union. In a plan an alias
is one relation, so a shared alias is a natural join on its identity. A node's
table is read only if the node is filtered, returned, or narrower than what the
relationship's end already says. Properties are selected at the scans, structs
are built last; filters, pruning and join strategies are Catalyst's.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import compare
from ..plans.spec import Edge, Node, Query
from .property_graph import EdgeTable, NodeTable, PropertyGraph

#: More tests for an alias, as (property, operator, value).
Tests = dict[str, list[tuple[str, str, Any]]]


class _Plan:
    """One typed plan: a space for each node alias, a table and an orientation for each edge alias."""

    def __init__(self, graph: PropertyGraph, query: Query, spaces: dict[str, str], tables: dict[str, tuple[EdgeTable, bool]], tests: Tests):
        self.graph, self.query, self.spaces, self.tables, self.tests = graph, query, spaces, tables, tests
        self.order = {a: k for k, a in enumerate([*query.nodes, *query.edges])}  # column names that case can't mix up
        self.used: dict[str, set[str]] = {a: set() for a in self.order}

    def name(self, alias: str, what: str) -> str:
        return f"x{self.order[alias]}__{what}"

    def table(self, alias: str) -> NodeTable | EdgeTable:
        return self.tables[alias][0] if alias in self.tables else self.graph.whole[self.spaces[alias]]

    def properties(self, alias: str) -> dict:
        return self.table(alias).properties

    def column(self, alias: str, key: str) -> Column | None:
        """A property after the joins; None if the alias has none of that name."""
        if key not in self.properties(alias):
            return None
        self.used[alias].add(key)
        return F.col(self.name(alias, key))

    def _filters(self, alias: str, spec: Node | Edge, table) -> Column | None:
        wanted = ([("id", "EQ", spec.id)] if spec.id is not None else []) + [(k, "EQ", v) for k, v in spec.properties.items()] + [*self.query.tests.get(alias, ()), *self.tests.get(alias, ())]
        types = dict(zip(table.frame.columns, (f.dataType for f in table.frame.schema), strict=True))
        tests = []
        for key, operator, value in wanted:
            c = table.properties.get(key)
            tests.append(compare(None if c is None else F.col(c), types.get(c), operator, value))
        return reduce(lambda a, b: a & b, tests) if tests else None

    def edge_frame(self, alias: str, with_identity: bool) -> DataFrame:
        table, forward = self.tables[alias]
        edge = self.query.edges[alias]
        a, b = (table.source_key, table.target_key) if forward else (table.target_key, table.source_key)
        df = table.frame.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        if (f := self._filters(alias, edge, table)) is not None:
            df = df.where(f)
        if edge.direction == "UNDIRECTED" and not forward and table.source == table.target:
            df = df.where(F.col(a) != F.col(b))  # a loop matches once
        identity = [table.identity().alias(self.name(alias, "eid"))] if with_identity else []
        ends = [F.col(a).alias(self.name(alias, "from")), F.col(b).alias(self.name(alias, "to"))]
        return df.select(*ends, *identity, *[F.col(table.properties[k]).alias(self.name(alias, k)) for k in sorted(self.used[alias])])

    def node_frame(self, alias: str) -> DataFrame | None:
        """The node's own rows, or None if the relationship's end says all that is needed."""
        node, whole = self.query.nodes[alias], self.graph.whole[self.spaces[alias]]
        f = self._filters(alias, node, whole)
        narrow = [self.graph.nodes[x] for x in node.labels if x != whole.label]
        if f is None and not narrow and not self.used[alias]:
            return None
        df = whole.frame if f is None else whole.frame.where(f)
        for t in narrow:
            df = df.join(t.frame.select(F.col(t.key).alias("__key")).distinct(), F.col(whole.key) == F.col("__key"), "left_semi")
        return df.select(F.col(whole.key).alias(self.name(alias, "nid")), *[F.col(whole.properties[k]).alias(self.name(alias, k)) for k in sorted(self.used[alias])])

    def joined(self) -> DataFrame:
        pairs = [(a, b) for p in self.query.paths for a, b in itertools.combinations(p.edges, 2) if self.tables[a][0] is self.tables[b][0]]
        need = {a for pair in pairs for a in pair}
        df, bound, left = None, {}, list(dict.fromkeys(e for p in self.query.paths for e in p.edges))
        while left:
            # The next edge that shares a node with what is joined; without any, a cartesian product.
            alias = next((e for e in left if {self.query.edges[e].source, self.query.edges[e].target} & set(bound)), left[0])
            left.remove(alias)
            edge, right = self.query.edges[alias], self.edge_frame(alias, alias in need)
            on, fresh = [], []
            for node, end in ((edge.source, "from"), (edge.target, "to")):
                mine = F.col(self.name(alias, end))
                if node in bound:
                    on.append(bound[node] == mine)
                else:
                    bound[node] = mine
                    fresh.append(node)
            if edge.source == edge.target:  # its two ends are one node
                right = right.where(F.col(self.name(alias, "from")) == F.col(self.name(alias, "to")))
            for node in dict.fromkeys(fresh):
                if (rows := self.node_frame(node)) is not None:
                    right = right.join(rows, bound[node] == F.col(self.name(node, "nid")))
            if df is None:
                df = right
            else:
                df = df.join(right, reduce(lambda a, b: a & b, on)) if on else df.crossJoin(right)
        for a, b in pairs:
            df = df.where(F.col(self.name(a, "eid")) != F.col(self.name(b, "eid")))
        return df

    def snapshot(self, alias: str) -> Column:
        """All properties as a struct; what is null drops out when it is written as JSON."""
        if not self.properties(alias):
            return F.struct(F.lit(None).cast("string").alias("id"))
        return F.struct(*[self.column(alias, k).alias(k) for k in self.properties(alias)])

    def path(self, path) -> Column:
        js = lambda a: F.to_json(self.snapshot(a))
        return F.struct(F.array(*[js(n) for n in self.query.walk(path)]).alias("nodes"), F.array(*[js(e) for e in path.edges]).alias("relationships"))


def plans(graph: PropertyGraph, query: Query, tests: Tests | None = None) -> Iterator[_Plan]:
    """All typed plans of the query."""
    edges = list(dict.fromkeys(e for p in query.paths for e in p.edges))

    def place(k: int, spaces: dict, tables: dict) -> Iterator[_Plan]:
        if k == len(edges):
            yield _Plan(graph, query, spaces, tables, tests or {})
            return
        edge = query.edges[edges[k]]
        for table in graph.typed(edge.type):
            ways = {"OUTBOUND": (True,), "INBOUND": (False,), "UNDIRECTED": (True, False)}[edge.direction]
            for forward in ways:
                ends = (table.source, table.target) if forward else (table.target, table.source)
                now = dict(spaces)
                for alias, space in zip((edge.source, edge.target), ends, strict=True):
                    if now.setdefault(alias, space) != space or space not in graph.spaces(query.nodes[alias].labels):
                        break
                else:
                    yield from place(k + 1, now, tables | {edges[k]: (table, forward)})

    yield from place(0, {}, {})


def _united(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def match(graph: PropertyGraph, query: Query, tests: Tests | None = None) -> DataFrame:
    """The query's return items: a path is a struct of JSON arrays, a node or relationship a JSON object."""
    frames = []
    for plan in plans(graph, query, tests):
        paths = {p.alias: p for p in query.paths}
        out = [(plan.path(paths[i.ref]) if i.kind == "PATH" else F.to_json(plan.snapshot(i.ref))).alias(i.alias) for i in query.returned()]
        frames.append(plan.joined().select(*out))
    if not frames:
        spark = next(iter(graph.whole.values())).frame.sparkSession
        kinds = {"PATH": "struct<nodes:array<string>,relationships:array<string>>"}
        frames = [spark.range(0).select(*[F.lit(None).cast(kinds.get(i.kind, "string")).alias(i.alias) for i in query.returned()])]
    df = _united(frames)
    return df if query.limit is None else df.limit(query.limit)


def project(graph: PropertyGraph, query: Query, columns: dict[str, tuple[str, str]], tests: Tests | None = None) -> DataFrame:
    """Flat columns name -> (alias, property) of the query's matches; a property that an alias lacks is null."""
    frames = []
    for plan in plans(graph, query, tests):
        out = []
        for name, (alias, key) in columns.items():
            if key == "type()":
                c = F.lit(plan.tables[alias][0].type)
            elif key == "label()":
                c = F.lit(plan.spaces[alias])
            else:
                c = plan.column(alias, key)
            out.append((F.lit(None) if c is None else c).alias(name))
        frames.append(plan.joined().select(*out))
    if not frames:
        raise ValueError("no table fits the pattern")
    df = _united(frames)
    return df if query.limit is None else df.limit(query.limit)


def exists(rows: DataFrame, key: str, graph: PropertyGraph, query: Query, alias: str, negate: bool = False, tests: Tests | None = None) -> DataFrame:
    """The rows for which (NOT) EXISTS { pattern } holds, with alias bound to their key."""
    found = project(graph, query, {"__key": (alias, "id")}, tests).distinct()
    return rows.join(found, F.col(key) == F.col("__key"), "left_anti" if negate else "left_semi")


def optional_match(rows: DataFrame, key: str, graph: PropertyGraph, query: Query, alias: str, columns: dict[str, tuple[str, str]], tests: Tests | None = None) -> DataFrame:
    """Each row with its matches, or once with nulls."""
    found = project(graph, query, {"__key": (alias, "id")} | columns, tests)
    return rows.join(found, F.col(key) == F.col("__key"), "left_outer").drop("__key")


__all__ = ["exists", "match", "optional_match", "plans", "project"]
