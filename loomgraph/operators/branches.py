"""Branch requests (fixed-length paths, united without dedup) and the graph summary."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.spec import IDENTIFIER, Edge, Node, Path, Query
from ..plans.statement import Statement
from .match import _united, plans
from .property_graph import PropertyGraph

OPERATORS = {"EQ": "=", "CONTAINS": "CONTAINS"}


@dataclass(frozen=True)
class Condition:
    property: str
    operator: str
    value: Any


@dataclass(frozen=True)
class NodeRef:
    alias: str
    conditions: tuple = ()
    label: str | None = None  # the request's own by default


@dataclass(frozen=True)
class EdgeRef:
    alias: str
    conditions: tuple = ()
    type: str | None = None


@dataclass(frozen=True)
class Branch:
    name: str
    nodes: tuple
    edges: tuple


def _name(x: str, what: str) -> str:
    if not isinstance(x, str) or not IDENTIFIER.fullmatch(x):
        raise ValueError(f"{what} must be a valid identifier: {x!r}")
    return x


def check_branches(branches: list[Branch]) -> None:
    """Raises ValueError at the first thing that is wrong."""
    if not branches:
        raise ValueError("at least one branch is required")
    for b in branches:
        if not b.name or not b.name.strip():
            raise ValueError("branch name must not be blank")
        if len(b.nodes) < 2:
            raise ValueError("a branch needs at least two nodes")
        if len(b.edges) != len(b.nodes) - 1:
            raise ValueError("a branch needs one edge fewer than nodes")
        aliases = [x.alias for x in (*b.nodes, *b.edges)]
        for x in (*b.nodes, *b.edges):
            _name(x.alias, "alias")
            for c in x.conditions:
                _name(c.property, "property")
                if c.operator not in OPERATORS or c.value is None:
                    raise ValueError("a condition needs an operator and a value")
        if len(set(aliases)) != len(aliases):
            raise ValueError("an alias names two things in one branch")


def branch_statement(branches: list[Branch], label: str = "Node", relation: str = "REL") -> Statement:
    check_branches(branches)
    params, parts = {}, []
    for i, b in enumerate(branches):
        nodes = [f"({n.alias}:{n.label or label})" for n in b.nodes]
        steps = [f"-[{e.alias}:{e.type or relation}]->{n}" for e, n in zip(b.edges, nodes[1:], strict=True)]
        tests = []
        for kind, held in (("node", b.nodes), ("edge", b.edges)):
            for j, x in enumerate(held):
                for k, c in enumerate(x.conditions):
                    name = f"branch{i}_{kind}{j}_cond{k}_value"
                    params[name] = c.value
                    tests.append(f"{x.alias}.{c.property} {OPERATORS[c.operator]} ${name}")
        where = "\nWHERE " + "\n  AND ".join(tests) if tests else ""
        quoted = b.name.replace("\\", "\\\\").replace("'", "\\'")
        parts.append(
            f"MATCH p{i} = {nodes[0]}{''.join(steps)}{where}\n"
            f"RETURN '{quoted}' AS branch,\n       p{i} AS path,\n"
            f"       [node IN nodes(p{i}) | properties(node)] AS nodeSummaries,\n"
            f"       [rel IN relationships(p{i}) | properties(rel)] AS edgeSummaries"
        )
    return Statement("\nUNION ALL\n".join(parts), params)


def branch_paths(graph: PropertyGraph, branches: list[Branch], label: str = "Node", relation: str = "REL") -> DataFrame:
    """branch, path, nodeSummaries, edgeSummaries of all branches' matches."""
    check_branches(branches)
    frames = []
    for b in branches:
        nodes = {n.alias: Node((n.label or label,)) for n in b.nodes}
        edges = {e.alias: Edge(s.alias, t.alias, "OUTBOUND", e.type or relation) for e, s, t in zip(b.edges, b.nodes, b.nodes[1:], strict=False)}
        path = Path("p", tuple(edges))
        tests = {x.alias: [(c.property, c.operator, c.value) for c in x.conditions] for x in (*b.nodes, *b.edges)}
        for plan in plans(graph, Query(nodes, edges, (path,)), tests):
            p = plan.path(path)
            frames.append(plan.joined().select(F.lit(b.name).alias("branch"), p.alias("path"), p["nodes"].alias("nodeSummaries"), p["relationships"].alias("edgeSummaries")))
    if not frames:
        raise ValueError("no table fits the branches")
    return reduce(DataFrame.unionAll, frames)


def degrees(graph: PropertyGraph, label: str, relation: str) -> DataFrame:
    """nodeId, outEdgeCount, inEdgeCount, totalEdgeCount of every node with the label; the far end may be anything.

    Each side is counted before it is joined, so the counts never multiply.
    """
    node = graph.nodes[label]

    def counted(key: str, end: str, name: str) -> DataFrame:
        ends = [e.frame.select(F.col(getattr(e, key)).alias("k")) for e in graph.typed(relation) if getattr(e, end) == node.space]
        rows = reduce(DataFrame.unionAll, ends) if ends else node.frame.select(F.col(node.key).alias("k")).limit(0)
        return rows.groupBy("k").agg(F.count(F.lit(1)).alias(name))

    out, into = counted("source_key", "source", "outEdgeCount"), counted("target_key", "target", "inEdgeCount")
    df = node.frame.select(F.col(node.key).alias("nodeId"), *[F.col(c).alias(f"p__{k}") for k, c in node.properties.items()])
    df = df.join(out, F.col("nodeId") == out["k"], "left").drop("k").join(into, F.col("nodeId") == into["k"], "left").drop("k")
    df = df.fillna(0, ["outEdgeCount", "inEdgeCount"]).withColumn("totalEdgeCount", F.col("outEdgeCount") + F.col("inEdgeCount"))
    properties = F.to_json(F.struct(*[F.col(f"p__{k}").alias(k) for k in node.properties]))
    return df.select("nodeId", properties.alias("nodeProperties"), "outEdgeCount", "inEdgeCount", "totalEdgeCount")


def edge_list(graph: PropertyGraph, label: str, relation: str) -> DataFrame:
    """fromNodeId, toNodeId, relationType, edgeProperties of edges with the label on both ends."""
    query = Query({"from": Node((label,)), "to": Node((label,))}, {"r": Edge("from", "to", "OUTBOUND", relation)}, (Path("p", ("r",)),))
    frames = []
    for plan in plans(graph, query):
        a, b, r = plan.column("from", "id"), plan.column("to", "id"), plan.snapshot("r")
        frames.append(plan.joined().select(a.alias("fromNodeId"), b.alias("toNodeId"), F.lit(plan.tables["r"][0].type).alias("relationType"), F.to_json(r).alias("edgeProperties")))
    if not frames:
        key = graph.nodes[label].frame.select(F.col(graph.nodes[label].key).alias("fromNodeId")).limit(0)
        return key.select("fromNodeId", F.col("fromNodeId").alias("toNodeId"), F.lit("").alias("relationType"), F.lit("").alias("edgeProperties"))
    return _united(frames)


def summary(graph: PropertyGraph, label: str = "Node", relation: str = "REL") -> DataFrame:
    """One row (nodes, edges): ordered arrays, as the summary statement returns them. For graphs that fit a row."""
    nodes = degrees(graph, label, relation).agg(F.array_sort(F.collect_list(F.struct("nodeId", "nodeProperties", "outEdgeCount", "inEdgeCount", "totalEdgeCount"))).alias("nodes"))
    edges = edge_list(graph, label, relation).agg(F.array_sort(F.collect_list(F.struct("fromNodeId", "toNodeId", "relationType", "edgeProperties"))).alias("edges"))
    return nodes.crossJoin(edges)


def summary_statement(label: str = "Node", relation: str = "REL") -> Statement:
    n, r = _name(label, "label"), _name(relation, "relation")

    def collect(keys: dict, name: str) -> str:
        body = ",\n".join(f"    {k}: {v}" for k, v in keys.items())
        return "  RETURN collect({\n" + body + "\n  }) AS " + name

    nodes = [f"  MATCH (n:{n})", f"  OPTIONAL MATCH (n)-[out:{r}]->()", "  WITH n, count(out) AS outEdgeCount", f"  OPTIONAL MATCH ()-[in:{r}]->(n)",
             "  WITH n, outEdgeCount, count(in) AS inEdgeCount", "  ORDER BY n.id",
             collect({"nodeId": "n.id", "nodeProperties": "properties(n)", "outEdgeCount": "outEdgeCount", "inEdgeCount": "inEdgeCount", "totalEdgeCount": "outEdgeCount + inEdgeCount"}, "nodes")]
    edges = [f"  MATCH (from:{n})-[r:{r}]->(to:{n})", "  WITH from, r, to", "  ORDER BY from.id, to.id",
             collect({"fromNodeId": "from.id", "toNodeId": "to.id", "relationType": "type(r)", "edgeProperties": "properties(r)"}, "edges")]
    call = lambda lines: "CALL {\n" + "\n".join(lines) + "\n}"
    return Statement(f"{call(nodes)}\n{call(edges)}\nRETURN nodes, edges", {})
