"""A property graph over DataFrames: one table a label, one a relationship type.

A node's identity is its key within a space (labels that share rows, such as a
label and a narrower one, share a space); a relationship's is its `eid`
expression. Nothing is read until a query needs it, and then only the columns
it uses.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NodeTable:
    label: str
    frame: DataFrame
    key: str
    properties: dict  # property -> column; `id` is the business id
    space: str = ""

    def __post_init__(self):
        object.__setattr__(self, "space", self.space or self.label)


@dataclass(frozen=True)
class EdgeTable:
    type: str
    frame: DataFrame
    source: str  # space
    target: str
    source_key: str
    target_key: str
    properties: dict = field(default_factory=dict)
    eid: Column | None = None  # the whole row by default

    def identity(self) -> Column:
        return self.eid if self.eid is not None else F.struct(*[F.col(c) for c in self.frame.columns])


class PropertyGraph:
    def __init__(self, nodes: list[NodeTable], edges: list[EdgeTable]):
        self.nodes = {n.label: n for n in nodes}
        self.edges = edges
        #: A space's own table holds all its nodes; narrower labels hold some.
        self.whole = {n.space: n for n in reversed(nodes) if n.label == n.space}

    def spaces(self, labels: tuple) -> set[str]:
        """Spaces that can hold a node with all these labels."""
        if not labels:
            return set(self.whole)
        held = [{self.nodes[x].space} if x in self.nodes else set() for x in labels]
        return set.intersection(*held)

    def typed(self, kind: str | None) -> list[EdgeTable]:
        return [e for e in self.edges if kind is None or e.type == kind]


def tables_graph(spark, sf_dir: str) -> PropertyGraph:
    """The graph over the order tables, with documents, pages and users as further nodes."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    own = lambda df, p: {c.removeprefix(p): c for c in df.columns}
    customer, orders, part, supplier, nation, region = (read(t) for t in ("customer", "orders", "part", "supplier", "nation", "region"))
    lineitem, documents, pages, events = read("lineitem"), read("documents"), read("pages"), read("events")

    def node(label, df, key, prefix, space=""):
        return NodeTable(label, df, key, own(df, prefix) | {"id": key}, space)

    def edge(kind, df, source, target, a, b, prefix, eid):
        return EdgeTable(kind, df, source, target, a, b, own(df, prefix), eid)

    users = events.select("user_id").distinct()
    return PropertyGraph(
        [
            node("Customer", customer, "c_custkey", "c_"), node("Order", orders, "o_orderkey", "o_"), node("Part", part, "p_partkey", "p_"),
            node("Supplier", supplier, "s_suppkey", "s_"), node("Nation", nation, "n_nationkey", "n_"), node("Region", region, "r_regionkey", "r_"),
            node("Document", documents, "doc_id", ""), node("Page", pages, "page_id", ""), node("User", users, "user_id", ""),
            node("Urgent", orders.where("o_orderpriority = '1-URGENT'"), "o_orderkey", "o_", "Order"),
            node("Building", customer.where("c_mktsegment = 'BUILDING'"), "c_custkey", "c_", "Customer"),
        ],
        [
            edge("PLACED", orders, "Customer", "Order", "o_custkey", "o_orderkey", "o_", F.col("o_orderkey")),
            edge("CONTAINS", lineitem, "Order", "Part", "l_orderkey", "l_partkey", "l_", None),
            edge("SUPPLIED_FROM", lineitem, "Order", "Supplier", "l_orderkey", "l_suppkey", "l_", None),
            edge("SUPPLIED_BY", lineitem, "Part", "Supplier", "l_partkey", "l_suppkey", "l_", None),
            edge("IN_NATION", customer, "Customer", "Nation", "c_custkey", "c_nationkey", "c_", F.col("c_custkey")),
            edge("IN_NATION", supplier, "Supplier", "Nation", "s_suppkey", "s_nationkey", "s_", F.col("s_suppkey")),
            edge("IN_REGION", nation, "Nation", "Region", "n_nationkey", "n_regionkey", "n_", F.col("n_nationkey")),
        ],
    )
