import json

import pytest
from loomgraph.operators import branches
from loomgraph.operators.match import match, optional_match, project
from loomgraph.operators.property_graph import EdgeTable, NodeTable, PropertyGraph
from loomgraph.operators.walks import shortest_paths, walks
from loomgraph.plans import spec
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([(1, "alpha", "online"), (2, "beta-service", "online"), (3, "gamma", "online"), (4, "delta", "offline")], "id long, name string, status string")
    edges = spark.createDataFrame([(10, 1, 2, "depends", "core-service", "valid"), (11, 2, 3, "flows", "core-chain", "valid"), (12, 2, 4, "sync", "edge-to-delta", "valid")], "eid long, src long, dst long, type string, remark string, status string")
    loops = spark.createDataFrame([(20, 1, 1), (21, 1, 2)], "eid long, a long, b long")
    own = {c: c for c in ("id", "name", "status")}
    return PropertyGraph(
        [NodeTable("Node", nodes, "id", own), NodeTable("Online", nodes.where("status = 'online'"), "id", own, "Node")],
        [EdgeTable("REL", edges, "Node", "Node", "src", "dst", {c: c for c in ("type", "remark", "status")}, F.col("eid")), EdgeTable("LOOP", loops, "Node", "Node", "a", "b", {}, F.col("eid"))],
    )


def q(nodes, edges, paths, **how):
    return spec.validated(spec.Query(nodes, edges, tuple(spec.Path(a, tuple(x)) for a, x in paths.items()), **how))


def ids(df):
    return sorted(map(tuple, df.collect()))


N, E = spec.Node, spec.Edge


def test_directions(graph):
    ab = {"a": ("a", "id"), "b": ("b", "id")}
    for direction, want in (("OUTBOUND", [(1, 2), (2, 3), (2, 4)]), ("INBOUND", [(2, 1), (3, 2), (4, 2)]), ("UNDIRECTED", [(1, 2), (2, 1), (2, 3), (2, 4), (3, 2), (4, 2)])):
        assert ids(project(graph, q({"a": N(), "b": N()}, {"e": E("a", "b", direction, "REL")}, {"p": ["e"]}), ab)) == want
    loops = project(graph, q({"a": N(), "b": N()}, {"e": E("a", "b", "UNDIRECTED", "LOOP")}, {"p": ["e"]}), ab)
    assert ids(loops) == [(1, 1), (1, 2), (2, 1)]  # a loop once
    one = project(graph, q({"a": N()}, {"e": E("a", "a", "OUTBOUND", None)}, {"p": ["e"]}), {"a": ("a", "id")})
    assert ids(one) == [(1,)]


def test_relationships_differ_within_a_path_only(graph):
    nodes = {"a": N(), "b": N(), "c": N()}
    edges = {"x": E("a", "b", "UNDIRECTED", "REL"), "y": E("b", "c", "UNDIRECTED", "REL")}
    within = project(graph, q(nodes, edges, {"p": ["x", "y"]}), {"a": ("a", "id"), "c": ("c", "id")})
    assert ids(within) == [(1, 3), (1, 4), (3, 1), (3, 4), (4, 1), (4, 3)]
    across = project(graph, q(nodes, edges, {"p": ["x"], "r": ["y"]}), {"a": ("a", "id"), "c": ("c", "id")})
    assert across.count() == 6 + 6


def test_type_strictness_and_null(graph):
    e = {"e": E("a", "b", "OUTBOUND", "REL")}
    count = lambda n: project(graph, q({"a": n, "b": N()}, e, {"p": ["e"]}), {"a": ("a", "id")}).count()
    assert count(N((), 1)) == 1 and count(N((), "1")) == 0 and count(N((), None, {"name": None})) == 0 and count(N((), None, {"nothing": 1})) == 0 and count(N((), None, {"status": True})) == 0


def test_labels_limit_and_empty(graph):
    e = {"e": E("a", "b", "OUTBOUND", "REL")}
    assert ids(project(graph, q({"a": N(), "b": N(("Node", "Online"))}, e, {"p": ["e"]}), {"b": ("b", "id")})) == [(2,), (3,)]
    assert match(graph, q({"a": N(("Nope",)), "b": N()}, e, {"p": ["e"]})).collect() == []
    assert match(graph, q({"a": N(), "b": N()}, e, {"p": ["e"]}, limit=2)).count() == 2


def test_return_items(graph):
    items = (spec.Item("PATH", "p", "way"), spec.Item("NODE", "b", "end"), spec.Item("EDGE", "e", "rel"))
    row = match(graph, q({"a": N((), 1), "b": N()}, {"e": E("a", "b", "OUTBOUND", "REL")}, {"p": ["e"]}, items=items)).first()
    assert json.loads(row.end) == {"id": 2, "name": "beta-service", "status": "online"} and json.loads(row.rel)["remark"] == "core-service"
    assert [json.loads(x)["id"] for x in row.way["nodes"]] == [1, 2] and len(row.way["relationships"]) == 1


def test_cartesian_and_optional(graph, spark):
    two = q({"a": N((), 1), "b": N(), "c": N((), 2), "d": N()}, {"x": E("a", "b", "OUTBOUND", "REL"), "y": E("c", "d", "OUTBOUND", "REL")}, {"p": ["x"], "r": ["y"]})
    assert ids(project(graph, two, {"b": ("b", "id"), "d": ("d", "id")})) == [(2, 3), (2, 4)]
    rows = spark.createDataFrame([(1,), (4,)], "k long")
    opt = optional_match(rows, "k", graph, q({"a": N(), "b": N()}, {"e": E("a", "b", "OUTBOUND", "REL")}, {"p": ["e"]}), "a", {"b": ("b", "id")})
    assert sorted(map(tuple, opt.collect())) == [(1, 2), (4, None)]


def demo():
    c, n, e = branches.Condition, branches.NodeRef, branches.EdgeRef
    return [
        branches.Branch("branch-1", (n("a", (c("name", "EQ", "alpha"),)), n("b", (c("name", "CONTAINS", "service"),)), n("c", (c("status", "EQ", "online"),))), (e("ab", (c("type", "EQ", "depends"),)), e("bc", (c("remark", "CONTAINS", "chain"),)))),
        branches.Branch("branch-2", (n("b", (c("name", "CONTAINS", "service"),)), n("d", (c("name", "EQ", "delta"),))), (e("bd", (c("status", "EQ", "valid"),)),)),
    ]


def test_branches(graph):
    rows = {r.branch: [json.loads(x)["id"] for x in r.nodeSummaries] for r in branches.branch_paths(graph, demo()).collect()}
    assert rows == {"branch-1": [1, 2, 3], "branch-2": [2, 4]}
    s = branches.branch_statement(demo())
    assert s.text.startswith("MATCH p0 = (a:Node)-[ab:REL]->(b:Node)-[bc:REL]->(c:Node)\nWHERE a.name = $branch0_node0_cond0_value\n  AND b.name CONTAINS $branch0_node1_cond0_value\n")
    assert "UNION ALL\nMATCH p1 = (b:Node)-[bd:REL]->(d:Node)\n" in s.text and s.text.endswith("[rel IN relationships(p1) | properties(rel)] AS edgeSummaries")
    assert s.params["branch0_edge1_cond0_value"] == "chain"


def test_branch_errors():
    n = branches.NodeRef
    for bad in ([], [branches.Branch(" ", (n("a"), n("b")), (branches.EdgeRef("e"),))], [branches.Branch("x", (n("a"),), ())], [branches.Branch("x", (n("a"), n("b")), ())], [branches.Branch("x", (n("a"), n("a")), (branches.EdgeRef("e"),))], [branches.Branch("x", (n("a-"), n("b")), (branches.EdgeRef("e"),))]):
        with pytest.raises(ValueError):
            branches.check_branches(bad)
    assert "'it\\'s' AS branch" in branches.branch_statement([branches.Branch("it's", (n("a"), n("b")), (branches.EdgeRef("e"),))]).text


def test_summary(graph, spark):
    row = branches.summary(graph).first()
    assert [(x.nodeId, x.outEdgeCount, x.inEdgeCount, x.totalEdgeCount) for x in row.nodes] == [(1, 1, 0, 1), (2, 2, 1, 3), (3, 0, 1, 1), (4, 0, 1, 1)]
    assert [(x.fromNodeId, x.toNodeId, x.relationType) for x in row.edges] == [(1, 2, "REL"), (2, 3, "REL"), (2, 4, "REL")]
    assert json.loads(row.nodes[0].nodeProperties)["name"] == "alpha"
    empty = PropertyGraph([NodeTable("Node", spark.createDataFrame([], "id long"), "id", {"id": "id"})], [])
    assert tuple(branches.summary(empty).first()) == ([], [])
    assert branches.summary_statement().text.count("CALL {") == 2 and "totalEdgeCount: outEdgeCount + inEdgeCount" in branches.summary_statement().text


def test_walks(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "a long, b long")
    assert sorted(map(tuple, walks(e, "a", "b", 2, 2).collect())) == [(1, 3, 2), (2, 1, 2), (2, 4, 2), (3, 2, 2)]
    assert dict(((r.a, r.b), r.hops) for r in shortest_paths(e, "a", "b").collect())[(1, 4)] == 3


def test_shortest_paths_are_never_cut_silently(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(4)], "a int, b int")
    assert {(r.a, r.b): r.hops for r in shortest_paths(e, "a", "b", most=4).collect()} == {(a, b): b - a for a in range(5) for b in range(a + 1, 5)}
    with pytest.raises(RuntimeError):
        shortest_paths(e, "a", "b", most=2)
