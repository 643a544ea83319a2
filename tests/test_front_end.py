import pytest
from loomgraph.plans import spec, statement, yaml_subset

FERRY = """
# ships and the harbours they call at
version: 1
query:
  limit: 7
  return:
    items:
      - kind: EDGE
        ref: calls
        alias: visit
      - kind: PATH
        ref: route
        alias: voyage
  paths:
    - alias: route
      edges:
        - sails
        - calls
  edges:
    calls:
      from: leg
      to: port
      direction: Outbound
      type: CALLS_AT
      id: 40
    sails:
      from: ship
      to: leg
      direction: INBOUND
      properties:
        night: false
  nodes:
    ship:
      labels:
        - Ferry
        - Vessel
    leg:
      properties:
        miles: 12.5
    port:
      labels:
        - Harbour
      id: "oslo"
"""


def test_a_document_becomes_a_statement():
    s = statement.render(spec.load(FERRY))
    assert s.text.splitlines() == [
        "MATCH route = (ship:Ferry:Vessel)<-[sails]-(leg)-[calls:CALLS_AT]->(port:Harbour)",
        "WHERE leg.miles = $node_leg_prop_miles", "  AND port.id = $node_port_id", "  AND calls.id = $edge_calls_id", "  AND sails.night = $edge_sails_prop_night",
        "RETURN calls AS visit,", "       route AS voyage", "LIMIT 7",
    ]
    assert s.params == {"node_leg_prop_miles": 12.5, "node_port_id": "oslo", "edge_calls_id": 40, "edge_sails_prop_night": False}


def test_paths_that_meet_return_themselves():
    """Three paths from one hub, nothing asked for: each is returned under its own name, and a filter is written once."""
    spokes = ["rim0", "rim1", "rim2"]
    nodes = {"hub": spec.Node(("Wheel",), 3)} | {r: spec.Node((), None, {"bent": k == 1} if k else {}) for k, r in enumerate(spokes)}
    edges = {f"s{k}": spec.Edge("hub", r, "UNDIRECTED", "SPOKE" if k else None) for k, r in enumerate(spokes)}
    s = statement.render(spec.validated(spec.Query(nodes, edges, tuple(spec.Path(f"p{k}", (f"s{k}",)) for k in range(3)))))
    matches = [f"MATCH p{k} = (hub:Wheel)-[s{k}{':SPOKE' if k else ''}]-({r})" for k, r in enumerate(spokes)]
    assert s.text.splitlines() == [*matches, "WHERE hub.id = $node_hub_id", "  AND rim1.bent = $node_rim1_prop_bent", "  AND rim2.bent = $node_rim2_prop_bent", "RETURN p0 AS p0,", "       p1 AS p1,", "       p2 AS p2"]
    assert s.params == {"node_hub_id": 3, "node_rim1_prop_bent": True, "node_rim2_prop_bent": False}


@pytest.mark.parametrize(("direction", "arrow"), [("INBOUND", "(A)<-[e]-(B)"), ("UNDIRECTED", "(A)-[e]-(B)")])
def test_arrows(direction, arrow):
    q = spec.Query({"A": spec.Node(), "B": spec.Node()}, {"e": spec.Edge("A", "B", direction)}, (spec.Path("p", ("e",)),))
    assert statement.render(q).text.startswith(f"MATCH p = {arrow}\n")


def errors_of(text):
    with pytest.raises(spec.InvalidQuery) as e:
        spec.load(text)
    return {(x.field, x.message) for x in e.value.errors}


def test_errors_come_together():
    found = errors_of("""
version: 2
query:
  nodes:
    A:
      labels:
        - bad label
      properties:
        id: 1
    A-b:
      id: 3
    C:
      id: 4
  edges:
    x:
      from: A
      to: Z
    y:
      from: C
      to: C
      direction: OUTBOUND
    A:
      from: A
      to: A
      direction: OUTBOUND
  paths:
    - alias: p
      edges:
        - x
        - y
        - nope
    - alias: p
  return:
    items:
      - kind: NODE
        ref: Q
        alias: a
      - kind: PATH
        ref: p
        alias: a
  limit: 0
""")
    fields = {f for f, _ in found}
    assert {"version", "query.nodes.A.labels[0]", "query.nodes.A.properties.id", "query.nodes.A-b", "query.edges.x.to", "query.edges.x.direction", "query.paths[0].edges[1]", "query.paths[0].edges[2]",
            "query.paths[1].alias", "query.paths[1].edges", "query.edges.A", "query.return.items[0].ref", "query.return.items[1].alias", "query.limit"} <= fields
    assert any(f == "query.paths[0].edges[1]" and "path is not continuous" in m for f, m in found)
    assert any(f == "query.return.items[0].ref" and "unknown node reference" in m for f, m in found)


def test_missing_parts():
    assert {f for f, _ in errors_of("version: 1\nquery:\n  limit: 3\n")} == {"query.nodes", "query.edges", "query.paths"}
    assert {f for f, _ in errors_of("version: 1\n")} == {"query"}


def test_filtered_but_unused_and_repeated_edge():
    q = spec.Query({"A": spec.Node(), "B": spec.Node(), "C": spec.Node((), 1)}, {"e": spec.Edge("A", "A"), "f": spec.Edge("A", "B")}, (spec.Path("p", ("e", "e")),), (spec.Item("NODE", "B", "b"),))
    assert {e.field for e in spec.check(q)} == {"query.nodes.C", "query.paths[0].edges[1]", "query.return.items[0].ref"}


def request(conditions=(), hops=1):
    return {
        "limit": 5,
        "pathQuery": {
            "nodes": [{"alias": "x", "entityType": "City", "conditions": list(conditions)}, {"alias": "y", "entityType": "", "conditions": []}],
            "edges": [{"startNode": "y", "endNode": "x", "entityType": "ROAD", "hops": hops, "conditions": [{"property": "lanes", "value": 2}]}],
        },
    }


def test_request_dialect():
    s = statement.render(spec.from_request(request([{"property": "name", "operator": "CONTAINS", "value": "ham"}, {"property": "name", "operator": "eq", "value": "Hamm"}])))
    assert s.text.splitlines() == ["MATCH path0 = (y)-[e0:ROAD]->(x:City)", "WHERE x.name CONTAINS $node_x_cond0_value", "  AND x.name = $node_x_cond1_value", "  AND e0.lanes = $edge_e0_cond0_value", "RETURN path0 AS path0", "LIMIT 5"]
    assert s.params == {"node_x_cond0_value": "ham", "node_x_cond1_value": "Hamm", "edge_e0_cond0_value": 2}
    with pytest.raises(spec.InvalidQuery, match="single hops"):
        spec.from_request(request(hops=2))
    with pytest.raises(spec.InvalidQuery) as e:
        spec.from_request(request([{"property": "name", "operator": "LIKE", "value": "x"}, {"property": "two words", "value": 1}]))
    assert {x.field for x in e.value.errors} == {"pathQuery.nodes[0].conditions[0].operator", "pathQuery.nodes[0].conditions[1].property"}


def test_scalars():
    y = yaml_subset.parse('a: 1\nb: -2.5\nc: "x\\n\\"y\\q"\nd: \'it\'\'s\'\ne: ~\nf: TRUE # note\ng: a#b\nh: 3000000000\ni: [x, y]\nj:\nk: 1e5\nl: "#no"\n')
    assert y == {"a": 1, "b": -2.5, "c": 'x\n"yq', "d": "it's", "e": None, "f": True, "g": "a#b", "h": 3000000000, "i": "[x, y]", "j": None, "k": "1e5", "l": "#no"}


def test_sequences():
    assert yaml_subset.parse("s:\n  - a: 1\n    b: 2\n  -\n    c: 3\n  - plain\n  - 'q: r'\n") == {"s": [{"a": 1, "b": 2}, {"c": 3}, "plain", "q: r"]}
    assert yaml_subset.parse("") == {} and yaml_subset.parse("# only\n\n") == {}


@pytest.mark.parametrize("bad", ["a:\tb", "a: 1\na: 2", "a: 1\n  b: 2", "a:\n- b", "nokey", ": x", 'a: "', "- a\nb: 1", "a: 99999999999999999999", 'a: "x\\"', "s:\n  -\nb: 1", "  a: 1\nb: 2"])
def test_syntax_errors(bad):
    with pytest.raises(yaml_subset.YamlError):
        yaml_subset.parse(bad)
