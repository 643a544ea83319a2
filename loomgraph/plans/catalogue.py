"""Registered queries and the SQL each is held against. Every query reads its whole tables."""

from __future__ import annotations

import json
import uuid
from pathlib import Path as FilePath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import json_paths
from ..functions.shared import shared_folder
from ..operators import branches, corpus
from ..operators.match import exists, match, optional_match, project
from ..operators.property_graph import tables_graph
from ..operators.walks import shortest_paths, walks
from . import spec

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def pattern(nodes: dict, edges: dict, paths: dict, limit: int | None = None) -> spec.Query:
    """nodes: alias -> label, or (label, id, properties); edges: alias -> (from, to, direction, type, properties)."""
    n = {a: spec.Node((x,) if isinstance(x, str) else tuple(x or ())) if not isinstance(x, spec.Node) else x for a, x in nodes.items()}
    e = {a: spec.Edge(x[0], x[1], x[2] if len(x) > 2 else "OUTBOUND", x[3] if len(x) > 3 else None, None, x[4] if len(x) > 4 else {}) for a, x in edges.items()}
    return spec.validated(spec.Query(n, e, tuple(spec.Path(a, tuple(x)) for a, x in paths.items()), (), limit))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SINGLE_CHAIN = """
version: 1
query:
  nodes:
    C:
      labels:
        - Customer
      properties:
        mktsegment: BUILDING
    O:
      labels:
        - Order
      properties:
        orderpriority: 1-URGENT
    P:
      labels:
        - Part
      properties:
        brand: "Brand#2"
  edges:
    placed:
      from: C
      to: O
      direction: OUTBOUND
      type: PLACED
    holds:
      from: O
      to: P
      direction: OUTBOUND
      type: CONTAINS
  paths:
    - alias: chain
      edges:
        - placed
        - holds
"""


@query("""
SELECT c_custkey AS customer, o_orderkey AS order_id, p_partkey AS part, l_linenumber AS line, l_quantity AS quantity
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
WHERE c_mktsegment = 'BUILDING' AND o_orderpriority = '1-URGENT' AND p_brand = 'Brand#2'""")
def path_single_chain(spark, sf_dir):
    columns = {"customer": ("C", "id"), "order_id": ("O", "id"), "part": ("P", "id"), "line": ("holds", "linenumber"), "quantity": ("holds", "quantity")}
    return project(tables_graph(spark, sf_dir), spec.load(SINGLE_CHAIN), columns)


@query("""
SELECT c_custkey AS customer, o_orderkey AS order_id, p_name AS part_name, l_returnflag AS flag, l_extendedprice AS price
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
WHERE c_mktsegment = 'BUILDING' AND l_returnflag = 'R' AND p_brand = 'Brand#17'""")
def path_two_hop_edge_props(spark, sf_dir):
    q = pattern({"c": spec.Node(("Customer",), None, {"mktsegment": "BUILDING"}), "o": "Order", "p": spec.Node(("Part",), None, {"brand": "Brand#17"})},
                {"x": ("c", "o", "OUTBOUND", "PLACED"), "y": ("o", "p", "OUTBOUND", "CONTAINS", {"returnflag": "R"})}, {"p0": ["x", "y"]})
    return project(tables_graph(spark, sf_dir), q, {"customer": ("c", "id"), "order_id": ("o", "id"), "part_name": ("p", "name"), "flag": ("y", "returnflag"), "price": ("y", "extendedprice")})


@query("""
SELECT o_orderkey AS order_id, c_custkey AS customer, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'""")
def path_inbound(spark, sf_dir):
    q = pattern({"o": spec.Node(("Order",), None, {"orderpriority": "1-URGENT"}), "c": "Customer"}, {"e": ("o", "c", "INBOUND", "PLACED")}, {"p": ["e"]})
    return project(tables_graph(spark, sf_dir), q, {"order_id": ("o", "id"), "customer": ("c", "id"), "name": ("c", "name")})


@query("""
SELECT n_nationkey::BIGINT AS a, 'Nation' AS a_label, r_regionkey::BIGINT AS b, 'Region' AS b_label FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT r_regionkey::BIGINT, 'Region', n_nationkey::BIGINT, 'Nation' FROM nation JOIN region ON n_regionkey = r_regionkey""")
def path_undirected(spark, sf_dir):
    q = pattern({"a": (), "b": ()}, {"e": ("a", "b", "UNDIRECTED", "IN_REGION")}, {"p": ["e"]})
    df = project(tables_graph(spark, sf_dir), q, {"a": ("a", "id"), "a_label": ("a", "label()"), "b": ("b", "id"), "b_label": ("b", "label()")})
    return df.withColumns({"a": F.col("a").cast("long"), "b": F.col("b").cast("long")})


@query("""
SELECT kind, count(*) AS n, sum(a) AS sum_a, sum(b) AS sum_b FROM (
  SELECT 'PLACED' AS kind, o_custkey AS a, o_orderkey AS b FROM orders
  UNION ALL SELECT 'IN_NATION', c_custkey, c_nationkey::BIGINT FROM customer) GROUP BY kind""")
def path_untyped(spark, sf_dir):
    q = pattern({"a": "Customer", "b": ()}, {"e": ("a", "b")}, {"p": ["e"]})
    df = project(tables_graph(spark, sf_dir), q, {"kind": ("e", "type()"), "a": ("a", "id"), "b": ("b", "id")})
    return df.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("sum_a"), F.sum("b").alias("sum_b"))


@query("""
SELECT c_custkey AS customer, o_orderkey AS order_id, o_totalprice AS price FROM customer JOIN orders ON o_custkey = c_custkey
WHERE c_mktsegment = 'BUILDING' AND o_orderpriority = '1-URGENT'""")
def path_multilabel(spark, sf_dir):
    q = pattern({"c": ("Customer", "Building"), "o": ("Order", "Urgent")}, {"e": ("c", "o", "OUTBOUND", "PLACED")}, {"p": ["e"]})
    return project(tables_graph(spark, sf_dir), q, {"customer": ("c", "id"), "order_id": ("o", "id"), "price": ("o", "totalprice")})


@query("""
SELECT o_orderkey AS order_id, l1.l_partkey AS part, l2.l_suppkey AS supplier, s_name AS supplier_name, l1.l_linenumber AS part_line, l2.l_linenumber AS supplier_line
FROM orders JOIN lineitem l1 ON l1.l_orderkey = o_orderkey JOIN part ON p_partkey = l1.l_partkey
JOIN lineitem l2 ON l2.l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l2.l_suppkey
WHERE o_orderpriority = '1-URGENT' AND p_brand = 'Brand#2' AND s_acctbal > 0""")
def path_branching(spark, sf_dir):
    q = pattern({"o": spec.Node(("Order",), None, {"orderpriority": "1-URGENT"}), "p": spec.Node(("Part",), None, {"brand": "Brand#2"}), "s": "Supplier"},
                {"x": ("o", "p", "OUTBOUND", "CONTAINS"), "y": ("o", "s", "OUTBOUND", "SUPPLIED_FROM")}, {"a": ["x"], "b": ["y"]})
    columns = {"order_id": ("o", "id"), "part": ("p", "id"), "supplier": ("s", "id"), "supplier_name": ("s", "name"), "part_line": ("x", "linenumber"), "supplier_line": ("y", "linenumber")}
    return project(tables_graph(spark, sf_dir), q, columns, {"s": [("acctbal", ">", 0)]})


@query("""
SELECT c_custkey AS customer, o_orderkey AS order_id, n_name AS nation, p_brand AS brand FROM customer JOIN orders ON o_custkey = c_custkey
JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN nation ON n_nationkey = c_nationkey
WHERE o_orderstatus = 'F' AND p_brand = 'Brand#2'""")
def path_shared_edge(spark, sf_dir):
    q = pattern({"c": "Customer", "o": spec.Node(("Order",), None, {"orderstatus": "F"}), "p": spec.Node(("Part",), None, {"brand": "Brand#2"}), "n": "Nation"},
                {"placed": ("c", "o", "OUTBOUND", "PLACED"), "holds": ("o", "p", "OUTBOUND", "CONTAINS"), "home": ("c", "n", "OUTBOUND", "IN_NATION")},
                {"whole": ["placed", "holds"], "again": ["placed"], "other": ["home"]})
    return project(tables_graph(spark, sf_dir), q, {"customer": ("c", "id"), "order_id": ("o", "id"), "nation": ("n", "name"), "brand": ("p", "brand")})


@query("""
SELECT a.n_name AS one, r_name AS region, b.s_name AS supplier FROM nation a JOIN region ON a.n_regionkey = r_regionkey,
supplier b JOIN nation c ON c.n_nationkey = b.s_nationkey WHERE r_name = 'ASIA' AND b.s_acctbal > 5000""")
def path_cartesian(spark, sf_dir):
    q = pattern({"n": "Nation", "r": spec.Node(("Region",), None, {"name": "ASIA"}), "s": "Supplier", "m": "Nation"},
                {"x": ("n", "r", "OUTBOUND", "IN_REGION"), "y": ("s", "m", "OUTBOUND", "IN_NATION")}, {"a": ["x"], "b": ["y"]})
    return project(tables_graph(spark, sf_dir), q, {"one": ("n", "name"), "region": ("r", "name"), "supplier": ("s", "name")}, {"s": [("acctbal", ">", 5000)]})


_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(f"""
SELECT a.l_orderkey AS order_id, a.l_partkey AS one, b.l_partkey AS other, b.l_linenumber AS line FROM orders
JOIN lineitem a ON a.l_orderkey = o_orderkey JOIN lineitem b ON b.l_orderkey = o_orderkey
WHERE a.l_returnflag = 'R' AND a.l_quantity = 50 AND NOT ({' AND '.join(f'a.{c} = b.{c}' for c in _LINE)})""")
def path_edge_uniqueness(spark, sf_dir):
    q = pattern({"p": "Part", "o": "Order", "r": "Part"},
                {"x": ("p", "o", "INBOUND", "CONTAINS", {"returnflag": "R", "quantity": 50}), "y": ("o", "r", "OUTBOUND", "CONTAINS")}, {"a": ["x", "y"]})
    return project(tables_graph(spark, sf_dir), q, {"order_id": ("o", "id"), "one": ("p", "id"), "other": ("r", "id"), "line": ("y", "linenumber")})


@query("SELECT 0::BIGINT AS null_property, 0::BIGINT AS wrong_type, count(*) AS unknown_is_null FROM orders")
def path_null_property(spark, sf_dir):
    g = tables_graph(spark, sf_dir)

    def count(properties, name, tests=None):
        q = pattern({"c": spec.Node(("Customer",), None, properties), "o": "Order"}, {"e": ("c", "o", "OUTBOUND", "PLACED")}, {"p": ["e"]})
        return project(g, q, {"id": ("o", "id")}, tests).agg(F.count(F.lit(1)).alias(name))

    a, b = count({"mktsegment": None}, "null_property"), count({"name": 1}, "wrong_type")
    return a.crossJoin(b).crossJoin(count({}, "unknown_is_null", {"c": [("nothing", "IS NULL", None)]}))


@query("SELECT least(count(*), 25) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def path_limit_count(spark, sf_dir):
    q = pattern({"c": spec.Node(("Customer",), None, {"mktsegment": "BUILDING"}), "o": "Order"}, {"e": ("c", "o", "OUTBOUND", "PLACED")}, {"p": ["e"]}, limit=25)
    return project(tables_graph(spark, sf_dir), q, {"id": ("o", "id")}).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderkey AS order_id, 2 AS n_nodes, json_extract_string(c, '$.name') AS customer FROM (
  SELECT o_orderkey, to_json({'name': c_name}) AS c FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING')""")
def path_return_json(spark, sf_dir):
    q = pattern({"c": spec.Node(("Customer",), None, {"mktsegment": "BUILDING"}), "o": "Order"}, {"e": ("c", "o", "OUTBOUND", "PLACED")}, {"p": ["e"]})
    df = match(tables_graph(spark, sf_dir), q)
    nodes = F.col("p.nodes")
    return df.select(F.get_json_object(nodes[1], "$.orderkey").cast("long").alias("order_id"), F.size(nodes).alias("n_nodes"), F.get_json_object(nodes[0], "$.name").alias("customer"))


@query("""
SELECT 'ring-parts' AS branch, 3::INT AS n_nodes, c_name AS first, p_name AS last FROM customer JOIN orders ON o_custkey = c_custkey
JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_mktsegment = 'BUILDING' AND p_name LIKE '%ring%'
UNION ALL SELECT 'nations', 2, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE '%A%' """)
def branches_union_all(spark, sf_dir):
    c, n, e = branches.Condition, branches.NodeRef, branches.EdgeRef
    two = [
        branches.Branch("ring-parts", (n("c", (c("mktsegment", "EQ", "BUILDING"),), "Customer"), n("o", (), "Order"), n("p", (c("name", "CONTAINS", "ring"),), "Part")), (e("x", (), "PLACED"), e("y", (), "CONTAINS"))),
        branches.Branch("nations", (n("n", (), "Nation"), n("r", (c("name", "CONTAINS", "A"),), "Region")), (e("z", (), "IN_REGION"),)),
    ]
    df = branches.branch_paths(tables_graph(spark, sf_dir), two)
    nodes = F.col("nodeSummaries")
    return df.select("branch", F.size(nodes).alias("n_nodes"), F.get_json_object(nodes[0], "$.name").alias("first"), F.get_json_object(F.element_at(nodes, -1), "$.name").alias("last"))


@query("""
SELECT o_orderkey AS "nodeId", coalesce(n, 0) AS "outEdgeCount", 0::BIGINT AS "inEdgeCount", coalesce(n, 0) AS "totalEdgeCount"
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def summary_nodes(spark, sf_dir):
    return branches.degrees(tables_graph(spark, sf_dir), "Order", "CONTAINS").drop("nodeProperties")


@query("""
SELECT n_nationkey AS "nodeId", coalesce(o, 0) AS "outEdgeCount", coalesce(i, 0) AS "inEdgeCount", coalesce(o, 0) + coalesce(i, 0) AS "totalEdgeCount"
FROM nation LEFT JOIN (SELECT n_regionkey * 0 + n_nationkey AS k, count(*) FILTER (WHERE false) AS o FROM nation GROUP BY 1) ON k = n_nationkey
LEFT JOIN (SELECT nk, count(*) AS i FROM (SELECT c_nationkey AS nk FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1) ON nk = n_nationkey""")
def summary_in_degrees(spark, sf_dir):
    return branches.degrees(tables_graph(spark, sf_dir), "Nation", "IN_NATION").drop("nodeProperties")


@query("""SELECT 'IN_REGION' AS kind, 0::BIGINT AS n_edges, 25::BIGINT AS n_nodes, 25::BIGINT AS out_total""")
def summary_totals(spark, sf_dir):
    df = branches.summary(tables_graph(spark, sf_dir), "Nation", "IN_REGION")
    total = F.aggregate(F.transform("nodes", lambda x: x["outEdgeCount"]), F.lit(0).cast("long"), lambda a, b: a + b)
    return df.select(F.lit("IN_REGION").alias("kind"), F.size("edges").cast("long").alias("n_edges"), F.size("nodes").cast("long").alias("n_nodes"), total.alias("out_total"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 0 THEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS positive FROM events")
def json_path_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", json_paths.at_path(F.col("props"), "k").alias("k"), json_paths.positive_number(F.col("props"), "k").alias("positive"))


@query("SELECT event_id, unnest(['[' || json_extract_string(props, '$.k') || ',1]', json_extract_string(props, '$.k')]) AS item FROM events")
def json_array_flatten(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    nested = F.concat(F.lit('{"data":{"list":[['), k, F.lit(',1],'), k, F.lit(']}}'))
    return table(spark, sf_dir, "events").select("event_id", F.explode(json_paths.elements(nested, "data.list")).alias("item"))


@query("""
SELECT 'exact-' || row_number() OVER (ORDER BY n DESC, total_lines DESC, first_uid) AS group_id, first_uid, n, total_lines FROM (
  SELECT sha1(text) AS h, count(*) AS n, sum(len(string_split(text, chr(10))))::BIGINT AS total_lines, min(doc_id) AS first_uid FROM documents GROUP BY 1 HAVING count(*) >= 2)""")
def dup_exact_groups(spark, sf_dir):
    units = table(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("h"), F.size(F.split("text", "\n")).alias("lines"))
    return corpus.exact_groups(units, "h", "doc_id", "lines").select("group_id", "first_uid", "n", "total_lines")


@query("""
SELECT key, sum(n)::BIGINT AS occurrences, count(*) AS distinct_values, CASE WHEN count(*) > 1 THEN 'conflict' ELSE 'duplicate' END AS status,
       string_agg(value, ',' ORDER BY value) AS "values" FROM (SELECT p_name AS key, p_brand AS value, count(*) AS n FROM part WHERE p_name IS NOT NULL AND p_brand <> '' GROUP BY 1, 2)
GROUP BY key HAVING sum(n) >= 2""")
def version_conflicts(spark, sf_dir):
    df = corpus.version_groups(table(spark, sf_dir, "part"), "p_name", "p_brand", F.col("p_type"))
    return df.select("key", "occurrences", "distinct_values", "status", F.array_join(F.transform("values", lambda x: x["value"]), ",").alias("values"))


@query("""
SELECT c_nationkey AS key, count(*) AS occurrences, 1::BIGINT AS distinct_values, 'duplicate' AS status FROM customer JOIN nation ON n_nationkey = c_nationkey
JOIN region ON r_regionkey = n_regionkey GROUP BY 1 HAVING count(*) >= 2""")
def version_duplicates(spark, sf_dir):
    q = pattern({"c": "Customer", "n": "Nation", "r": "Region"}, {"x": ("c", "n", "OUTBOUND", "IN_NATION"), "y": ("n", "r", "OUTBOUND", "IN_REGION")}, {"p": ["x", "y"]})
    rows = project(tables_graph(spark, sf_dir), q, {"key": ("n", "id"), "value": ("r", "name"), "module": ("c", "name")})
    return corpus.version_groups(rows, "key", "value", F.col("module")).drop("values")


_MODULES = "SELECT DISTINCT 'n' || n_nationkey AS module, 'n' || (n_nationkey * 7 + 3) % 25 AS key FROM nation UNION SELECT 'n' || n_nationkey, 'n' || (n_nationkey * 3 + 1) % 25 FROM nation WHERE n_nationkey % 2 = 0"


@query(f"""
WITH RECURSIVE deps AS ({_MODULES}), mods AS (SELECT DISTINCT module AS key FROM deps),
walk(consumer, cur, path, level, go) AS (
  SELECT d.module, d.key, [d.module, d.key], 1, d.key <> d.module FROM deps d JOIN mods m ON d.key = m.key
  UNION ALL
  SELECT w.consumer, d.key, list_append(w.path, d.key), w.level + 1, NOT list_contains(w.path, d.key) AND d.key IN (SELECT key FROM mods)
  FROM walk w JOIN deps d ON w.cur = d.module WHERE w.go AND d.key <> w.consumer)
SELECT DISTINCT consumer, cur AS dependency, array_to_string(path, ' -> ') AS path FROM walk WHERE level > 1""")
def reachability_paths(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    key = lambda c: F.concat(F.lit("n"), c.cast("string"))
    one = n.select(key(F.col("k")).alias("module"), key((F.col("k") * 7 + 3) % 25).alias("key"))
    two = n.where("k % 2 = 0").select(key(F.col("k")).alias("module"), key((F.col("k") * 3 + 1) % 25).alias("key"))
    deps = one.union(two).distinct()
    return corpus.reachable(deps, deps.select(F.col("module").alias("key")))


_TOKENS = ["example.com", " ", "the "]


@query("""
WITH l AS (SELECT doc_id AS path, unnest(range(1, len(x) + 1)) AS line, unnest(x) AS value FROM (SELECT doc_id, string_split_regex(regexp_replace(text, '\\n$', ''), '\\n') AS x FROM documents WHERE text <> ''))
SELECT rule, path, line, n FROM (
  SELECT 'legacy-token-1' AS rule, path, line, ((length(value) - length(replace(value, 'example.com', ''))) / 11)::BIGINT AS n FROM l
  UNION ALL SELECT 'legacy-token-3', path, line, len(regexp_extract_all(value, 'the'))::BIGINT FROM l) WHERE n > 0""".replace("\\n", r"\n"))
def rule_scan_tokens(spark, sf_dir):
    found = corpus.scan(table(spark, sf_dir, "documents"), "doc_id", "text", corpus.token_rules(_TOKENS))
    return found.groupBy("rule", "path", "line").agg(F.count(F.lit(1)).alias("n"))


@query(r"""
WITH l AS (SELECT page_id, unnest(string_split_regex(html, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]')) AS value FROM pages),
m AS (SELECT page_id, 'hard-coded-localhost-url' AS rule, 'medium' AS severity, unnest(regexp_extract_all(value, 'https?://(localhost|127\.0\.0\.1|0\.0\.0\.0)(:[0-9]+)?(/[A-Za-z0-9._~@%+=,:/?#&\-]*)?')) AS x FROM l
  UNION ALL SELECT page_id, 'file-url', 'high', unnest(regexp_extract_all(value, 'file:///[A-Za-z0-9._~@%+=,:/\-]+')) FROM l
  UNION ALL SELECT page_id, 'windows-absolute-path', 'high', unnest(regexp_extract_all(value, '[A-Za-z]:\\+[A-Za-z0-9._~ @%+=,:\\\-]+')) FROM l
  UNION ALL SELECT page_id, 'absolute-posix-path', 'high', unnest(regexp_extract_all(value, '(^|[^\w.])/(Users|home|private|var|opt|tmp|data|mnt|Volumes|srv)/[A-Za-z0-9._~@%+=,:/\-]+')) FROM l
  UNION ALL SELECT page_id, 'probable-fully-qualified-name', 'medium', unnest(regexp_extract_all(value, '\b[a-z][a-z0-9_]*(?:\.[a-z][a-z0-9_]*){3,}\.[A-Z][A-Za-z0-9_]*\b')) FROM l)
SELECT coalesce(bool_or(severity = 'high'), false) AS failed, count(*) FILTER (WHERE severity = 'high') AS n FROM m""")
def severity_gate(spark, sf_dir):
    return corpus.severity_gate(corpus.scan(table(spark, sf_dir, "pages"), "page_id", "html", corpus.RULES), "high")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2 ORDER BY n DESC, lang, source LIMIT 20")
def profile_top_counts(spark, sf_dir):
    return corpus.top_counts(table(spark, sf_dir, "documents"), ["lang", "source"], 20)


@query("SELECT 'greets' AS name FROM documents WHERE lower(text) LIKE '%example.com%' LIMIT 1")
def profile_any_token(spark, sf_dir):
    return corpus.any_token(table(spark, sf_dir, "documents"), "text", {"greets": ["example.com", "example.org"], "never": ["☃☃"]})


def _tasks(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("task_id"), F.pmod("o_custkey", F.lit(997)).alias("list"),
        F.when(F.col("o_orderstatus") == "F", "DONE").when(F.col("o_orderstatus") == "O", "IN_PROGRESS").otherwise("TODO").alias("status"),
        F.when(F.col("o_orderpriority") == "5-LOW", "FAIL").when(F.col("o_orderstatus") == "F", "OK").otherwise("PENDING").alias("check"),
    )


_TASKS = """SELECT o_orderkey AS task_id, o_custkey % 997 AS list, CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'IN_PROGRESS' ELSE 'TODO' END AS status,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'FAIL' WHEN o_orderstatus = 'F' THEN 'OK' ELSE 'PENDING' END AS chk FROM orders"""


@query(f"""SELECT list, CASE WHEN bool_or(chk = 'FAIL') THEN 'FAIL' WHEN bool_and(status = 'DONE' AND chk = 'OK') THEN 'PASS' ELSE 'PENDING' END AS gate FROM ({_TASKS}) GROUP BY list""")
def checklist_gate(spark, sf_dir):
    return corpus.gate(_tasks(spark, sf_dir), by=["list"])


@query(f"""SELECT list, done, total, (CASE WHEN x - floor(x) = 0.5 AND floor(x) % 2 = 0 THEN floor(x) ELSE floor(x + 0.5) END)::INT AS percent FROM (
  SELECT list, count(*) FILTER (WHERE status = 'DONE') AS done, count(*) AS total, count(*) FILTER (WHERE status = 'DONE') * 100.0::DOUBLE / count(*) AS x FROM ({_TASKS}) GROUP BY list)""")
def checklist_progress(spark, sf_dir):
    return corpus.progress(_tasks(spark, sf_dir), by=["list"])


@query(f"""SELECT task_id, CASE WHEN task_id % 3 = 0 THEN 'BLOCKED' ELSE status END AS status FROM ({_TASKS})""")
def checklist_update(spark, sf_dir):
    tasks = _tasks(spark, sf_dir)
    return corpus.upsert_tasks(tasks, tasks.where("task_id % 3 = 0").select("task_id", F.lit("BLOCKED").alias("status"))).select("task_id", "status")


@query("""
SELECT l_orderkey AS grp, row_number() OVER w AS line, l_linenumber % 3 AS depth, l_partkey::VARCHAR AS name, last_value(CASE WHEN l_linenumber % 3 = 0 THEN l_partkey END IGNORE NULLS) OVER w AS header
FROM (SELECT DISTINCT * FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def section_carry_forward(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").distinct().select(F.col("l_orderkey").alias("grp"), F.row_number().over(w).alias("line"), (F.col("l_linenumber") % 3).alias("depth"), F.col("l_partkey").cast("string").alias("name"))
    return corpus.carry_forward(rows, "grp", "line", F.when(F.col("depth") == 0, F.col("name").cast("long")), "header")


@query("""
WITH t AS (SELECT e.user_id AS grp, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line, (event_id % 3)::INT AS depth, event_type || event_id AS name FROM events e)
SELECT grp, line, depth, name, CASE depth WHEN 1 THEN last_value(CASE WHEN depth = 0 THEN name END IGNORE NULLS) OVER w WHEN 2 THEN last_value(CASE WHEN depth = 1 THEN name END IGNORE NULLS) OVER w END AS parent
FROM t WINDOW w AS (PARTITION BY grp ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def tree_ancestors(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("grp"), F.row_number().over(w).alias("line"), (F.col("event_id") % 3).cast("int").alias("depth"), F.concat("event_type", F.col("event_id").cast("string")).alias("name"))
    return corpus.tree_parents(rows, "grp", "line", "depth", "name").drop("tree_path")


@query("""
SELECT 'both' AS side, count(*) AS n FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')
UNION ALL SELECT 'only', count(*) FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""")
def set_intersect_except(spark, sf_dir):
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    flag = lambda f: line.where(F.col("l_returnflag") == f).select("l_partkey")
    both, only = flag("R").intersect(flag("A")), part.select("p_partkey").exceptAll(flag("R").distinct()).distinct()
    count = lambda df, s: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("side"), "n")
    return count(both, "both").unionAll(count(only, "only"))


@query()
def near_dup_clusters(spark, sf_dir):
    text = F.concat_ws(" ", "p_name", "p_brand")
    units = table(spark, sf_dir, "part").groupBy(text.alias("text")).agg(F.min("p_partkey").alias("uid"))
    units = units.select("uid", "text", F.length("text").alias("size"), F.sha1("text").alias("hash"))
    return corpus.similar_groups(units, "uid", "text", "size", "hash", budget=None).select("component", F.array_join("members", ",").alias("members"), "n", "similarity")


def _pages_folder(spark: SparkSession) -> FilePath:
    """A new folder that the driver and all executors see: pages are read as files."""
    root = shared_folder(spark)
    if "://" in root and not root.startswith("file://"):
        raise ValueError(f"pages as files need a mounted folder, not {root}")
    folder = FilePath(root.removeprefix("file://").removeprefix("file:")) / f"pages-{uuid.uuid4().hex}"
    folder.mkdir(parents=True)
    return folder


@query("""
SELECT (id // 10 + 1)::INT AS page, (id % 10)::INT AS position, id::BIGINT AS region FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS id FROM nation)""")
def paged_collect(spark, sf_dir):
    from ..sources import paged_json

    folder = _pages_folder(spark)
    ids = [r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]  # 25 rows at any size
    pages = [ids[k : k + 10] for k in range(0, len(ids), 10)]
    for k, page in enumerate(pages, 1):
        (folder / f"page-{k}.json").write_text(json.dumps({"data": {"list": [{"id": i} for i in page], "totalPages": len(pages)}}))
    paged_json.register(spark)
    df = spark.read.format("paged_json").option("urlTemplate", f"{folder}/page-{{page}}.json").option("dataPath", "data.list").option("totalPagesPath", "data.totalPages").load()
    return df.where("error IS NULL").select("page", "position", F.get_json_object("item", "$.id").cast("long").alias("region"))


# --- documented extensions of the pattern language --------------------------------------------------------------------


@query("""
SELECT c_custkey AS customer, o_orderkey AS order_id FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey""")
def optional_match_orders(spark, sf_dir):
    q = pattern({"c": "Customer", "o": spec.Node(("Order",), None, {"orderstatus": "P"})}, {"e": ("c", "o", "OUTBOUND", "PLACED")}, {"p": ["e"]})
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"))
    return optional_match(rows, "customer", tables_graph(spark, sf_dir), q, "c", {"order_id": ("o", "id")})


@query("""
SELECT c_custkey AS customer FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_quantity >= 50)
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""")
def exists_pattern(spark, sf_dir):
    g = tables_graph(spark, sf_dir)
    one = pattern({"c": "Customer", "o": "Order", "p": "Part"}, {"x": ("c", "o", "OUTBOUND", "PLACED"), "y": ("o", "p", "OUTBOUND", "CONTAINS")}, {"a": ["x", "y"]})
    two = pattern({"c": "Customer", "o": "Urgent"}, {"x": ("c", "o", "OUTBOUND", "PLACED")}, {"a": ["x"]})
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"))
    return exists(exists(rows, "customer", g, one, "c", tests={"y": [("quantity", ">=", 50)]}), "customer", g, two, "c", negate=True)


@query("""
SELECT p_partkey AS part, p_name AS name FROM part WHERE (p_name LIKE 'b%' OR p_name LIKE '%g') AND p_size IN (1, 7, 15) AND p_brand <> 'Brand#2' AND p_retailprice < 1500""")
def string_predicates(spark, sf_dir):
    from ..functions.predicates import compare

    df = table(spark, sf_dir, "part")
    t = lambda c, op, v: compare(F.col(c), df.schema[c].dataType, op, v)
    return df.where((t("p_name", "STARTS WITH", "b") | t("p_name", "ENDS WITH", "g")) & t("p_size", "IN", [1, 7, 15]) & t("p_brand", "<>", "Brand#2") & t("p_retailprice", "<", 1500)).select(F.col("p_partkey").alias("part"), F.col("p_name").alias("name"))


_EDGES = "SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation UNION SELECT n_nationkey, (n_nationkey * 3 + 1) % 25 FROM nation"


@query(f"""
WITH RECURSIVE e AS ({_EDGES}), w(start, cur, edges, hops) AS (
  SELECT a, b, [a * 100 + b], 1 FROM e UNION ALL SELECT w.start, e.b, list_append(edges, e.a * 100 + e.b), hops + 1 FROM w JOIN e ON e.a = w.cur WHERE hops < 3 AND NOT list_contains(edges, e.a * 100 + e.b))
SELECT start AS a, cur AS b, hops, count(*) AS n FROM w GROUP BY ALL""")
def variable_length(spark, sf_dir):
    return walks(_ring(spark, sf_dir), "a", "b", 1, 3).groupBy("a", "b", "hops").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH RECURSIVE e AS ({_EDGES}), w(start, cur, hops) AS (
  SELECT DISTINCT a, b, 1 FROM e UNION SELECT w.start, e.b, hops + 1 FROM w JOIN e ON e.a = w.cur WHERE hops < 25)
SELECT start AS a, cur AS b, min(hops) AS hops FROM w WHERE start <> cur GROUP BY 1, 2""")
def shortest_path(spark, sf_dir):
    return shortest_paths(_ring(spark, sf_dir), "a", "b")


def _ring(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    return n.select(F.col("n_nationkey").alias("a"), F.expr("(n_nationkey * 7 + 3) % 25").alias("b")).union(n.selectExpr("n_nationkey", "(n_nationkey * 3 + 1) % 25")).distinct()


@query("SELECT o_custkey AS customer, count(*) AS n, sum(o_totalprice) AS total, avg(o_totalprice) AS mean, min(o_orderkey) AS first, count(DISTINCT o_orderstatus) AS statuses FROM orders GROUP BY 1 HAVING count(*) > 12 ORDER BY n DESC, customer LIMIT 50 OFFSET 5")
def with_having_top(spark, sf_dir):
    q = pattern({"c": "Customer", "o": "Order"}, {"e": ("c", "o", "OUTBOUND", "PLACED")}, {"p": ["e"]})
    rows = project(tables_graph(spark, sf_dir), q, {"customer": ("c", "id"), "order_id": ("o", "id"), "price": ("e", "totalprice"), "status": ("e", "orderstatus")})
    grouped = rows.groupBy("customer").agg(F.count("order_id").alias("n"), F.sum("price").alias("total"), F.avg("price").alias("mean"), F.min("order_id").alias("first"), F.count_distinct("status").alias("statuses"))
    return grouped.where("n > 12").orderBy(F.desc("n"), "customer").offset(5).limit(50)


@query("SELECT DISTINCT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("""
SELECT doc_id, unnest(string_split(coalesce(lang, '?') || ',' || upper(source), ',')) AS word, CASE WHEN n_chars > 1000 THEN 'long' WHEN n_chars > 300 THEN 'middle' ELSE 'short' END AS size FROM documents""")
def unwind_case(spark, sf_dir):
    size = F.when(F.col("n_chars") > 1000, "long").when(F.col("n_chars") > 300, "middle").otherwise("short")
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.concat_ws(",", F.coalesce("lang", F.lit("?")), F.upper("source")), ",")).alias("word"), size.alias("size"))


@query("SELECT doc_id, n_chars % 2 = 0 AS fresh FROM documents")
def incremental_reuse(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.lit(0).alias("mtime"))
    before = docs.select("doc_id", "n_chars", F.expr("CAST(n_chars % 2 AS INT)").alias("mtime"))
    return corpus.fingerprint_join(docs, before, "doc_id", ["n_chars", "mtime"]).select("doc_id", "fresh")
