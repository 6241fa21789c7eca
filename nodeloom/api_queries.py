"""Conformance queries of the graph API and of statements' side effects, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.errors import CypherError, GraphError
from nodeloom.graph import Graph, GraphManager
from nodeloom.sources import interchange
from nodeloom.sources.shared import shared_dir
from nodeloom.sources.tables import star_schema

Query = Callable[[SparkSession, str], DataFrame]


def _star(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(spark, star_schema(spark, sf_dir))


def _own(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers and nations as a graph of its own, whole tables."""
    from nodeloom.operators.mutations import Snapshot

    c, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    none = F.lit(None).cast("long")
    meta = [none.alias("createdOn"), none.alias("updatedOn")]
    nodes = c.select(F.concat(F.lit("c"), "c_custkey").alias("_id"), F.array(F.lit("Customer")).alias("_labels"), *meta, F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    nodes = nodes.unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("_id"), F.array(F.lit("Nation")).alias("_labels"), *meta, F.col("n_name").alias("name"), F.lit(None).cast("double").alias("bal")))
    edges = c.select(F.concat(F.lit("e"), "c_custkey").alias("_id"), F.concat(F.lit("c"), "c_custkey").alias("_src"), F.concat(F.lit("n"), "c_nationkey").alias("_dst"), F.lit("OF").alias("_type"), *meta, F.col("c_acctbal").alias("w"))
    g = Graph(spark)
    g._snapshot = Snapshot(nodes, edges)
    return g


def _row(spark: SparkSession, schema: str, *values: object) -> DataFrame:
    return spark.createDataFrame([values], schema)


def api_get_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = {"filter": {"types": ["CONTAINS"], "properties": [{"key": "quantity", "op": ">=", "value": 49}, {"key": "returnflag", "op": "=", "value": "R"}]}}
    return _star(spark, sf_dir).get_edges(options).select("_src", "_dst", "quantity")


def api_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _star(spark, sf_dir)
    return _row(spark, "customers long, placed long, places long", g.get_node_count({"filter": {"types": ["Customer"]}}), g.get_edge_count({"filter": {"types": ["PLACED"]}}), g.get_node_count({"filter": {"types": ["Nation", "Region"]}}))


def api_point_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _star(spark, sf_dir)
    node, several = g.get_node("Customer:7"), g.get_nodes_by_ids(["Nation:1", "Nation:2", "Nation:999"])
    return _row(spark, "name string, there boolean, absent boolean, names array<string>", node["name"], g.has_node("Region:0"), g.has_node("Region:99"), sorted(x["name"] for x in several.values()))


def api_edges_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _star(spark, sf_dir).get_edges_from("Customer:10").select("_src", "_dst", F.col("_type").alias("type"))


def api_edges_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _star(spark, sf_dir).get_edges_to("Nation:3", {"filter": {"types": ["IN_NATION"]}}).select("_src", F.col("_type").alias("type"))


def api_batch_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that leave the customers of one segment, and those that reach three nations."""
    g = _star(spark, sf_dir)
    some = g.query("MATCH (c:Customer) WHERE c.mktsegment = 'BUILDING' RETURN id(c) AS id").df
    out = g.get_edges_by_sources(some, {"filter": {"types": ["PLACED"]}}).select("_src", "_dst")
    return out.unionByName(g.get_edges_by_targets(["Nation:1", "Nation:2", "Nation:4"], {"filter": {"types": ["BASED_IN"]}}).select("_src", "_dst"))


def api_aggregate_edge_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _star(spark, sf_dir).aggregate_edge_property("quantity", {"types": ["CONTAINS"]}, distinct=True)
    return _row(spark, "n long, total double, lo double, hi double", r["count"], float(r["sum"]), float(r["min"]), float(r["max"]))


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole graph as JSON lines, read back and queried."""
    at = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    interchange.write_json(_own(spark, sf_dir)._tables(), f"{at}/nodes", f"{at}/edges")
    g = Graph(spark)
    g._snapshot = interchange.read_json(spark, f"{at}/nodes", f"{at}/edges")
    return g.query("MATCH (c:Customer)-[e:OF]->(n:Nation) RETURN n.name AS nation, count(c) AS n, sum(e.w) AS w").df


def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Python value and back, and its Mermaid form."""
    g = Graph(spark)
    g.add_nodes([{"id": "a", "labels": ["X"], "properties": {"k": 1}}, {"id": "b", "labels": ["Y", "X"], "properties": {"k": 2}}])
    g.add_edge("a", "b", "TO", {"w": 3}, "e")
    h = Graph.import_json(spark, g.export_json())
    text = h.to_mermaid()
    rows = h.query("MATCH (x)-[r:TO]->(y) RETURN id(x) AS x, id(y) AS y, r.w AS w, labels(y) AS labels").df
    return rows.withColumns({"labels": F.sort_array("labels"), "drawn": F.lit("TO" in text and text.startswith(("graph", "flowchart")))})


def set_returns_new_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own(spark, sf_dir).query("MATCH (c:Customer) WHERE c.bal < 0 SET c.bal = 0 - c.bal, c.owes = true RETURN c.name AS name, c.bal AS bal, c.owes AS owes").df


def write_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _own(spark, sf_dir)
    made = g.query("MATCH (n:Nation) CREATE (c:Capital {size: 1})-[:IN]->(n)").summary
    put = g.query("MATCH (c:Customer) WHERE c.bal > 9000 SET c.rich = true").summary
    gone = g.query("MATCH (c:Customer) WHERE c.bal < -900 DETACH DELETE c").summary
    return _row(spark, "nodes long, edges long, props long, nodes_gone long, edges_gone long", made["nodes_created"], made["edges_created"], put["properties_set"], gone["nodes_deleted"], gone["edges_deleted"])


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a transaction does is seen inside it, and outside it once committed; a rollback leaves nothing."""
    g = _own(spark, sf_dir)
    count = lambda tx=None: g.query("MATCH (c:Tmp) RETURN count(c) AS n", transaction=tx).rows[0]["n"]
    tx = g.create_transaction().begin()
    g.query("MATCH (n:Nation) CREATE (:Tmp)", transaction=tx)
    inside, outside = count(tx), count()
    tx.rollback()
    after_rollback = count()
    tx = g.create_transaction().begin()
    g.query("MATCH (n:Nation) WHERE n.name < 'F' CREATE (:Tmp)", transaction=tx)
    tx.commit()
    return _row(spark, "inside long, outside long, rolled_back long, committed long", inside, outside, after_rollback, count())


def api_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _own(spark, sf_dir)
    g.add_node("Hub", {"name": "hub"}, "h")
    g.add_edge("c1", "h", "VIA", {"w": 1.5}, "v1")
    g.add_edge("c2", "h", "VIA", {"w": 2.5}, "v2")
    g.set_edge_properties("v1", {"w": 9.0})
    g.unset_node_properties("c3", ["name"])
    g.remove_edge("v2")
    g.remove_node("c5", cascade=True)
    g.compact()
    return g.query("MATCH (c:Customer) OPTIONAL MATCH (c)-[v:VIA]->(h:Hub) RETURN count(DISTINCT c) AS customers, count(c.name) AS named, count(v) AS via, sum(v.w) AS w, max(h.name) AS hub").df


def drop_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _own(spark, sf_dir)
    for text in ("CREATE INDEX one FOR (n:Nation) ON (n.name)", "CREATE INDEX two FOR (c:Customer) ON (c.name, c.bal)", "DROP INDEX one"):
        g.query(text)
    g.create_index("three", "edge", ["w"], "OF")
    g.delete_index("two")
    rows = g.query("SHOW INDEXES").df.select("name", "target", "propertyKeys")
    return rows.withColumn("known", F.lit(g.has_index("edge", ["w"], "OF") and not g.has_index("node", ["name"], "Nation")))


def named_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = GraphManager(spark)
    m.for_graph("a").query("CREATE (:X {k: 1}), (:X {k: 2})")
    m.for_graph("b").query("CREATE (:X {k: 3})")
    total = lambda name: m.for_graph(name).query("MATCH (x:X) RETURN sum(x.k) AS k").rows[0]["k"]
    a, b = total("a"), total("b")
    m.drop("a")
    return _row(spark, "a long, b long, dropped long", a, b, m.for_graph("a").get_node_count())


def traverse_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest paths from three customers to every region, along two edge types."""
    paths = _star(spark, sf_dir).traverse_df(["Customer:1", "Customer:2", "Customer:3"], "*", ["Customer", "Nation", "Region"], ["IN_NATION", "IN_REGION"])
    return paths.where(F.startswith("dst", F.lit("Region:"))).select("src", "dst", F.size("path").alias("nodes"))


def traverse_depth_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _star(spark, sf_dir).traverse("Customer:4", "Region:0", "dfs", edge_types=["IN_NATION", "IN_REGION"])
    return _row(spark, "found boolean", found is not None)


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that must fail, by what is wrong with them."""
    g = _own(spark, sf_dir)
    wrong = {
        "union_width": "MATCH (n:Nation) RETURN n.name AS a UNION MATCH (n:Nation) RETURN n.name AS a, n.bal AS b",
        "union_names": "MATCH (n:Nation) RETURN n.name AS a UNION MATCH (n:Nation) RETURN n.name AS b",
        "aggregate_in_where": "MATCH (n) WHERE count(n) > 1 RETURN n",
        "nested_aggregate": "MATCH (n) RETURN sum(count(n)) AS x",
        "arity": "MATCH (n) RETURN size(n.name, 1) AS x",
        "unknown_function": "RETURN nosuch(1) AS x",
        "unbound": "RETURN nobody AS x",
        "syntax": "MATCH (n RETURN n",
        "delete_connected": "MATCH (n:Nation) DELETE n",
    }

    def fails(text: str) -> bool:
        try:
            g.query(text).df.count()
        except (CypherError, GraphError):
            return True
        return False

    return spark.createDataFrame([(k, fails(t)) for k, t in wrong.items()], "what string, fails boolean")


def no_rows_of_a_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _own(spark, sf_dir)
    told = g.query("MATCH (n:Nation) CREATE (:Flag {up: true})").df.count()
    return g.query("MATCH (f:Flag) RETURN count(f) AS made").df.withColumn("told", F.lit(told).cast("long"))


def cached_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _own(spark, sf_dir)
    g.warm_cache()
    out = g.query("MATCH (c:Customer)-[:OF]->(n:Nation {name: 'FRANCE'}) RETURN count(c) AS n").rows[0]["n"]
    for df in (g._snapshot.nodes, g._snapshot.edges):
        df.unpersist()
    return _row(spark, "n long", out)


_WRONG = ("union_width", "union_names", "aggregate_in_where", "nested_aggregate", "arity", "unknown_function", "unbound", "syntax", "delete_connected")

FUNCTIONS: dict[str, tuple[Query, str]] = {
    "api_get_edges": (api_get_edges, "SELECT 'Order:' || l_orderkey AS _src, 'Part:' || l_partkey AS _dst, l_quantity AS quantity FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R'"),
    "api_counts": (api_counts, "SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders) AS placed, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS places"),
    "api_point_lookups": (api_point_lookups, "SELECT (SELECT c_name FROM customer WHERE c_custkey = 7) AS name, true AS there, false AS absent, (SELECT list(n_name ORDER BY n_name) FROM nation WHERE n_nationkey IN (1, 2)) AS names"),
    "api_edges_from": (api_edges_from, "SELECT 'Customer:10' AS _src, 'Order:' || o_orderkey AS _dst, 'PLACED' AS type FROM orders WHERE o_custkey = 10 UNION ALL SELECT 'Customer:10', 'Nation:' || c_nationkey, 'IN_NATION' FROM customer WHERE c_custkey = 10"),
    "api_edges_to": (api_edges_to, "SELECT 'Customer:' || c_custkey AS _src, 'IN_NATION' AS type FROM customer WHERE c_nationkey = 3"),
    "api_batch_adjacency": (api_batch_adjacency, "SELECT 'Customer:' || o_custkey AS _src, 'Order:' || o_orderkey AS _dst FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'Supplier:' || s_suppkey, 'Nation:' || s_nationkey FROM supplier WHERE s_nationkey IN (1, 2, 4)"),
    "api_aggregate_edge_property": (api_aggregate_edge_property, "SELECT count(DISTINCT l_quantity) AS n, sum(DISTINCT l_quantity) AS total, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem"),
    "json_round_trip": (json_round_trip, "SELECT n_name AS nation, count(*) AS n, sum(c_acctbal) AS w FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1"),
    "json_export": (json_export, "SELECT 'a' AS x, 'b' AS y, 3 AS w, ['X', 'Y'] AS labels, true AS drawn"),
    "set_returns_new_values": (set_returns_new_values, "SELECT c_name AS name, -c_acctbal AS bal, true AS owes FROM customer WHERE c_acctbal < 0"),
    "write_counters": (write_counters, "SELECT (SELECT count(*) FROM nation) AS nodes, (SELECT count(*) FROM nation) AS edges, (SELECT count(*) FROM customer WHERE c_acctbal > 9000) AS props, (SELECT count(*) FROM customer WHERE c_acctbal < -900) AS nodes_gone, (SELECT count(*) FROM customer WHERE c_acctbal < -900) AS edges_gone"),
    "transactions": (transactions, "SELECT count(*) AS inside, 0 AS outside, 0 AS rolled_back, count(*) FILTER (WHERE n_name < 'F') AS committed FROM nation"),
    "api_mutations": (api_mutations, "SELECT count(*) - 1 AS customers, count(*) - 2 AS named, 1 AS via, 9.0::DOUBLE AS w, 'hub' AS hub FROM customer"),
    "drop_index": (drop_index, "SELECT 'three' AS name, 'edge' AS target, ['w'] AS propertyKeys, true AS known"),
    "named_graphs": (named_graphs, "SELECT 3 AS a, 3 AS b, 0 AS dropped"),
    "traverse_typed": (traverse_typed, "SELECT 'Customer:' || c_custkey AS src, 'Region:' || n_regionkey AS dst, 3 AS nodes FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey IN (1, 2, 3)"),
    "traverse_depth_first": (traverse_depth_first, "SELECT n_regionkey = 0 AS found FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey = 4"),
    "errors": (errors, "SELECT what, true AS fails FROM (VALUES " + ", ".join(f"('{x}')" for x in _WRONG) + ") t(what)"),
    "no_rows_of_a_write": (no_rows_of_a_write, "SELECT count(*) AS made, 0 AS told FROM nation"),
    "cached_graph": (cached_graph, "SELECT count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_name = 'FRANCE'"),
}
