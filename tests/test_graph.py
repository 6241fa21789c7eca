"""The graph API: filters, algorithms, transactions, import and export."""

import pytest
from pyspark.sql import functions as F

from nodeloom import Graph, GraphManager
from nodeloom.errors import EdgeAlreadyExistsError, InvalidGraphDataError, InvalidPropertyError, NodeAlreadyExistsError, NodeHasEdgesError, NodeNotFoundError, TransactionConflictError, TransactionFailedError, TransactionNotActiveError
from nodeloom.functions.registry import register, unregister


def lettered(spark, edges, labels=None):
    names = sorted({x for e in edges for x in e[:2]})
    return Graph.import_json(spark, {"nodes": [{"id": n, "labels": [(labels or {}).get(n, "Node")], "properties": {"name": n}} for n in names], "edges": [{"id": f"{e[0]}{e[1]}", "sourceId": e[0], "targetId": e[1], "type": e[2] if len(e) > 2 else "CONNECTS", "properties": {}} for e in edges]})


CYCLE = [("A", "B"), ("B", "C"), ("A", "D"), ("D", "E"), ("D", "F"), ("B", "D")]


def test_shortest_paths(spark):
    g = lettered(spark, CYCLE)
    assert g.traverse("A", "C") == [["A", "B", "C"]]
    assert g.traverse("A", "F") == [["A", "D", "F"]]
    assert g.traverse("C", "A") is None
    assert g.traverse("A", "A") == [["A"]]
    assert sorted(map(len, g.traverse(["A", "B"], ["E", "F"]))) == [3, 3, 3, 3]
    assert len(g.traverse("A", "*")) == 6
    h = lettered(spark, [("A", "B", "X"), ("B", "C", "X"), ("A", "C", "Y")], {"B": "Mid"})
    assert h.traverse("A", "C", edge_types=["X"]) == [["A", "B", "C"]]
    assert h.traverse("A", "C", node_types=["Node"], edge_types=["X"]) is None


def test_shortest_paths_of_all_conversations(spark):
    from nodeloom.queries import QUERIES

    sf_dir = "/root/testdata/sf0.01"
    turns = {(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn").collect()}
    want = []
    for c in {c for c, _ in turns}:
        at, nodes = 0, 1
        while (c, at) in turns and at < 3:
            at, nodes = at + 1, nodes + 1
        if (c, 0) in turns and (c, at) in turns and at == 3:
            want.append((c * 1_000_000, c * 1_000_000 + 3, nodes))
    assert len(want) > 20
    assert sorted(map(tuple, QUERIES["bfs_shortest"](spark, sf_dir).collect())) == sorted(want)


def test_dag_and_order(spark):
    g = lettered(spark, CYCLE)
    order = g.topological_sort()
    assert g.is_dag()
    assert all(order.index(a) < order.index(b) for a, b in CYCLE)
    loop = lettered(spark, [("A", "B"), ("B", "A"), ("B", "C")])
    assert not loop.is_dag()
    assert loop.topological_sort() is None
    assert not lettered(spark, [("A", "A")]).is_dag()
    assert Graph(spark).topological_sort() == []


def test_filters_and_counts(spark):
    g = Graph(spark)
    g.add_nodes([{"id": str(a), "labels": ["Person"], "properties": {"age": a, "name": f"P{a}"}} for a in (25, 35, 45)])
    names = lambda p, **o: [r["name"] for r in g.get_nodes({"filter": {"types": ["Person"], "properties": p}} | o).orderBy("name").collect()]
    assert names([{"key": "age", "op": ">", "value": 30}]) == ["P35", "P45"]
    assert names({"or": [{"key": "age", "value": 25}, {"and": [{"key": "age", "op": ">=", "value": 45}, {"key": "name", "op": "ENDS_WITH", "value": "5"}]}]}) == ["P25", "P45"]
    assert names([{"key": "age", "op": "NOT_IN", "value": [25, 35]}]) == ["P45"]
    assert names([{"key": "none", "op": "IS_NULL"}]) == ["P25", "P35", "P45"]
    assert [r["age"] for r in g.get_nodes({"order_by": [("age", "desc")], "limit": 2}).collect()] == [45, 35]
    assert g.get_node_count({"filter": {"types": ["Other"]}}) == 0
    assert g.aggregate_node_property("age") == {"count": 3, "sum": 105, "avg": 35.0, "min": 25, "max": 45}
    assert g.aggregate_node_property("name") == {"count": 0}


def test_mutations(spark):
    g = Graph(spark)
    a, b = g.add_node("A", {"x": 1}, "a"), g.add_node(["B", "C"], None, "b")
    e = g.add_edge(a, b, "E", {"w": 1.5}, "e")
    with pytest.raises(NodeAlreadyExistsError):
        g.add_node("A", {}, "a")
    with pytest.raises(EdgeAlreadyExistsError):
        g.add_edge(a, b, "E", {}, "e")
    with pytest.raises(NodeNotFoundError):
        g.add_edge(a, "zz", "E")
    with pytest.raises(InvalidPropertyError):
        g.add_node("A", {"x": [1]})
    assert [r["_id"] for r in g.get_direct_edges_between("b", "a").collect()] == [e]
    assert g.get_edges_from("a").count() == g.get_edges_to("b").count() == 1
    g.set_node_properties("a", {"y": "z"})
    g.unset_node_properties("a", ["x"])
    assert {k: v for k, v in g.get_node("a").items() if k in "xy"} == {"y": "z"}
    g.set_node_properties("a", {"q": True}, merge=False)
    assert "y" not in g.get_node("a")
    g.remove_node_labels("b", ["C"])
    assert g.get_node("b")["_labels"] == ["B"]
    with pytest.raises(NodeHasEdgesError):
        g.remove_node("a")
    assert g.remove_node("a", cascade=True)
    assert not g.remove_edge("e")
    assert g.get_nodes_by_ids(["a", "b", "b"]).keys() == {"b"}
    g.compact()
    g.clear()
    assert g.get_node_count() == 0


def test_transactions(spark):
    g = Graph(spark)
    g.add_node("A", {"x": 1}, "a")
    t, u = g.create_transaction(), g.create_transaction()
    with pytest.raises(TransactionNotActiveError):
        t.commit()
    t.begin()
    u.begin()
    g.query("MATCH (n:A) SET n.x = 2", transaction=t)
    assert g.query("MATCH (n:A) RETURN n.x AS x", transaction=t).rows == [{"x": 2}]
    assert g.query("MATCH (n:A) RETURN n.x AS x").rows == [{"x": 1}]
    g.set_node_properties("a", {"y": 5}, transaction=u)
    t.commit()
    u.commit()  # another property of the same node
    assert (g.get_node("a")["x"], g.get_node("a")["y"]) == (2, 5)
    t.begin()
    u.begin()
    g.set_node_properties("a", {"x": 3}, transaction=t)
    g.set_node_properties("a", {"x": 4}, transaction=u)
    t.commit()
    with pytest.raises(TransactionConflictError):
        u.commit()
    with pytest.raises(TransactionFailedError):
        u.commit()
    u.rollback()
    assert g.get_node("a")["x"] == 3


def test_interchange(spark, tmp_path):
    from nodeloom.sources import interchange

    g = lettered(spark, CYCLE)
    again = Graph.import_json(spark, g.export_json())
    assert again.export_json() == g.export_json()
    text = g.to_mermaid(show_properties=True, direction="LR")
    assert text.startswith("flowchart LR") and 'A -->|"CONNECTS"| B' in text
    with pytest.raises(InvalidGraphDataError):
        Graph.import_json(spark, {"nodes": []})
    interchange.write_json(g._snapshot, f"{tmp_path}/n", f"{tmp_path}/e")
    back = interchange.read_json(spark, f"{tmp_path}/n", f"{tmp_path}/e")
    assert (back.nodes.count(), back.edges.count()) == (6, 6)


def test_registry_and_manager(spark):
    g = GraphManager.init(spark).for_graph("one")
    assert GraphManager.get_instance().for_graph("one") is g
    register("toUpper", F.upper, "string")
    try:
        assert g.query("RETURN toUpper('a') AS x").rows == [{"x": "A"}]
    finally:
        unregister("toUpper")
        GraphManager.reset()


def test_random_graphs_against_brute_force(spark):
    """Trails, existence and two-hop counts on random graphs."""
    import random

    for seed in (1, 2):
        r = random.Random(seed)
        nodes = [f"n{i}" for i in range(6)]
        edges = [(f"e{i}", r.choice(nodes), r.choice(nodes), r.choice("XY")) for i in range(9)]
        g = Graph.import_json(spark, {"nodes": [{"id": n, "labels": ["N"], "properties": {"k": i}} for i, n in enumerate(nodes)], "edges": [{"id": e, "sourceId": a, "targetId": b, "type": t, "properties": {}} for e, a, b, t in edges]})

        def trails(at, used, depth, edges=edges):
            for e, a, b, _ in edges:
                if a == at and e not in used:
                    yield b
                    if depth > 1:
                        yield from trails(b, used | {e}, depth - 1)

        want = sorted((n, b) for n in nodes for b in trails(n, frozenset(), 3))
        got = sorted((x["a"], x["b"]) for x in g.query("MATCH (a)-[*1..3]->(b) RETURN id(a) AS a, id(b) AS b").rows)
        assert got == want
        two = sum(1 for _, a, b, _ in edges for _, c, d, _ in edges if b == c)
        assert g.query("MATCH (a)-[]->(b)-[]->(c) RETURN count(*) AS n").rows == [{"n": two}]
        has = sorted(n for n in nodes if not any(a == n and t == "X" for _, a, _, t in edges))
        assert sorted(x["n"] for x in g.query("MATCH (a) WHERE NOT (a)-[:X]->() RETURN id(a) AS n").rows) == has


def test_deleting_nodes_compares_no_edge_with_every_node(spark, monkeypatch):
    from nodeloom.plans.compiler import explain

    g = Graph(spark)
    g.query("CREATE (a:A {k: 1})-[:E]->(b:A {k: 2}), (a)-[:E]->(c:B {k: 3}), (c)-[:E]->(b), (c)-[:E]->(d:B {k: 4}), (a)-[:E]->(a)")
    frame = type(spark.range(1))
    plans, count = [], frame.count
    monkeypatch.setattr(frame, "count", lambda df: (plans.append(explain(df)), count(df))[1])
    done = g.query("MATCH (a:A) DETACH DELETE a").summary
    assert (done["nodes_deleted"], done["edges_deleted"]) == (2, 4)  # edges of both ends and loops count once
    assert plans and not [p for p in plans if "NestedLoop" in p or "Cartesian" in p]
    monkeypatch.undo()
    assert (g.get_node_count(), g.get_edge_count()) == (2, 1)
