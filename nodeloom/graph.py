"""The graph: queries, reads, mutations, indexes, transactions, algorithms, import and export."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.errors import EdgeAlreadyExistsError, EdgeNotFoundError, GraphError, NodeAlreadyExistsError, NodeHasEdgesError, NodeNotFoundError, TransactionConflictError, TransactionFailedError, TransactionNotActiveError, TraversalLimitExceededError
from nodeloom.operators import algorithms
from nodeloom.operators.mutations import EDGE_SCHEMA, NODE_SCHEMA, Add, Change, DropLabels, Remove, Snapshot, Update, conflicts
from nodeloom.plans import filters
from nodeloom.plans import syntax as s
from nodeloom.plans.compiler import Compiler, explain
from nodeloom.plans.describe import describe
from nodeloom.plans.parser import parse
from nodeloom.plans.writer import Summary, Writer
from nodeloom.sources import interchange
from nodeloom.sources.catalog import Catalog, quoted
from nodeloom.sources.shared import publish

#: Parsed statements by text; a plan is bound to parameters and tables anew each time.
parsed = lru_cache(maxsize=512)(parse)


@dataclass
class QueryResult:
    """A lazy result and the counters of what the statement changed."""

    df: DataFrame
    summary: dict[str, int]
    plan: str | None = None

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def rows(self) -> list[dict[str, Any]]:
        return [r.asDict(recursive=True) for r in self.df.collect()]


@dataclass(frozen=True)
class Index:
    name: str
    target: str
    property_keys: tuple[str, ...]
    label_or_type: str | None = None


class Transaction:
    """Staged changes over the snapshot at begin(); reads see them, commit() applies them to the newest snapshot."""

    def __init__(self, graph: Graph) -> None:
        self.graph = graph
        self.active = self.failed = False
        self.changes: list[Change] = []

    def begin(self) -> Transaction:
        if self.active:
            raise GraphError("Transaction already active")
        self.active, self.failed, self.changes = True, False, []
        self.base = len(self.graph._log)
        self.snapshot = self.graph._snapshot
        return self

    def _check(self) -> None:
        if not self.active:
            raise TransactionNotActiveError("No transaction is open")
        if self.failed:
            raise TransactionFailedError("A statement of this transaction failed; roll it back")

    def commit(self) -> None:
        self._check()
        since = [c for done in self.graph._log[self.base :] for c in done]
        if conflicts(self.changes, since):
            self.failed = True
            raise TransactionConflictError("Another commit changed the same data")
        if self.changes:
            now = self.snapshot if not since else self.graph._snapshot
            for c in self.changes if since else []:
                now = c.apply(now).settled()
            self.graph._install(now, self.changes)
        self.active = False

    def rollback(self) -> None:
        if not self.active:
            raise TransactionNotActiveError("No transaction is open")
        self.active, self.changes = False, []


class Graph:
    """A property graph over DataFrames.

    Over a :class:`Catalog` of existing tables the graph is read-only; without one it is a snapshot that statements and
    methods replace by the next, and readers keep the one they began with.
    """

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, graph_id: str | None = None) -> None:
        self.spark, self.graph_id = spark, graph_id
        self._catalog = catalog
        self._snapshot = Snapshot.empty(spark)
        self._log: list[list[Change]] = []
        self._indexes: dict[str, Index] = {}

    # ---------------------------------------------------------------- state

    def _state(self, tx: Transaction | None = None) -> Snapshot:
        if tx is not None:
            tx._check()
            return tx.snapshot
        return self._snapshot

    def _install(self, snapshot: Snapshot, changes: list[Change]) -> None:
        self._snapshot = snapshot
        self._log.append(changes)

    def _change(self, changes: Iterable[Change], tx: Transaction | None = None, snapshot: Snapshot | None = None) -> None:
        if self._catalog is not None:
            raise GraphError("A graph over existing tables is read-only")
        changes = list(changes)
        now = self._state(tx)
        if snapshot is None:
            for c in changes:
                now = c.apply(now).settled()
        else:
            now = snapshot
        if tx is not None:
            tx.snapshot = now
            tx.changes += changes
        else:
            self._install(now, changes)

    def catalog(self, tx: Transaction | None = None) -> Catalog:
        return self._catalog if self._catalog is not None else self._state(tx).catalog()

    # ---------------------------------------------------------------- queries

    def query(self, text: str, params: dict[str, Any] | None = None, transaction: Transaction | None = None, execution_plan: str | None = None) -> QueryResult:
        """Runs a statement. ``execution_plan``: 'json', 'text' or 'mermaid' adds the plan with the rows and time of each step."""
        q = parsed(text)
        began = time.time()
        if isinstance(q, (s.CreateIndex, s.DropIndex, s.ShowIndexes)):
            return self._index_statement(q)
        if isinstance(q, s.Query) and any(g.writing for g in q.segments):
            if self._catalog is not None:
                raise GraphError("A graph over existing tables is read-only")
            try:
                out = Writer(self.spark, self._state(transaction), params).run(q)
            except Exception:
                if transaction is not None and transaction.active:
                    transaction.failed = True
                raise
            self._change(out.changes, transaction, out.snapshot)
            assert out.df is not None
            return QueryResult(out.df, out.summary.as_dict())
        c = Compiler(self.spark, self.catalog(transaction), params)
        c.trace = [] if execution_plan else None
        df = c.union(q) if isinstance(q, s.Union) else c.query(q)
        plan = None
        if execution_plan:
            df = df.cache()
            stats = {"rowsOut": df.count(), "timeMs": round((time.time() - began) * 1000, 3)}
            plan = describe(q, execution_plan, stats, c.trace)
        return QueryResult(df, Summary().as_dict(), plan)

    def sql_plan(self, text: str, params: dict[str, Any] | None = None) -> str:
        """Spark's formatted physical plan of a reading statement."""
        return explain(self.query(text, params).df)

    def get_query_plan(self, text: str, format: str = "json") -> str:
        return describe(parsed(text), format)

    # ---------------------------------------------------------------- indexes

    def create_index(self, name: str, target: str, keys: Iterable[str], label_or_type: str | None = None) -> None:
        index = Index(name, target, tuple(keys), label_or_type)
        if name in self._indexes:
            raise GraphError(f"Index with name '{name}' already exists")
        if any((i.target, set(i.property_keys), i.label_or_type) == (target, set(index.property_keys), label_or_type) for i in self._indexes.values()):
            raise GraphError(f"An index on {target} {list(index.property_keys)} already exists")
        self._indexes[name] = index

    def has_index(self, target: str, keys: Iterable[str], label_or_type: str | None = None) -> bool:
        wanted = set(keys)
        return any(i.target == target and set(i.property_keys) == wanted and i.label_or_type in (None, label_or_type) for i in self._indexes.values())

    def get_index(self, name: str) -> Index | None:
        return self._indexes.get(name)

    def get_indexes(self) -> list[Index]:
        return list(self._indexes.values())

    def delete_index(self, name: str) -> None:
        if self._indexes.pop(name, None) is None:
            raise GraphError(f"Index with name '{name}' does not exist")

    def _index_statement(self, q: Any) -> QueryResult:
        done = Summary()
        schema = "name string, target string, propertyKeys array<string>"
        if isinstance(q, s.CreateIndex):
            self.create_index(q.name, q.target, q.keys, q.label)
            done.indexes_created = 1
        elif isinstance(q, s.DropIndex):
            self.delete_index(q.name)
            done.indexes_deleted = 1
        else:
            return QueryResult(self.spark.createDataFrame([(i.name, i.target, list(i.property_keys)) for i in self._indexes.values()], schema), done.as_dict())
        return QueryResult(self.spark.createDataFrame([], ""), done.as_dict())

    # ---------------------------------------------------------------- reads

    def _tables(self, tx: Transaction | None = None) -> Snapshot:
        """Nodes and edges as one table each, with ids in global form."""
        if self._catalog is None:
            return self._state(tx)
        c = Compiler(self.spark, self._catalog)
        nodes, b = c.nodes((), "n")
        plain = [F.col(col).alias(k) for k, (col, _) in b.props.items()]
        n = nodes.select(b.identity().alias("_id"), F.col(b.labels).alias("_labels"), *[F.col(col).alias(m) for m, col in b.meta.items()], *plain)
        from nodeloom.functions.expressions import Node
        from nodeloom.sources.catalog import global_id

        edges, e, _ = c.edges(s.EdgePattern(None, (), (), False), "r", Node("x", None, None, {}), None)
        assert edges is not None
        out = edges.select(e.identity().alias("_id"), global_id(F.col(e.src), e.src_space).alias("_src"), global_id(F.col(e.dst), e.dst_space).alias("_dst"), F.col(e.type).alias("_type"), *[F.col(col).alias(k) for k, (col, _) in e.props.items()])
        return Snapshot(n, out)

    def get_nodes(self, options: dict[str, Any] | None = None, transaction: Transaction | None = None) -> DataFrame:
        return filters.select(self._tables(transaction).nodes, options, "_labels")

    def get_edges(self, options: dict[str, Any] | None = None, transaction: Transaction | None = None) -> DataFrame:
        return filters.select(self._tables(transaction).edges, options, "_type")

    def get_node_count(self, options: dict[str, Any] | None = None) -> int:
        return self.get_nodes(options).count()

    def get_edge_count(self, options: dict[str, Any] | None = None) -> int:
        return self.get_edges(options).count()

    @staticmethod
    def _entity(df: DataFrame, ident: str) -> dict[str, Any] | None:
        found = df.where(F.col("_id") == ident).limit(1).collect()
        return {k: v for k, v in found[0].asDict(recursive=True).items() if v is not None} if found else None

    def get_node(self, ident: str, transaction: Transaction | None = None) -> dict[str, Any] | None:
        return self._entity(self._tables(transaction).nodes, ident)

    def get_edge(self, ident: str, transaction: Transaction | None = None) -> dict[str, Any] | None:
        return self._entity(self._tables(transaction).edges, ident)

    def has_node(self, ident: str, transaction: Transaction | None = None) -> bool:
        return not self._tables(transaction).nodes.where(F.col("_id") == ident).isEmpty()

    def has_edge(self, ident: str, transaction: Transaction | None = None) -> bool:
        return not self._tables(transaction).edges.where(F.col("_id") == ident).isEmpty()

    def get_nodes_by_ids(self, ids: Iterable[str], transaction: Transaction | None = None) -> dict[str, dict[str, Any]]:
        rows = self._tables(transaction).nodes.where(F.col("_id").isin(list(ids))).collect()
        return {r["_id"]: {k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in rows}

    def _need_node(self, ident: str, tx: Transaction | None = None) -> None:
        if not self.has_node(ident, tx):
            raise NodeNotFoundError(f"Node '{ident}' does not exist")

    def get_edges_from(self, source: str, options: dict[str, Any] | None = None) -> DataFrame:
        self._need_node(source)
        return filters.select(self._tables().edges.where(F.col("_src") == source), options, "_type")

    def get_edges_to(self, target: str, options: dict[str, Any] | None = None) -> DataFrame:
        self._need_node(target)
        return filters.select(self._tables().edges.where(F.col("_dst") == target), options, "_type")

    def get_edges_by_sources(self, ids: Iterable[str] | DataFrame, options: dict[str, Any] | None = None) -> DataFrame:
        """Edges that leave any of ``ids`` (a list, or a DataFrame whose first column has them), in one semi-join."""
        return filters.select(self._edges_at("_src", ids), options, "_type")

    def get_edges_by_targets(self, ids: Iterable[str] | DataFrame, options: dict[str, Any] | None = None) -> DataFrame:
        return filters.select(self._edges_at("_dst", ids), options, "_type")

    def _edges_at(self, end: str, ids: Iterable[str] | DataFrame) -> DataFrame:
        edges = self._tables().edges
        if not isinstance(ids, DataFrame):
            return edges.where(F.col(end).isin(list(ids)))
        wanted = ids.select(F.col(quoted(ids.columns[0])).cast("string").alias("__wanted"))
        return edges.join(wanted, F.col(end) == F.col("__wanted"), "left_semi")

    def get_direct_edges_between(self, a: str, b: str, options: dict[str, Any] | None = None) -> DataFrame:
        """Edges of both directions, a self-loop once."""
        self._need_node(a)
        self._need_node(b)
        edges = self._tables().edges
        return filters.select(edges.where((F.col("_src") == a) & (F.col("_dst") == b) | (F.col("_src") == b) & (F.col("_dst") == a)), options, "_type")

    def _aggregate(self, df: DataFrame, key: str, distinct: bool) -> dict[str, Any]:
        numeric = key in df.columns and isinstance(df.schema[key].dataType, T.NumericType)
        if not numeric:
            return {"count": 0}
        c = F.col(quoted(key))
        df = df.select(c.alias("v")).where(F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double")))
        df = df.distinct() if distinct else df
        r = df.agg(F.count("v").alias("count"), F.sum("v").alias("sum"), F.avg("v").alias("avg"), F.min("v").alias("min"), F.max("v").alias("max")).first().asDict()
        return r if r["count"] else {"count": 0}

    def aggregate_node_property(self, key: str, filter: dict[str, Any] | None = None, distinct: bool = False) -> dict[str, Any]:
        return self._aggregate(self.get_nodes({"filter": filter} if filter else None), key, distinct)

    def aggregate_edge_property(self, key: str, filter: dict[str, Any] | None = None, distinct: bool = False) -> dict[str, Any]:
        return self._aggregate(self.get_edges({"filter": filter} if filter else None), key, distinct)

    # ---------------------------------------------------------------- mutations

    def add_nodes(self, items: Iterable[dict[str, Any]], transaction: Transaction | None = None) -> list[str]:
        """Items: {"labels", "properties", "id"?}."""
        now = int(time.time() * 1000)
        rows = [interchange.node_row({"id": str(uuid.uuid4()), "createdOn": now, "updatedOn": now} | {k: v for k, v in x.items() if v is not None}) for x in items]
        ids = [r["_id"] for r in rows]
        given = [i for i, x in zip(ids, rows, strict=True) if i is not None]
        if len(set(given)) < len(given) or given and not self._state(transaction).nodes.where(F.col("_id").isin(given)).isEmpty():
            raise NodeAlreadyExistsError("A node with one of these ids already exists")
        if rows:
            self._change([Add("node", interchange.frame(self.spark, rows, NODE_SCHEMA))], transaction)
        return ids

    def add_node(self, labels: str | Iterable[str], properties: dict[str, Any] | None = None, ident: str | None = None, transaction: Transaction | None = None) -> str:
        labels = [labels] if isinstance(labels, str) else list(labels)
        return self.add_nodes([{"labels": labels, "properties": properties or {}, "id": ident}], transaction)[0]

    def add_edges(self, items: Iterable[dict[str, Any]], transaction: Transaction | None = None) -> list[str]:
        """Items: {"sourceId", "targetId", "type", "properties"?, "id"?}; both ends must exist."""
        now = int(time.time() * 1000)
        rows = [interchange.edge_row({"id": str(uuid.uuid4()), "createdOn": now, "updatedOn": now} | {k: v for k, v in x.items() if v is not None}) for x in items]
        ids = [r["_id"] for r in rows]
        state = self._state(transaction)
        ends = {x for r in rows for x in (r["_src"], r["_dst"])}
        have = {r["_id"] for r in state.nodes.where(F.col("_id").isin(list(ends))).select("_id").collect()} if ends else set()
        if ends - have:
            raise NodeNotFoundError(f"Node '{sorted(ends - have)[0]}' does not exist")
        if len(set(ids)) < len(ids) or ids and not state.edges.where(F.col("_id").isin(ids)).isEmpty():
            raise EdgeAlreadyExistsError("An edge with one of these ids already exists")
        if rows:
            self._change([Add("edge", interchange.frame(self.spark, rows, EDGE_SCHEMA))], transaction)
        return ids

    def add_edge(self, source: str, target: str, kind: str, properties: dict[str, Any] | None = None, ident: str | None = None, transaction: Transaction | None = None) -> str:
        return self.add_edges([{"sourceId": source, "targetId": target, "type": kind, "properties": properties or {}, "id": ident}], transaction)[0]

    def _ids(self, ident: str) -> DataFrame:
        return self.spark.createDataFrame([(ident,)], "_id string")

    def remove_node(self, ident: str, cascade: bool = False, transaction: Transaction | None = None) -> bool:
        if not self.has_node(ident, transaction):
            return False
        touching = self._state(transaction).edges.where((F.col("_src") == ident) | (F.col("_dst") == ident))
        if not cascade and not touching.isEmpty():
            raise NodeHasEdgesError(f"Node '{ident}' has edges")
        self._change([Remove("node", self._ids(ident))], transaction)
        return True

    def remove_edge(self, ident: str, transaction: Transaction | None = None) -> bool:
        if not self.has_edge(ident, transaction):
            return False
        self._change([Remove("edge", self._ids(ident))], transaction)
        return True

    def _set(self, kind: str, ident: str, props: dict[str, Any], merge: bool, tx: Transaction | None) -> None:
        if not (self.has_node if kind == "node" else self.has_edge)(ident, tx):
            raise (NodeNotFoundError if kind == "node" else EdgeNotFoundError)(f"{kind.title()} '{ident}' does not exist")
        interchange.check_properties(props)
        rows = interchange.frame(self.spark, [{"_id": ident, "props": props}], "_id string")
        state = self._state(tx)
        df = state.nodes if kind == "node" else state.edges
        for k, v in props.items():
            if v is None and k in df.columns:
                rows = rows.withColumn(k, F.col(quoted(k)).cast(df.schema[k].dataType))
        self._change([Update(kind, rows, not merge)], tx)

    def set_node_properties(self, ident: str, properties: dict[str, Any], merge: bool = True, transaction: Transaction | None = None) -> None:
        self._set("node", ident, properties, merge, transaction)

    def set_edge_properties(self, ident: str, properties: dict[str, Any], merge: bool = True, transaction: Transaction | None = None) -> None:
        self._set("edge", ident, properties, merge, transaction)

    def unset_node_properties(self, ident: str, keys: Iterable[str], transaction: Transaction | None = None) -> None:
        self._set("node", ident, dict.fromkeys(keys), True, transaction)

    def unset_edge_properties(self, ident: str, keys: Iterable[str], transaction: Transaction | None = None) -> None:
        self._set("edge", ident, dict.fromkeys(keys), True, transaction)

    def remove_node_labels(self, ident: str, labels: Iterable[str], transaction: Transaction | None = None) -> None:
        self._need_node(ident, transaction)
        self._change([DropLabels(self._ids(ident), tuple(labels))], transaction)

    def clear(self) -> None:
        self._install(Snapshot.empty(self.spark), [Remove("node", self._snapshot.nodes.select("_id")), Remove("edge", self._snapshot.edges.select("_id"))])

    def compact(self) -> None:
        """Publishes the snapshot: cuts the lineage of past changes, nothing else."""
        self._snapshot = Snapshot(publish(self._snapshot.nodes), publish(self._snapshot.edges))

    def warm_cache(self) -> None:
        for df in (self._snapshot.nodes, self._snapshot.edges):
            df.persist(StorageLevel.MEMORY_AND_DISK).count()

    def supports_transactions(self) -> bool:
        return self._catalog is None

    def create_transaction(self) -> Transaction:
        return Transaction(self)

    # ---------------------------------------------------------------- algorithms

    def _ends(self, given: str | list[str], node_types: list[str]) -> tuple[DataFrame, bool]:
        nodes = self._tables().nodes
        wild = given == "*" or isinstance(given, list) and (not given or "*" in given)
        if not wild:
            ids = [given] if isinstance(given, str) else given
            return nodes.where(F.col("_id").isin(ids)).select("_id"), False
        if not node_types or "*" in node_types:
            if nodes.limit(100).count() >= 100:
                raise TraversalLimitExceededError("Untyped wildcards are limited to graphs of fewer than 100 nodes")
            return nodes.select("_id"), True
        return nodes.where(F.arrays_overlap("_labels", F.array(*[F.lit(t) for t in node_types]))).select("_id"), True

    def traverse_df(self, source: str | list[str], target: str | list[str], node_types: list[str] | None = None, edge_types: list[str] | None = None) -> DataFrame:
        """(src, dst, path) with a shortest path for every pair that has one."""
        t = self._tables()
        kinds, types = node_types or ["*"], edge_types or ["*"]
        edges = t.edges if "*" in types else t.edges.where(F.col("_type").isin(types))
        allowed = t.nodes.select("_id") if "*" in kinds else t.nodes.where(F.arrays_overlap("_labels", F.array(*[F.lit(k) for k in kinds]))).select("_id")
        return algorithms.shortest_paths(edges, self._ends(source, kinds)[0], self._ends(target, kinds)[0], allowed)

    def traverse(self, source: str | list[str], target: str | list[str], method: str = "bfs", node_types: list[str] | None = None, edge_types: list[str] | None = None, max_results: int = 100) -> list[list[str]] | None:
        """Paths as lists of ids, None if there are none. Depth-first asks for any path, so both methods give a shortest."""
        wild = sum(self._ends(x, node_types or ["*"])[1] for x in (source, target))
        most = min(max_results, (max_results, 50, 10)[wild])
        rows = self.traverse_df(source, target, node_types, edge_types).orderBy(F.size("path"), "src", "dst").limit(most).collect()
        return [list(r["path"]) for r in rows] or None

    def is_dag(self) -> bool:
        t = self._tables()
        return algorithms.peel(t.nodes, t.edges)[1]

    def topological_levels(self) -> DataFrame | None:
        """(_id, level), or None if there is a cycle."""
        t = self._tables()
        levels, whole = algorithms.peel(t.nodes, t.edges)
        return levels if whole else None

    def topological_sort(self) -> list[str] | None:
        levels = self.topological_levels()
        return None if levels is None else [r["_id"] for r in levels.orderBy("level", "_id").collect()]

    # ---------------------------------------------------------------- import and export

    @classmethod
    def import_json(cls, spark: SparkSession, data: dict[str, Any] | str, graph_id: str | None = None) -> Graph:
        g = cls(spark, graph_id=graph_id or (json.loads(data) if isinstance(data, str) else data).get("graphId"))
        g._snapshot = interchange.load(spark, data)
        return g

    def export_json(self) -> dict[str, Any]:
        return interchange.dump(self._tables(), self.graph_id)

    def to_mermaid(self, **options: Any) -> str:
        return interchange.to_mermaid(self.export_json(), **options)


class GraphManager:
    """Named graphs, each on its own."""

    _one: GraphManager | None = None

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._graphs: dict[str, Graph] = {}

    @classmethod
    def init(cls, spark: SparkSession) -> GraphManager:
        cls._one = cls(spark)
        return cls._one

    @classmethod
    def get_instance(cls) -> GraphManager:
        if cls._one is None:
            raise GraphError("GraphManager has not been initialised")
        return cls._one

    @classmethod
    def reset(cls) -> None:
        cls._one = None

    def for_graph(self, graph_id: str) -> Graph:
        return self._graphs.setdefault(graph_id, Graph(self.spark, graph_id=graph_id))

    def drop(self, graph_id: str) -> None:
        self._graphs.pop(graph_id, None)
