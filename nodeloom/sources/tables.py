"""The star-schema test tables as a property graph.

Node and edge tables are projections of Parquet scans with native keys; Catalyst prunes and pushes filters through them.
Line items have no key of their own, so their edges take a hash of the whole row as identity, which only trail
uniqueness and DISTINCT use.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nodeloom.sources.catalog import Catalog, EdgeTable, NodeTable


def star_schema(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalog of the tables in ``sf_dir``.

    A table is opened when a query first names its label or type; what columns a path has is looked up once a session.
    """
    schemas: dict[str, StructType] = spark.__dict__.setdefault("_nodeloom_schemas", {})

    @cache
    def read(name: str) -> DataFrame:
        path = f"{sf_dir}/{name}.parquet"
        if path in schemas:
            return spark.read.schema(schemas[path]).parquet(path)
        df = spark.read.parquet(path)
        schemas[path] = df.schema
        return df

    Rows = Callable[[], DataFrame]
    region, nation, customer, supplier, part, orders, lineitem, events = (partial(read, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"))

    def node(rows: Rows, label: str, key: str, props: dict[str, str]) -> NodeTable:
        return NodeTable(lambda: rows().select(F.col(key).cast("long").alias("_id"), *[F.col(c).alias(p) for p, c in props.items()]), (label,), label)

    def edge(rows: Rows, kind: str, a: tuple[str, str], b: tuple[str, str], props: dict[str, str], key: str | None = None, unique: tuple[str, ...] = ()) -> EdgeTable:
        def source() -> DataFrame:
            df = rows()
            ident = F.col(key).cast("long") if key else F.xxhash64(*df.columns)
            return df.select(ident.alias("_id"), F.col(a[1]).cast("long").alias("_src"), F.col(b[1]).cast("long").alias("_dst"), *[F.col(c).alias(p) for p, c in props.items()])

        return EdgeTable(source, kind, a[0], b[0], (a[0],), (b[0],), unique)

    @cache
    def docs() -> DataFrame:
        return read("documents").select("doc_id", "lang", "source", "n_chars").join(read("labels"), "doc_id", "left")

    @cache
    def turns() -> DataFrame:
        return read("conversations").withColumn("key", F.col("conv_id") * 1_000_000 + F.col("turn"))

    @cache
    def following() -> DataFrame:
        return turns().select("key", (F.col("key") + 1).alias("next")).join(turns().select(F.col("key").alias("next")), "next")

    item = {k: f"l_{k}" for k in ("linenumber", "suppkey", "quantity", "extendedprice", "discount", "tax", "returnflag", "linestatus", "shipdate")}
    nodes = (
        node(region, "Region", "r_regionkey", {"name": "r_name"}),
        node(nation, "Nation", "n_nationkey", {"name": "n_name", "regionkey": "n_regionkey"}),
        node(customer, "Customer", "c_custkey", {"name": "c_name", "nationkey": "c_nationkey", "acctbal": "c_acctbal", "mktsegment": "c_mktsegment"}),
        node(supplier, "Supplier", "s_suppkey", {"name": "s_name", "nationkey": "s_nationkey", "acctbal": "s_acctbal"}),
        node(part, "Part", "p_partkey", {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "retailprice": "p_retailprice"}),
        node(orders, "Order", "o_orderkey", {"custkey": "o_custkey", "orderstatus": "o_orderstatus", "totalprice": "o_totalprice", "orderdate": "o_orderdate", "orderpriority": "o_orderpriority"}),
        node(events, "Event", "event_id", {"ts": "ts", "event_type": "event_type", "value": "value"}),
        node(lambda: events().select("user_id").distinct(), "User", "user_id", {}),
        node(docs, "Document", "doc_id", {"lang": "lang", "source": "source", "n_chars": "n_chars", "quality": "quality", "toxic": "toxic"}),
        node(turns, "Turn", "key", {"conv": "conv_id", "turn": "turn", "role": "role", "text": "text"}),
    )
    edges = (
        edge(nation, "IN_REGION", ("Nation", "n_nationkey"), ("Region", "n_regionkey"), {}, "n_nationkey", ("src",)),
        edge(customer, "IN_NATION", ("Customer", "c_custkey"), ("Nation", "c_nationkey"), {}, "c_custkey", ("src",)),
        edge(supplier, "BASED_IN", ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), {}, "s_suppkey", ("src",)),
        edge(orders, "PLACED", ("Customer", "o_custkey"), ("Order", "o_orderkey"), {"orderdate": "o_orderdate"}, "o_orderkey", ("dst",)),
        edge(lineitem, "CONTAINS", ("Order", "l_orderkey"), ("Part", "l_partkey"), item),
        edge(lineitem, "SUPPLIED", ("Supplier", "l_suppkey"), ("Order", "l_orderkey"), item),
        edge(events, "DID", ("User", "user_id"), ("Event", "event_id"), {}, "event_id", ("dst",)),
        edge(following, "NEXT", ("Turn", "key"), ("Turn", "next"), {}, "key", ("src", "dst")),
    )
    return Catalog(nodes, edges, complete=True)
