"""JSON interchange ({graphId, nodes, edges}) and Mermaid text."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nodeloom.errors import EdgeAlreadyExistsError, InvalidGraphDataError, InvalidPropertyError, NodeAlreadyExistsError
from nodeloom.operators.mutations import EDGE_SCHEMA, NODE_SCHEMA, Snapshot
from nodeloom.sources.catalog import EDGE_META, NODE_META, quoted


def check_properties(props: dict[str, Any]) -> None:
    for k, v in props.items():
        if v is not None and not isinstance(v, (str, int, float, bool)):
            raise InvalidPropertyError(f"Property '{k}' must be a string, number, boolean or null, got {type(v).__name__}")


def _kind(v: Any) -> T.DataType:
    return T.BooleanType() if isinstance(v, bool) else T.LongType() if isinstance(v, int) else T.DoubleType() if isinstance(v, float) else T.StringType()


def frame(spark: SparkSession, rows: list[dict[str, Any]], base: str) -> DataFrame:
    """Rows of meta fields and ``props`` as a table with a column per property."""
    schema = T.StructType(list(T.DataType.fromDDL(base).fields))  # type: ignore[attr-defined]
    types: dict[str, T.DataType] = {}
    for r in rows:
        for k, v in r["props"].items():
            if v is None:
                types.setdefault(k, T.NullType())
                continue
            t, held = _kind(v), types.get(k)
            numbers = {type(t), type(held)} <= {T.LongType, T.DoubleType}
            types[k] = t if held is None or isinstance(held, T.NullType) or held == t else T.DoubleType() if numbers else T.StringType()
    for k, t in types.items():
        schema = schema.add(k, T.StringType() if isinstance(t, T.NullType) else t)

    def fit(v: Any, t: T.DataType) -> Any:
        if v is None:
            return None
        if isinstance(t, T.DoubleType):
            return float(v)
        return json.dumps(v) if isinstance(t, T.StringType) and not isinstance(v, str) else v

    meta = [f.name for f in T.DataType.fromDDL(base).fields]  # type: ignore[attr-defined]
    data = [tuple([r.get(m) for m in meta] + [fit(r["props"].get(k), schema[k].dataType) for k in types]) for r in rows]
    return spark.createDataFrame(data, schema)


def node_row(x: dict[str, Any]) -> dict[str, Any]:
    props = x.get("properties") or {}
    check_properties(props)
    return {"_id": x["id"], "_labels": list(x.get("labels") or []), "createdOn": x.get("createdOn"), "updatedOn": x.get("updatedOn"), "props": props}


def edge_row(x: dict[str, Any]) -> dict[str, Any]:
    props = x.get("properties") or {}
    check_properties(props)
    return {"_id": x["id"], "_src": x["sourceId"], "_dst": x["targetId"], "_type": x["type"], "createdOn": x.get("createdOn"), "updatedOn": x.get("updatedOn"), "props": props}


def load(spark: SparkSession, data: dict[str, Any] | str) -> Snapshot:
    """A snapshot of interchange data; edges may dangle."""
    data = validated(data)
    for name, error in (("nodes", NodeAlreadyExistsError), ("edges", EdgeAlreadyExistsError)):
        seen: set[str] = set()
        for x in data[name]:
            if x["id"] in seen:
                raise error(f"'{x['id']}' occurs more than once")
            seen.add(x["id"])
    return Snapshot(frame(spark, [node_row(x) for x in data["nodes"]], NODE_SCHEMA), frame(spark, [edge_row(x) for x in data["edges"]], EDGE_SCHEMA))


def read_json(spark: SparkSession, nodes_path: str, edges_path: str) -> Snapshot:
    """Large graphs: JSON lines of nodes and edges in interchange form, read by Spark."""

    def wide(df: DataFrame, names: dict[str, str]) -> DataFrame:
        props = df.schema["properties"].dataType.names if "properties" in df.columns else []
        have = set(df.columns)
        cols = [(F.col(old) if old in have else F.lit(None).cast("long")).alias(new) for old, new in names.items()]
        return df.select(*cols, *[F.col(f"properties.{quoted(p)}").alias(p) for p in props])

    common = {"createdOn": "createdOn", "updatedOn": "updatedOn"}
    nodes = wide(spark.read.json(nodes_path), {"id": "_id", "labels": "_labels"} | common)
    edges = wide(spark.read.json(edges_path), {"id": "_id", "sourceId": "_src", "targetId": "_dst", "type": "_type"} | common)
    return Snapshot(nodes, edges)


def as_documents(df: DataFrame, names: dict[str, str], meta: tuple[str, ...]) -> DataFrame:
    props = [c for c in df.columns if c not in meta]
    body = F.struct(*[F.col(quoted(p)) for p in props]) if props else F.struct(F.lit(None).cast("string").alias("_"))
    return df.select(*[F.col(old).alias(new) for old, new in names.items()], "createdOn", "updatedOn", body.alias("properties"))


def nodes_out(s: Snapshot) -> DataFrame:
    return as_documents(s.nodes, {"_id": "id", "_labels": "labels"}, NODE_META)


def edges_out(s: Snapshot) -> DataFrame:
    return as_documents(s.edges, {"_id": "id", "_src": "sourceId", "_dst": "targetId", "_type": "type"}, EDGE_META)


def write_json(s: Snapshot, nodes_path: str, edges_path: str) -> None:
    nodes_out(s).write.json(nodes_path)
    edges_out(s).write.json(edges_path)


def dump(s: Snapshot, graph_id: str | None = None) -> dict[str, Any]:
    """The whole snapshot as one Python value: for graphs that fit the driver."""

    def plain(r: Any) -> dict[str, Any]:
        x = r.asDict(recursive=True)
        x["properties"] = {k: v for k, v in x["properties"].items() if v is not None and k != "_"}
        return x

    return {"graphId": graph_id, "nodes": [plain(r) for r in nodes_out(s).orderBy("id").collect()], "edges": [plain(r) for r in edges_out(s).orderBy("id").collect()]}


def validated(data: Any) -> dict[str, Any]:
    if isinstance(data, str):
        try:
            data = json.loads(data)
        except ValueError as error:
            raise InvalidGraphDataError(f"Invalid JSON: {error}") from error
    if not isinstance(data, dict):
        raise InvalidGraphDataError("Graph data must be an object")
    for name in ("nodes", "edges"):
        if not isinstance(data.get(name), list):
            raise InvalidGraphDataError(f"Graph data must have a list of {name}")
    return data


def to_mermaid(data: dict[str, Any] | str, show_properties: bool = False, include_edge_labels: bool = True, direction: str = "TD") -> str:
    """Flowchart text: at most three properties a node, values cut to 20 characters."""
    data = validated(data)
    names: dict[str, str] = {}

    def name(ident: str) -> str:
        if ident not in names:
            base = re.sub(r"[^A-Za-z0-9_-]", "_", ident)
            taken, k, out = set(names.values()), 0, base
            while out in taken:
                k += 1
                out = f"{base}_{k}"
            names[ident] = out
        return names[ident]

    def safe(text: Any) -> str:
        return str(text).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("]", "\\]")

    def short(v: Any) -> str:
        text = ("true" if v else "false") if isinstance(v, bool) else str(v)
        return text if len(text) <= 20 else text[:17] + "..."

    lines = [f"flowchart {direction}"]
    for n in data["nodes"]:
        parts = [safe(":".join(n["labels"])), safe(n["id"])]
        props = list((n.get("properties") or {}).items())[:3]
        if show_properties and props:
            parts.append("{" + ", ".join(f"{safe(k)}: {safe(short(v))}" for k, v in props) + "}")
        lines.append(f'    {name(n["id"])}["{" | ".join(parts)}"]')
    for e in data["edges"]:
        label = f'|"{safe(e["type"])}"|' if include_edge_labels and e.get("type") else ""
        lines.append(f"    {name(e['sourceId'])} -->{label} {name(e['targetId'])}")
    return "\n".join(lines)
