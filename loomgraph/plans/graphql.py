"""GraphQL reads as DataFrame plans: nested fields are joins, lists of a node's relationships are collected by its id."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ArgumentError, CypherError, CypherSyntaxError
from ..lang.graphql import parse_graphql
from ..sources.graph import PropertyGraph

HIDDEN = ("id", "labels", "start", "end", "type")


class Reads:
    """Plans of one document; `nodes` and `edges` gather the ids of all that it shows."""

    def __init__(self, graph: PropertyGraph, spark: SparkSession):
        self.graph, self.spark, self.nodes, self.edges = graph, spark, [], []

    @staticmethod
    def properties(table: DataFrame) -> Column:
        own = [c for c in table.columns if not c.startswith("#") and (c not in HIDDEN or (c == "type" and "labels" in table.columns))]
        return F.to_json(F.struct(*[F.col(f"`{c}`") for c in own])) if own else F.lit("{}")

    def page(self, table: DataFrame, arguments: dict, *order: str) -> DataFrame:
        offset, limit = arguments.get("offset") or 0, arguments.get("limit")
        if any(not isinstance(x, int) or x < 0 for x in (offset, limit or 0)):
            raise ArgumentError("NegativeIntegerArgument", str(arguments))
        if offset or limit is not None:
            table = table.orderBy(*order).offset(offset)
            table = table.limit(limit) if limit is not None else table
        return table

    def root(self, field) -> tuple[DataFrame | None, bool]:
        """(id, value) of a root field's entities, and whether it is a list."""
        _, name, arguments, fields = field
        if name in ("node", "relationship"):
            ident = arguments.get("id")
            if ident is None:
                return None, False
            if name == "node":
                keys = self.graph.node_table(None).where(F.col("id") == F.lit(int(ident)).cast("long"))
                return self.node_values(keys, fields), False
            return self.rel_values(self.graph.rel_table([]).where(F.col("id") == F.lit(int(ident)).cast("long")), fields), False
        if name == "nodes":
            table = self.graph.node_table({arguments["label"]} if arguments.get("label") is not None else None)
            return (self.node_values(self.page(table, arguments, "id"), fields) if table is not None else None), True
        if name == "relationships":
            table = self.graph.rel_table([arguments["type"]] if arguments.get("type") is not None else [])
            return (self.rel_values(self.page(table, arguments, "type", "id"), fields) if table is not None else None), True
        raise CypherSyntaxError("UnexpectedSyntax", f"unknown field {name} on Query")

    def node_values(self, table: DataFrame, fields: list) -> DataFrame:
        """(id, value): the selected fields of each node of a table; without fields the id."""
        self.nodes.append(table.select("id"))
        columns, joined = [], table.withColumn("#props", self.properties(table))
        for k, (key, name, arguments, inner) in enumerate(fields):
            if name in ("out", "in", "relationships"):
                way = {"out": "OUT", "in": "IN"}.get(name, arguments.get("direction") or "OUT")
                found = self.expanded(table.select(F.col("id").alias("#node")), way, arguments, inner)
                found = found.withColumnRenamed("list", f"#list{k}")
                joined = joined.join(found, F.col("id") == F.col("#of"), "left").drop("#of")
                columns.append(F.coalesce(F.col(f"#list{k}"), F.array()).alias(key))
            elif name == "__typename":
                columns.append(F.lit("Node").alias(key))
            elif name in ("id", "labels", "properties"):
                columns.append(F.col("#props" if name == "properties" else name).alias(key))
            else:
                raise CypherSyntaxError("UnexpectedSyntax", f"unknown field {name} on Node")
        return joined.select(F.col("id").alias("id"), (F.struct(*columns) if columns else F.col("id")).alias("value"))

    def expanded(self, keys: DataFrame, way: str, arguments: dict, fields: list) -> DataFrame:
        """(#of, list): the values of each node's relationships, by their ids."""
        if way not in ("OUT", "IN", "BOTH"):
            raise ArgumentError("InvalidArgumentValue", f"direction {way}")
        table = self.graph.rel_table([arguments["type"]] if arguments.get("type") is not None else [])
        if table is None:
            table = self.graph.rel_table([]).where(F.lit(False))
        out, back = table.withColumn("#at", F.col("start")), table.withColumn("#at", F.col("end"))
        table = out if way == "OUT" else back if way == "IN" else out.unionByName(back.where("start <> end"))
        table = table.join(keys, F.col("#at") == F.col("#node"), "left_semi")
        if arguments.get("limit") is not None:
            place = F.row_number().over(Window.partitionBy("#at").orderBy("type", "id"))
            table = table.withColumn("#place", place).where(F.col("#place") <= int(arguments["limit"])).drop("#place")
        values = self.rel_values(table, fields)
        return values.groupBy(F.col("#at").alias("#of")).agg(F.sort_array(F.collect_list(F.struct("type", "id", "value"))).alias("l")).select("#of", F.col("l.value").alias("list"))

    def rel_values(self, table: DataFrame, fields: list) -> DataFrame:
        """type, id, value and, where there, #at: the selected fields of each relationship of a table."""
        self.edges.append(table.select("type", "id"))
        self.nodes += [table.select(F.col(c).alias("id")) for c in ("start", "end")]
        columns, joined = [], table.withColumn("#props", self.properties(table))
        for k, (key, name, _, inner) in enumerate(fields):
            if name in ("from", "start", "to", "end"):
                end = "start" if name in ("from", "start") else "end"
                if not inner:
                    columns.append(F.col(end).alias(key))
                    continue
                wanted = table.select(F.col(end).alias("#id")).distinct()
                value = self.node_values(self.graph.node_table(None).join(wanted, F.col("id") == F.col("#id"), "left_semi"), inner)
                value = value.select(F.col("id").alias(f"#id{k}"), F.col("value").alias(f"#value{k}"))
                joined = joined.join(value, F.col(end) == F.col(f"#id{k}"), "left").drop(f"#id{k}")
                columns.append(F.col(f"#value{k}").alias(key))
            elif name == "__typename":
                columns.append(F.lit("Relationship").alias(key))
            elif name in ("id", "type", "properties"):
                columns.append(F.col("#props" if name == "properties" else name).alias(key))
            else:
                raise CypherSyntaxError("UnexpectedSyntax", f"unknown field {name} on Relationship")
        more = ["#at"] if "#at" in table.columns else []
        return joined.select(*more, "type", "id", (F.struct(*columns) if columns else F.col("id")).alias("value"))


def graphql_frames(graph: PropertyGraph, text: str, spark: SparkSession, variables: dict | None = None) -> dict[str, DataFrame | None]:
    """For each root field of the first operation its rows (id, value), without any order; None where there can be none."""
    reads = Reads(graph, spark)
    return {f[0]: reads.root(f)[0] for f in parse_graphql(text, variables) if f[1] != "__typename"}


def graphql(graph: PropertyGraph, text: str, spark: SparkSession, variables: dict | None = None) -> dict:
    """The answer as a GraphQL client gets it: data, and in extensions.graph all nodes and edges that it shows.

    It is put together on the driver, so limits in the query bound it; graphql_frames leaves it in the
    cluster. A fault gives null data and its message.
    """
    try:
        reads, data = Reads(graph, spark), {}
        for f in parse_graphql(text, variables):
            if f[1] == "__typename":
                data[f[0]] = "Query"
                continue
            df, many = reads.root(f)
            by = [c for c in ("type", "id") if df is not None and c in df.columns]
            rows = [plain(r["value"]) for r in df.orderBy(*by).select("value").collect()] if df is not None else []
            data[f[0]] = rows if many else rows[0] if rows else None
        out = {"nodes": [], "edges": []}
        if reads.nodes:
            ids = reduce(DataFrame.union, reads.nodes).distinct().withColumnRenamed("id", "#id")
            table = graph.node_table(None).join(ids, F.col("id") == F.col("#id"), "left_semi")
            out["nodes"] = [plain(r) for r in table.select("id", "labels", reads.properties(table).alias("properties")).orderBy("id").collect()]
        if reads.edges:
            ids = reduce(DataFrame.union, reads.edges).distinct().select(F.col("type").alias("#type"), F.col("id").alias("#id"))
            table = graph.rel_table([])
            table = table.join(ids, (F.col("id") == F.col("#id")) & (F.col("type") == F.col("#type")), "left_semi")
            out["edges"] = [plain(r) for r in table.select("id", "type", "start", "end", reads.properties(table).alias("properties")).orderBy("type", "id").collect()]
        return {"data": data, "extensions": {"graph": out}}
    except (CypherError, ValueError) as e:
        return {"data": None, "errors": [{"message": str(e)}]}


def plain(x, key: str = ""):
    """Rows as dicts; properties, which are JSON text, as what they say."""
    if hasattr(x, "asDict"):
        return {k: plain(v, k) for k, v in x.asDict().items()}
    if isinstance(x, list):
        return [plain(v) for v in x]
    return json.loads(x) if key == "properties" and isinstance(x, str) else x
