"""Graphs from CSV files and query scripts, trip records made ready for them, and query results as JSON text."""

from __future__ import annotations

import datetime
import decimal
import re

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import temporal
from .graph import PropertyGraph

ZONES = "id string, borough string, zone string, service_zone string"
TRIPS = "pickup string, dropoff string, distance double, fare double, passengers string"
AGGREGATED = "pickup string, dropoff string, trips long, distance double, fare double, passengers long"
#: Zones that trip records are made ready for.
LEAST_ZONE, MOST_ZONE = 1, 263


def whole(name: str) -> F.Column:
    """The number that a text begins with, null where it begins with none."""
    return F.nullif(F.regexp_extract(name, r"^\s*([+-]?[0-9]+)", 1), F.lit("")).cast("long")


def trip_graph(spark: SparkSession, zones: str, trips: str, aggregated: bool = False) -> PropertyGraph:
    """Zones as nodes and trips (or, aggregated, their sums for each pair) as relationships; trips of unknown zones are left out.

    A trip's id is its place among the rows of its file parts: the same each time the files are read as they are.
    """
    table = spark.read.schema(ZONES).csv(zones, header=True).withColumn("id", whole("id")).where("id is not null")
    nodes = table.select("id", F.col("id").alias("key"), "borough", "zone")
    rows = spark.read.schema(AGGREGATED if aggregated else TRIPS).csv(trips, header=True)
    rows = rows.select(F.monotonically_increasing_id().alias("id"), whole("pickup").alias("start"), whole("dropoff").alias("end"), *[whole(c).alias(c) if c == "passengers" and not aggregated else F.col(c) for c in rows.columns[2:]])
    known = nodes.select(F.col("id").alias("zone_id"))
    for end in ("start", "end"):
        rows = rows.join(known, F.col(end) == F.col("zone_id"), "left_semi")
    return PropertyGraph({"Zone": nodes}, {"TRIP": (rows, "Zone", "Zone")})


def prepare_trips(records: DataFrame, aggregated: bool = False) -> DataFrame:
    """Trip records (PULocationID, DOLocationID, trip_distance, fare_amount, passenger_count) of known zones, nulls as 0; aggregated: summed for each pair."""
    some = records.select(
        F.col("PULocationID").cast("long").alias("pickup"), F.col("DOLocationID").cast("long").alias("dropoff"), F.coalesce(F.col("trip_distance").cast("double"), F.lit(0.0)).alias("distance"),
        F.coalesce(F.col("fare_amount").cast("double"), F.lit(0.0)).alias("fare"), F.coalesce(F.col("passenger_count").cast("long"), F.lit(0)).alias("passengers"),
    ).where(F.col("pickup").between(LEAST_ZONE, MOST_ZONE) & F.col("dropoff").between(LEAST_ZONE, MOST_ZONE))
    if not aggregated:
        return some
    return some.groupBy("pickup", "dropoff").agg(F.count(F.lit(1)).alias("trips"), F.sum("distance").alias("distance"), F.sum("fare").alias("fare"), F.sum("passengers").alias("passengers"))


def statements(script: str) -> list[str]:
    """The statements of a script between semicolons, without comments and without those that define indexes or constraints."""
    out, now = [], ""
    for part in re.findall(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|//[^\n]*|/\*.*?\*/|;|[^'"`/;]+|.""", script, re.S):
        if part == ";":
            out.append(now)
            now = ""
        elif not part.startswith(("//", "/*")):
            now += part
    schema = re.compile(r"\s*(create|drop)\s+(constraint|index|fulltext|unique)\b", re.I)
    return [x.strip() for x in [*out, now] if x.strip() and not schema.match(x)]


def run_script(graph: PropertyGraph, script: str, spark: SparkSession, params: dict | None = None) -> PropertyGraph:
    """The graph after all statements of a script, one after the other."""
    from ..plans.compiler import execute

    for text in statements(script):
        graph = execute(graph, text, spark, params)[1]
    return graph


def tagged(x, t: T.DataType):
    """A value of a result as JSON can hold it: entities, paths and temporal values carry a tag `~t`."""
    if x is None or isinstance(x, (bool, int, str)):
        return x
    if isinstance(x, float):
        return x if x == x and abs(x) != float("inf") else {"~t": "float", "v": str(x)}
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, (datetime.date, datetime.datetime)):
        return {"~t": temporal.kind_of(t) or "date", "v": x.isoformat()}
    if isinstance(x, (list, tuple)) and not isinstance(x, Row):
        return [tagged(y, t.elementType) for y in x]
    if isinstance(x, Row):
        fields = {f.name: tagged(x[f.name], f.dataType) for f in t.fields}
        if {"id", "labels"} <= set(fields):
            return {"~t": "node", "id": fields.pop("id"), "labels": fields.pop("labels"), "properties": {k: v for k, v in fields.items() if v is not None}}
        if {"id", "type", "start", "end"} <= set(fields):
            return {"~t": "relationship", **{k: fields.pop(k) for k in ("id", "type", "start", "end")}, "properties": {k: v for k, v in fields.items() if v is not None}}
        if set(fields) == {"nodes", "relationships"}:
            return {"~t": "path", **fields}
        return {"~t": temporal.kind_of(t), **fields} if temporal.kind_of(t) else fields
    return str(x)


def result_json(df: DataFrame) -> dict:
    """A result as {columns, rows, count} for a client; it is put together on the driver, so it should be a small one."""
    rows = [[tagged(v, f.dataType) for v, f in zip(r, df.schema.fields, strict=True)] for r in df.collect()]
    return {"columns": df.columns, "rows": rows, "count": len(rows)}


def write_json(df: DataFrame, folder: str) -> None:
    """A result of any size as JSON lines, written by the executors."""
    df.write.mode("overwrite").json(folder)


def save_graph(graph: PropertyGraph, folder: str) -> None:
    """A snapshot: one Parquet folder for each label and type."""
    for label in graph.nodes:
        graph.labelled(label).write.mode("overwrite").parquet(f"{folder}/nodes/label={label or '#none'}")
    for name, (df, a, b) in graph.rels.items():
        df.withColumns({"#a": F.lit(a), "#b": F.lit(b)}).write.mode("overwrite").parquet(f"{folder}/rels/type={name}")


def load_graph(spark: SparkSession, folder: str) -> PropertyGraph:
    """A saved snapshot."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(kind: str) -> list[str]:
        top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}")
        return sorted(s.getPath().getName().partition("=")[2] for s in fs.listStatus(top)) if fs.exists(top) else []

    nodes, mixed, rels = {}, {}, {}
    for label in names("nodes"):
        df = spark.read.parquet(f"{folder}/nodes/label={label}")
        own = "" if label == "#none" else label
        held = {x for r in df.select(F.explode("labels").alias("l")).distinct().collect() for x in r}
        if held <= {own} and own and df.where(F.size("labels") != 1).isEmpty():
            nodes[own] = df.drop("labels")
        else:
            nodes[own], mixed[own] = df, held
    for name in names("rels"):
        df = spark.read.parquet(f"{folder}/rels/type={name}")
        one = df.select("#a", "#b").first()
        rels[name] = (df.drop("#a", "#b"), *(one or (None, None)))
    return PropertyGraph(nodes, rels, mixed=mixed)
